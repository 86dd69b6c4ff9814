"""Session helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python worker takes at once out of an Arrow batch.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str, by_row: bool = False) -> DataFrame:
    """A table. by_row: what reads it takes each row for itself; on one machine, where a table may be one file of one row
    group and hence one task, its rows are then dealt out over the cores. On a cluster tables are read as they are split."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    sc = spark.sparkContext
    if by_row and sc.master.startswith("local") and len(df.inputFiles()) < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none and all of it is on one machine, as in tests, a
    temporary one that goes with the process; on a cluster that is an error, as no executor would see another's files."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if path is None and current.isDefined():
        path = current.get()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
    if current.isEmpty():
        sc.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of docs that verdict (id, mark, kept; a row for each of docs) keeps, with all their columns.

    Where ids are unique, rows are found by id. Where ids repeat, they are found by id and mark (a hash that docs' rows
    are given by mark), and of rows that share both one stays, chosen before the rows are shuffled.
    """
    verdict = cut(verdict.select("id", "mark", "kept"))
    key, hashed, n = (fresh(docs, x) for x in ("kept_id", "kept_mark", "kept_n"))
    repeated = verdict.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if not repeated:
        kept = verdict.filter("kept").select(F.col("id").alias(key))
        return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
    kept = verdict.filter("kept").select(F.col("id").alias(key), F.col("mark").alias(hashed)).distinct()
    marked = docs.withColumn(n, mark)
    found = marked.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(n) == F.col(hashed)), "left_semi")
    place = fresh(found, "kept_place")
    first = F.row_number().over(Window.partitionBy(id_col, n).orderBy(F.lit(1)))
    return found.withColumn(place, first).filter(F.col(place) == 1).select(docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch, each of about limit bytes in a string column; a longer row is a piece of its own."""
    sizes = batch.column(column).cast(pa.large_string())
    start, total = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def fold_of(column, modulus: int):
    """crc32 of the id as text, modulo: the fold that decides what labels may be learned from."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def local_scheme(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file")
