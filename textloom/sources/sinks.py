"""Writing: sharded outputs with a manifest, fingerprints, reuse and resume, validation, append-only histories."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "2.0"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; on one machine a temporary one where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, path[len("file://") :], ignore_errors=True)
    return path.rstrip("/")


def fingerprint(config: Mapping) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def with_shards(df: DataFrame, order: list[str], shard_rows: int) -> DataFrame:
    """Adds shard_index and row_index by rank in order."""
    from textloom.operators.ranges import ranked

    row = F.col("__row")
    return ranked(df, order, "__row").withColumns({"shard_index": F.floor(row / shard_rows).cast("long"), "row_index": F.pmod(row, F.lit(shard_rows)).cast("long")}).drop("__row")


def write_prepared(df: DataFrame, folder: str, kind: str, config: Mapping, shard_rows: int, tokens: str | None = None) -> dict:
    """Writes rows as Parquet by shard_index with a manifest of the counts; returns the manifest. The manifest is written
    last, so that a folder without one is a partial output."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy("shard_index").parquet(f"{folder}/rows")
    done = spark.read.parquet(f"{folder}/rows")
    shards = done.groupBy("shard_index").agg(F.count(F.lit(1)).alias("rows")).orderBy("shard_index").collect()  # a row per shard
    total = done.agg(F.sum(tokens)).first()[0] if tokens else None
    manifest = {
        "version": VERSION, "kind": kind, "input_fingerprint": fingerprint(config), "num_sequences": sum(r["rows"] for r in shards), "num_tokens": total, "shard_rows": shard_rows,
        "shards": [{"shard_index": r["shard_index"], "rows": r["rows"]} for r in shards],
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    return _json(spark, f"{folder}/manifest")


def exists(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _json(spark: SparkSession, folder: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(folder).collect()
    except AnalysisException:
        return None
    text = "\n".join(r[0] for r in rows).strip()
    return json.loads(text) if text else None


def save_progress(spark: SparkSession, folder: str, kind: str, config: Mapping, state: Mapping) -> None:
    """Where a build stands (cursors, counts), so that another run goes on from there; in place of what was there."""
    payload = {"kind": kind, "input_fingerprint": fingerprint(config), **state}
    spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/progress")


def load_progress(spark: SparkSession, folder: str) -> dict | None:
    return _json(spark, f"{folder}/progress")


def resolve_target(spark: SparkSession, folder: str, kind: str, config: Mapping, force: bool = False) -> str:
    """fresh, reuse, resume or rebuild. Another kind or another input in the same place is an error unless forced, and so are
    rows without a manifest or progress; an empty manifest is none."""
    if force:
        return "rebuild"

    def check(found: dict) -> None:
        if found.get("input_fingerprint") != fingerprint(config):
            raise ValueError(f"{folder} was prepared from another configuration")
        if found.get("kind") != kind:
            raise ValueError(f"{folder} holds {found.get('kind')}, not {kind}")

    manifest = read_manifest(spark, folder)
    if manifest is not None:
        check(manifest)
        if problems := validate(spark, folder, kind):
            raise ValueError("; ".join(problems))
        return "reuse"
    progress = load_progress(spark, folder)
    if progress is not None:
        check(progress)
        return "resume"
    if exists(spark, f"{folder}/rows"):
        raise ValueError(f"{folder} holds rows without a manifest or progress")
    return "fresh"


def validate(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """What is wrong with a prepared folder; nothing where it is whole."""
    manifest = read_manifest(spark, folder)
    if manifest is None:
        return ["no manifest"]
    problems = [] if manifest["kind"] == kind else [f"kind is {manifest['kind']}"]
    if not manifest["shards"]:
        return [*problems, "no shards"]
    have = {r["shard_index"]: r["n"] for r in spark.read.parquet(f"{folder}/rows").groupBy("shard_index").agg(F.count(F.lit(1)).alias("n")).collect()}
    for s in manifest["shards"]:
        if s["rows"] <= 0 or have.get(s["shard_index"]) != s["rows"]:
            problems.append(f"shard {s['shard_index']} has {have.get(s['shard_index'])} rows, not {s['rows']}")
    if sum(s["rows"] for s in manifest["shards"]) != manifest["num_sequences"]:
        problems.append("rows of shards do not add up")
    return problems


def read_prepared(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    problems = validate(spark, folder, kind)
    if problems:
        raise ValueError("; ".join(problems))
    return spark.read.parquet(f"{folder}/rows")


def trust(flags: Mapping[str, bool]) -> str:
    return "blocked" if flags.get("blocked") else "dev_only" if flags.get("dev_only") or flags.get("untrusted") else "promotable"


def append_history(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def best_of(df: DataFrame, path: str, metric: str, step: str, keep: int) -> DataFrame:
    """The best candidates by (metric, step), each path once."""
    once = df.withColumn("__n", F.row_number().over(Window.partitionBy(path).orderBy(metric, step))).filter("__n = 1").drop("__n")
    return once.orderBy(metric, step).limit(keep)


def retention(df: DataFrame, path: str, metric: str, step: str, keep: int) -> DataFrame:
    """df's candidates, each path once, with keep: whether it is among the best or is to be pruned."""
    best = best_of(df, path, metric, step, keep).select(path)
    once = df.withColumn("__n", F.row_number().over(Window.partitionBy(path).orderBy(metric, step))).filter("__n = 1").drop("__n")
    return once.join(best.withColumn("__b", F.lit(True)), path, "left").withColumn("keep", F.coalesce("__b", F.lit(False))).drop("__b")


def artifact_status(blocked: Column, dev_only: Column, untrusted: Column) -> Column:
    """blocked before dev_only before promotable; flags that are not known do not hold."""
    held = lambda c: F.coalesce(c, F.lit(False))
    return F.when(held(blocked), "blocked").when(held(dev_only) | held(untrusted), "dev_only").otherwise("promotable")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path below folder, bytes, sha256) of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    below = F.regexp_replace("path", r"^.*?/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_examples(df: DataFrame, folder: str) -> DataFrame:
    """Rows as JSON lines; returns them as read again with their schema."""
    df.write.mode("overwrite").json(folder)
    return df.sparkSession.read.schema(df.schema).json(folder)
