"""Exact duplicates by a distributed content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import keep_rows, partitions

#: Characters of the normalised text that head the sort key. Splitters are sampled to the driver, so their size must be
#: bounded; a hash breaks ties among long common heads, and the whole text is the last key.
HEAD_CHARS = 32
#: A group of copies is dealt out in pieces from this many rows on (or from a quarter of a partition's share).
HOT_ROWS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sha256(norm: Column) -> Column:
    # coalesce tells the optimizer that it is never null; else a join on it pushes a filter below the shuffle, which then
    # isn't the same shuffle any more.
    return F.coalesce(F.sha2(norm.cast("binary"), 256), F.lit(""))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space; a null text counts as
    empty. Sampled splitters range-partition the rows by (head, hash) of the normalised text, each partition is sorted
    externally by (head, hash, text, id), and a window compares neighbours by their whole text. Groups of more than
    max(HOT_ROWS, rows / (4 * partitions)) copies (at most 4 * partitions of them, hence broadcast) are spread over
    several partitions by a salt on the id; the winners of their pieces meet in a second, small comparison, which reads
    the same shuffle again.

    The smallest id stays (null ids come last). Of rows repeated with the same id and text one is kept. Other columns of
    docs, whatever their names, are not read. No rows give no rows. Very long texts are compared in whole; a row must fit
    the memory of a task.
    """
    parts = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    keyed = base.select("id", "text", F.substring(norm, 1, HEAD_CHARS).alias("head"), F.xxhash64(norm).alias("h"))
    pieces = max(HOT_ROWS, base.count() // (4 * parts))
    hot = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > pieces)
    hot = hot.select("h", F.ceil(F.col("c") / pieces).alias("pieces"))
    dealt = keyed.join(F.broadcast(hot), "h", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0))
    )
    placed = dealt.repartitionByRange("head", "h", "salt").withColumn("norm", norm).drop("text")
    same = Window.partitionBy("head", "h", "salt", "norm")
    order = same.orderBy(F.col("id").asc_nulls_last())
    # One sort serves both: the frame of the aggregates is the whole group, the rank follows the id.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.select(
        "id",
        _sha256(F.col("norm")).alias("sha"),
        F.min("id").over(whole).alias("least"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.row_number().over(order).alias("rank"),
        F.col("pieces").isNotNull().alias("split"),
        "norm",
    )
    joined = found.filter(F.col("split") & (F.col("rank") == 1)).groupBy("norm").agg(F.min("least").alias("all_least"), F.sum("n").alias("all_n"))
    joined = joined.select(_sha256(F.col("norm")).alias("sha"), F.lit(True).alias("split"), "all_least", "all_n")
    out = found.drop("norm").join(F.broadcast(joined), ["sha", "split"], "left")
    keep = F.when(F.col("split"), F.col("all_least")).otherwise(F.col("least"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.when(F.col("split"), F.col("all_n")).otherwise(F.col("n")).alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("rank") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that with the smallest id, with all its columns; of rows that repeat an id and
    a text, one. Null counts as the empty text; null ids come last; an empty table stays empty; extra columns, whatever
    their names, are kept."""
    verdict = exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("mark"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"))
    return keep_rows(docs, verdict, id_col, _sha256(normalised(F.col(text_col))))
