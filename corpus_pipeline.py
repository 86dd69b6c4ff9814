"""The corpus pipeline: toxicity, exact deduplication, near-duplicates, benchmark decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, extra ones too, whatever
their names. In every stage a null text counts as empty, an empty table gives no rows, and a very long text is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import read, remove, shared_dir
from textloom.llm.decontamination import drop_contaminated
from textloom.llm.exact_dedup import keep_first_copies
from textloom.llm.packing import pack
from textloom.llm.simhash import keep_first_of_components
from textloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the threshold; rows that repeat share their fate, null ids and blank texts are
    scored like any other. Without labels nothing can be learned and an untrained network scores."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts one row, that with the smallest id; null ids come last, and of rows that repeat an id and a text
    one stays. Blank texts equal each other if their white space does."""
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row, that with the smallest id; null ids come last, and of rows that repeat an
    id and a text one stays. Texts without a word are near copies of each other."""
    return keep_first_of_components(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item; rows that repeat share their fate, null ids and texts
    without a word stay, and so does everything where the benchmark is empty."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of what is left, in optimal length buckets and token-budget batches; texts without a token give none, rows
    that repeat give theirs each, null ids are kept."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the network's scores; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what is between them is kept under spark.checkpoint.dir until the next stage is written."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
