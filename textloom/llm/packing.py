"""Packing into optimal length buckets: dynamic programming over the global histogram, token-budget batches inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut

#: Longest sequence; longer documents go into consecutive sequences of this length and a rest.
MAX_TOKENS = 2048
BUCKETS = 8
#: Padded tokens of a batch.
BATCH_TOKENS = 1 << 16


def count_tokens(text: Column) -> Column:
    """Tokens between runs of ASCII white space, the default unit."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", "")).cast("long")


def optimal_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most so many buckets of lengths that make padding least; of equal results, the one with the
    smallest last cut and so on downwards. histogram: sequences by length."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    n = np.concatenate(([0], np.cumsum([histogram[int(x)] for x in lengths])))
    # Real tokens are the same however they are cut, so least padding is least padded size: sum of n(i..j) * length(j).
    best = n[1:] * lengths
    cuts: list[np.ndarray] = []
    for _ in range(1, min(buckets, len(lengths))):
        new, cut_at = best.copy(), np.zeros(len(lengths), np.int64)
        for j in range(1, len(lengths)):
            total = best[:j] + (n[j + 1] - n[1 : j + 1]) * lengths[j]
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], cut_at[j] = total[i], i + 1
        best = new
        cuts.append(cut_at)
    out, j = [], len(lengths) - 1
    for cut_at in reversed(cuts):
        if cut_at[j]:
            out.append(int(lengths[j]))
            j = int(cut_at[j]) - 1
    return [int(lengths[j]), *reversed(out)]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per sequence: id_col, sequence_no, token_start, token_end, n_tokens, bucket_tokens, batch_no, slot.

    A document of n tokens gives ceil(n / max_tokens) sequences (without tokens, none); tokens may name another count
    than that of the default unit. The global histogram of sequence lengths, at most max_tokens rows, decides the bucket
    boundaries by dynamic programming. Within a bucket, sequences stand in the order of a hash of id, number and text, and
    each batch takes the next floor(batch_tokens / bucket_tokens) of them, at least one; slot is the place in the batch.
    Only the last batch of a bucket may have room.

    Places come from the sizes of ordered ranges of (bucket, hash), so no task numbers a whole bucket; rows that are equal
    in everything may fall into different ranges. Rows that repeat an id are sequences of their own; ids are longs and
    null ones come first; null and empty texts give none and an empty table no rows; other columns, whatever their names,
    are not read. A very long document is many sequences.
    """
    n = count_tokens(F.col(text_col)) if tokens is None else tokens.cast("long")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), n.alias("n"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("h")).filter("n > 0")
    each = narrow.select("id", "n", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_tokens))).alias("sequence_no"))
    start = F.col("sequence_no") * max_tokens
    mark = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("sequence_no").cast("string"), F.lit(":"), F.col("h")).cast("binary"))
    each = each.select(
        "id", "sequence_no", start.alias("token_start"), F.least("n", start + max_tokens).alias("token_end"),
        F.conv(F.left(mark, F.lit(15)), 16, 10).cast("long").alias("place"), F.monotonically_increasing_id().alias("row"),
    )
    each = cut(each).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    histogram = {r.n_tokens: r["count"] for r in each.groupBy("n_tokens").count().collect()}  # at most max_tokens rows
    bucket, room = F.lit(None).cast("long"), F.lit(None).cast("long")
    for e in reversed(optimal_boundaries(histogram, buckets)):
        here = F.col("n_tokens") <= e
        bucket, room = F.when(here, F.lit(e)).otherwise(bucket), F.when(here, F.lit(max(1, batch_tokens // e))).otherwise(room)
    order = ["place", "id", "sequence_no", "token_end", "row"]
    placed = each.select("*", bucket.cast("long").alias("bucket_tokens"), room.cast("long").alias("room"))
    placed = cut(placed.repartitionByRange("bucket_tokens", *order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("bucket_tokens", "part").agg(F.count(F.lit(1)).alias("c"))  # a row per partition and bucket at most
    before = Window.partitionBy("bucket_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket_tokens", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket_tokens", "part").orderBy(*order)
    ranked = placed.withColumn("rank", F.row_number().over(own)).join(F.broadcast(offsets), ["bucket_tokens", "part"])
    position = F.col("offset") + F.col("rank") - 1
    return ranked.select(
        F.col("id").alias(id_col), "sequence_no", "token_start", "token_end", "n_tokens", "bucket_tokens",
        F.floor(position / F.col("room")).alias("batch_no"), F.pmod(position, F.col("room")).alias("slot"),
    )
