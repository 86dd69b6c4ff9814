"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, keep_rows, partitions
from textloom.llm.components import connected_components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: The embedding has 32 segments of two bits, cut into so many bands.
BANDS = 4
#: Fingerprints of one grid cell that are compared with each other; fuller cells go the exact way by shared neighbours.
CELL = 128


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit number; zero where there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    bits = np.packbits((votes * 2 > n).astype(np.uint8))
    return int(bits.view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array((fingerprint(t.as_py()) for t in batch.column(1)), pa.int64(), size=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), prints], names=["id", "mark", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp) for every row; mark is a hash of the text, fp the fingerprint's 64 bits as a signed long."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"))
    return source.mapInArrow(_fingerprints, "id long, mark long, fp long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies every pair of a cell at its exact distance and passes on a spanning forest of the links."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            fps = np.array(members.as_py(), np.int64)
            linked = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= DISTANCE
            left = np.ones(len(fps), bool)
            while left.any():
                stack = [int(np.argmax(left))]
                left[stack[0]] = False
                while stack:
                    i = stack.pop()
                    new = np.flatnonzero(linked[i] & left)
                    left[new] = False
                    a += [int(fps[i])] * len(new)
                    b += fps[new].tolist()
                    stack += new.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect exactly those within DISTANCE bits.

    The embedding of a fingerprint is the popcount of each two-bit segment. The Manhattan distance of two embeddings is
    at most the Hamming distance of the fingerprints, so linked fingerprints differ by at most 2 there, hence in at most
    two of the four bands, and agree on the grid cell of at least one pair of bands. Cells of 2 to CELL members are
    compared pair by pair. The members of fuller cells are linked exactly and in linear work by what they share: two
    fingerprints are within two bits if and only if some number is within one bit of both, and at most 65
    fingerprints can share such a number.
    """
    every_other = F.lit(0x5555555555555555)
    low, high = F.col("fp").bitwiseAND(every_other), F.shiftrightunsigned("fp", 1).bitwiseAND(every_other)
    embedded = prints.select("fp", low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1)).alias("e"))
    width = 64 // BANDS
    band = [F.shiftrightunsigned("e", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BANDS)]
    cells = [
        (F.shiftleft(band[i], 40) + F.shiftleft(band[j], 8) + F.lit(k)).alias(f"c{k}")
        for k, (i, j) in enumerate(combinations(range(BANDS), BANDS - DISTANCE))
    ]
    placed = embedded.select("fp", F.explode(F.array(*cells)).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = cut(placed.join(sizes, "cell"))
    few = placed.filter(F.col("n") <= CELL).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    verified = few.select("fps").mapInArrow(_forest, "a long, b long")
    full = placed.filter(F.col("n") > CELL).select("fp").distinct()
    shared = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
    stars = full.select("fp", F.explode(shared).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
    return verified.union(stars)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, fp, component_id) for every row."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "n")
    # A fingerprint that very many rows share, such as that of blank texts, is broadcast: there are at most 4 * partitions
    # of them. The other rows are joined by a shuffle.
    many = prints.count() // (4 * partitions(docs.sparkSession)) + 1
    hot = named.filter(F.col("n") > many).select(F.col("fp").alias("hot_fp"), "component_id")
    placed = cut(prints.join(F.broadcast(hot), F.col("fp") == F.col("hot_fp"), "left").select("id", "mark", "fp", F.col("hot_fp").isNotNull().alias("hot"), F.col("component_id").alias("known")))
    rest = placed.filter("NOT hot").select("id", "mark", "fp").join(named.select("fp", "component_id"), "fp")
    return rest.select("id", "mark", "fp", "component_id").union(placed.filter("hot").select("id", "mark", "fp", "known"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 lowercase hex digits), component_id.

    Lower-cases A-Z, takes words between ASCII white space, hashes each 3-word shingle (XXH64 of UTF-8, seed 42; repeats
    count; fewer words make one shingle) and sets a bit where over half the hashes have it. Texts without a word, empty
    and null ones have fingerprint zero and are linked like any other. Fingerprints at two or fewer differing bits are
    linked, and component_id is the least id reachable (null ids are left out of the minimum). Equal fingerprints are
    first merged with partial aggregation, so the size of a group of copies does not matter. Rows that repeat are all
    returned; other columns of docs, whatever their names, are not read; no rows give no rows. Ids are longs. A very long
    text is hashed a block of shingles at a time.
    """
    found = _components(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first_of_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of their component, with all their columns; of rows that repeat an id and a
    text, one. Rows without an id stay where some row without one is in a component that has no ids at all; else they
    count as copies. Null texts are blank ones; an empty table stays empty; extra columns, whatever their names, are kept."""
    verdict = _components(docs, id_col, text_col).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return keep_rows(docs, verdict, id_col, F.xxhash64(F.coalesce(text_col, F.lit(""))))
