"""Benchmark decontamination by winnowed fingerprints with exact extension of every hit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, slices
from textloom.llm.words import Words, grams

#: Words of a window; k-grams and the winnowing window that guarantee each shared span of SPAN words: SPAN = GRAM + WINNOW - 1.
SPAN, GRAM, WINNOW = 10, 5, 6
#: Bytes of benchmark text of one block (about six bytes are held for each, so 50 MB in a worker), and blocks that are
#: applied in one pass over the documents, before the rows are written and read again for the next ones.
BLOCK_BYTES, BLOCKS_AT_ONCE = 8 << 20, 4

IS_WORD = np.ones(256, bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False


def winnowed(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: of each window of WINNOW k-grams of one row the first least k-gram.

    Which k-gram of a window is taken depends on the window's words alone, so equal windows share their fingerprint.
    """
    g = grams(hashes, GRAM)
    n = len(g) - WINNOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, first = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINNOW):
        less = g[j : j + n] < least
        least[less], first[less] = g[j : j + n][less], j
    inside = words.doc[:n] == words.doc[SPAN - 1 : SPAN - 1 + n]
    chosen = np.zeros(len(g), bool)
    chosen[(np.arange(n) + first)[inside]] = True
    at = np.flatnonzero(chosen)
    return at, g[at]


class BenchmarkBlock:
    """Items as arrays: fingerprints, and for each size of window the distinct windows' hashes, where one of each stands
    and which items hold it. Everything is proportional to the items' words, however often they repeat."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = Words(pa.array(texts, pa.large_string()), IS_WORD)
        hashes = words.hashes()
        self.ids = ids
        self.data = words.data
        self.starts, self.ends = words.starts.astype(np.int32), words.ends.astype(np.int32)
        self.prints = np.unique(winnowed(words, hashes)[1])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(int(n), SPAN) for n in words.counts if n}):
            g = grams(hashes, size)
            at = np.flatnonzero(words.doc[: len(g)] == words.doc[size - 1 :])
            if size < SPAN:  # only items of just that size
                at = at[words.counts[words.doc[at]] == size]
            else:
                at = at[words.counts[words.doc[at]] >= SPAN]
            # One entry for each window and item: equal hashes side by side, within them items in order.
            order = np.lexsort((words.doc[at], g[at]))
            at = at[order]
            h, item = g[at], words.doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
            at, h, item = at[new], h[new], item[new]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            self.windows[size] = (h[first], np.append(first, len(h)).astype(np.int32), at.astype(np.int32), item.astype(np.int32))

    def nbytes(self) -> int:
        """Bytes that the block holds."""
        return sum(x.nbytes for x in (self.data, self.starts, self.ends, self.prints)) + sum(x.nbytes for own in self.windows.values() for x in own)

    def _word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hits(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Row -> (half-open word spans that occurrences of windows cover, indices of their items).

        A fingerprint that a row shares with the items is extended to every window of SPAN words around it, so a row's
        work is proportional to its words; what a hash finds is compared word by word.
        """
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        hashes = words.hashes()
        for size, (known, first, places, items) in self.windows.items():
            g = grams(hashes, size)
            if size < SPAN:
                at = np.flatnonzero(words.doc[: len(g)] == words.doc[size - 1 :]) if len(g) else np.zeros(0, np.int64)
            else:
                prints, h = winnowed(words, hashes)
                prints = prints[_member(h, self.prints)]
                at = np.unique((prints[:, None] - np.arange(WINNOW)).ravel())
                at = at[(at >= 0) & (at < len(g))]
                at = at[words.doc[at] == words.doc[at + size - 1]]
            at = at[_member(g[at], known)]
            group = np.searchsorted(known, g[at]).tolist()
            parts: dict[int, list[bytes]] = {}
            met: set[tuple[int, int]] = set()
            for p, k in zip(at.tolist(), group):
                if k not in parts:
                    i = int(places[first[k]])
                    parts[k] = [self._word(i + j) for j in range(size)]
                if any(words.word(p + j) != w for j, w in enumerate(parts[k])):
                    continue
                row = int(words.doc[p])
                spans, own = found.setdefault(row, ([], set()))
                a = p - int(words.first[row])
                if spans and spans[-1][0] <= a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], a + size))
                else:
                    spans.append((a, a + size))
                if (row, k) not in met:
                    met.add((row, k))
                    own.update(items[first[k] : first[k + 1]].tolist())
        return found


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = pa.schema(
    [("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))]
)
_SO_FAR = pa.schema([("id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
_SO_FAR_SQL = "id long, text string, spans array<long>, items array<long>"


def _result(rows, n_words, spans, items) -> pa.RecordBatch:
    spans = [_merged(list(zip(x[::2], x[1::2]))) for x in spans]
    items = [sorted(set(x), key=str) for x in items]
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in items]
    hit = [sum(b - a for a, b in x) for x in spans]
    columns = [rows, n_words, hit, list(map(len, items)), digests, [n > 0 for n in hit], [[e for x in y for e in x] for y in spans], items]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def _finder(block, last: bool):
    """Matches rows (id, text, and what earlier blocks have found in them) with a broadcast block; last: no other follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for batch in batches:
            for piece in slices(batch, 1):
                words = Words(piece.column(1), IS_WORD)
                hits = own.hits(words)
                spans, items = (piece.column(k).to_pylist() for k in (2, 3)) if piece.num_columns > 2 else ([[] for _ in range(piece.num_rows)] for _ in range(2))
                for i, (new, met) in hits.items():
                    spans[i] = spans[i] + [e for x in new for e in x]
                    items[i] = items[i] + [own.ids[k] for k in met]
                if last:
                    yield _result(piece.column(0), words.counts, spans, items)
                else:
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(spans, _SO_FAR[2].type), pa.array(items, _SO_FAR[3].type)], schema=_SO_FAR)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list[int], list[str | None]]]:
    """The benchmark, partition by partition through the driver, in blocks of bounded size."""
    ids, texts, total = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL").toLocalIterator():
        n = len((r.t or "").encode("utf-8", "replace"))
        if total and total + n > limit:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        total += n
    yield ids, texts


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    A-Z are lower-cased and words are runs of letters a-z, digits and non-ASCII characters. A window is SPAN consecutive
    words of an item, or the whole of an item with fewer words. The least k-gram hash of each winnowing window is a
    fingerprint; documents' fingerprints are joined with the items' and each match is extended to the windows around it,
    which are compared word by word, so every shared span of SPAN words is found and hash collisions are thrown out.
    Shorter items are found by a hash of the whole item. spans are the covered words (begin, end, begin, end ...), items
    the ids found. Texts and items of one repeated word take time in proportion to their length.

    The benchmark is the stated query set: each worker holds blocks of at most block_bytes of its text (a longer item is a
    block of its own). BLOCKS_AT_ONCE of them are applied to a row one after the other, without a shuffle; after so many
    the rows are written with what was found and read again, and the driver takes the next ones.

    Texts that are null or empty have no words; items without words or id match nothing; an empty benchmark hits nothing;
    an empty table gives no rows. Ids are longs; null ids are kept; repeated rows each get their row; other columns of
    docs, whatever their names, are not read. Very long texts are read in whole, one at a time.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "row long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>, items array<long>"
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    held = list(islice(blocks, BLOCKS_AT_ONCE + 1))
    while held:
        now, held = held[:BLOCKS_AT_ONCE], held[BLOCKS_AT_ONCE:]
        shared = [spark.sparkContext.broadcast(BenchmarkBlock(*b)) for b in now]
        for k, b in enumerate(shared):
            last = not held and k == len(shared) - 1
            out = out.mapInArrow(_finder(b, last), schema if last else _SO_FAR_SQL)
        if held:
            out = cut(out)
            for b in shared:
                b.destroy()
            held += list(islice(blocks, BLOCKS_AT_ONCE))
    return out.withColumnRenamed("row", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit, all columns kept; the verdict is taken row by row, without a shuffle.

    For a benchmark of several blocks each block filters what the one before it has left. Null and empty texts and rows
    without an id stay; an empty benchmark drops nothing; repeated rows stay or go alike; an empty table stays empty.
    """
    spark = docs.sparkSession
    index = docs.columns.index(text_col)

    def filtering(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, index):
                    hits = block.value.hits(Words(piece.column(index), IS_WORD))
                    yield piece.filter(pa.array([i not in hits for i in range(piece.num_rows)], pa.bool_()))

        return run

    blocks = _blocks(benchmark, "item_id", "text", block_bytes)
    while now := list(islice(blocks, BLOCKS_AT_ONCE)):
        for b in now:
            docs = docs.mapInArrow(filtering(spark.sparkContext.broadcast(BenchmarkBlock(*b))), docs.schema)
        if len(now) == BLOCKS_AT_ONCE:
            docs = cut(docs)
    return docs
