"""Quality: the difference of a text's compressed sizes under dictionaries of good and of bad text, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fold_of, slices
from textloom.llm.toxicity import labelled_sample

DICTIONARY_BYTES = 96 << 10
#: A text is compressed in pieces of so many bytes, each with the dictionary afresh, so that all of a long text counts.
PIECE = 2048
LEVEL = 3
#: The bounded training sample: labelled rows of each class, and their longest length.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
THRESHOLD = 0.3


def _dictionary(texts: list[str]) -> bytes:
    samples = [b[i : i + PIECE] for t in texts if (b := t.encode("utf-8", "replace")) for i in range(0, len(b), PIECE)]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self._use = None

    def __getstate__(self):
        return (self.good, self.bad, self.slope, self.offset)

    def __setstate__(self, state):
        self.good, self.bad, self.slope, self.offset = state
        self._use = None

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / their sum; zero for an empty text."""
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0
        if self._use is None:
            self._use = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
                if d
                else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
                for d in (self.good, self.bad)
            ]
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self._use)
        return (bad - good) / (bad + good)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.difference(text) + self.offset))))


def train(good: list[str], bad: list[str], labelled: tuple[int, int] | None = None) -> Model:
    """Half of each class builds the dictionaries; the other half fits the logistic curve, each class weighing as much
    as its share of all labelled rows (good and bad), of which the texts may be a sample of other shares. Without texts
    of both classes the score is the share of good ones, or one half."""
    n_good, n_bad = labelled or (len(good), len(bad))
    if not good or not bad:
        share = (n_good + 1) / (n_good + n_bad + 2)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]))
    x = np.array([model.difference(t) for t in good[1::2] + bad[1::2]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    weight = np.array([n_good / len(good)] * len(good[1::2]) + [n_bad / len(bad)] * len(bad[1::2]))
    weight /= max(weight.mean(), 1e-12) if len(weight) else 1.0
    scale = max(float(np.abs(x).max(initial=0)), 1e-6)
    a, b = 0.0, 0.0
    z = x / scale
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (p - y) * z).sum() + 0.01 * a, (weight * (p - y)).sum() + 0.01 * b])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    model.slope, model.offset = float(a / scale), float(b)
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Learns from a bounded sample of labelled rows (labels: doc_id, quality) outside the held-out fold, which is crc32 of
    the id as text modulo modulus. Whole texts are compressed, piece by piece. Null and empty texts have difference zero
    and its calibrated score. Ids are longs; rows that repeat are scored alike; null ids are kept; an empty table gives no
    rows; other columns, whatever their names, are not read. A very long text takes time in proportion.
    """
    good, bad = labelled_sample(docs, labels, "quality", modulus, held_out, id_col, text_col, SAMPLE_ROWS, SAMPLE_CHARS)
    known = labels.filter(fold_of(F.col("doc_id"), modulus) != held_out).agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).head()
    model = docs.sparkSession.sparkContext.broadcast(train(good, bad, tuple(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                scores = pa.array([model.value.score(x.as_py()) for x in piece.column(1)], pa.float64())
                yield pa.RecordBatch.from_arrays([piece.column(0), scores], names=["id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
