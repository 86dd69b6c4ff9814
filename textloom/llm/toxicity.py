"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import fold_of, slices
from textloom.llm.decontamination import IS_WORD
from textloom.llm.words import _BYTE_VALUES, Words, mixed

#: Words of a window; every window of a text is scored.
WINDOW = 32
HIDDEN, EMBEDDING = 8, 4
#: Buckets (as a power of two) of the word and of the character n-gram tables, and n.
BUCKETS = 18
GRAMS = (3, 4, 5)
#: The bounded training sample: labelled rows of each class, taken by a hash of the id, of at most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 10_000
#: Passes over the sample: EPOCHS, or as many as give STEPS steps.
EPOCHS, STEPS, BATCH, RATE = 5, 200, 64, 0.01
THRESHOLD = 0.3
_START, _END = 0x5E, 0x24  # word marks; neither is a byte of a word
_INPUTS = 2 * EMBEDDING + 3
#: Windows that are taken through the network at once.
_CHUNK = 2048
#: Text that a worker scores at once: small, since two workers share an executor with its JVM.
_SLICE = 1 << 20


class Vocabulary:
    """The distinct words of some texts: buckets of the words and of their character n-grams."""

    def __init__(self, words: Words):
        hashes, at, self.inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.inverse = self.inverse.astype(np.int32)
        self.word = (hashes >> np.uint64(64 - BUCKETS)).astype(np.int64)
        starts = words.starts[at]
        self.lengths = words.ends[at] - starts
        marked = self.lengths + 2
        ends = np.cumsum(marked)
        begins = ends - marked
        flat = np.full(int(marked.sum()), _END, np.uint8)
        flat[begins] = _START
        owner = np.repeat(np.arange(len(at)), self.lengths)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        flat[begins[owner] + 1 + inner] = words.data[starts[owner] + inner]
        of = np.repeat(np.arange(len(at), dtype=np.int32), marked)
        values = _BYTE_VALUES[flat]
        grams, owners = [], []
        for n in GRAMS:
            k = max(0, len(flat) - n + 1)
            h = np.zeros(k, np.uint64)
            for j in range(n):
                h = h * np.uint64(0xD1342543DE82EF95) + values[j : j + k]
            inside = of[:k] == of[n - 1 :] if k else np.zeros(0, bool)
            grams.append((mixed(h[inside] + np.uint64(n)) >> np.uint64(64 - BUCKETS)).astype(np.int32))
            owners.append(of[:k][inside])
            del h, inside
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.grams, self.owners = grams[order], owners[order]
        self.gram_first = np.searchsorted(self.owners, np.arange(len(at)))
        self.gram_counts = np.diff(np.append(self.gram_first, len(self.owners)))

    def __len__(self) -> int:
        return len(self.word)


class Windows:
    """All windows of some rows: numbers is one row of word numbers, each text followed by pads up to WINDOW words at
    least; begins, slots: each text's place there; starts: how many windows of a text begin there, one at least."""

    def __init__(self, texts: list[np.ndarray], pad: int):
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.slots = np.maximum(counts, WINDOW)
        self.begins = np.cumsum(self.slots) - self.slots
        self.starts = np.maximum(counts - WINDOW, 0) + 1
        self.numbers = np.full(int(self.slots.sum()) + WINDOW - 1, pad, np.int32)
        at = np.repeat(self.begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        if len(at):
            self.numbers[at] = np.concatenate(texts)
        self.pad = pad

    def __len__(self) -> int:
        return int(self.slots.sum())

    def at(self, starts: np.ndarray) -> np.ndarray:
        """The word numbers of the windows at some places."""
        return self.numbers[starts[:, None] + np.arange(WINDOW)]

    def best(self, strength: np.ndarray) -> np.ndarray:
        """The place of each text's strongest window."""
        place = np.arange(len(self)) - np.repeat(self.begins, self.slots)
        strength = np.where(place < np.repeat(self.starts, self.slots), strength, -np.inf)
        return np.array([a + int(np.argmax(strength[a : a + n])) for a, n in zip(self.begins.tolist(), self.starts.tolist())], np.int64)

    def strongest(self, strength: np.ndarray) -> np.ndarray:
        """The strength of each text's strongest window."""
        place = np.arange(len(self)) - np.repeat(self.begins, self.slots)
        strength = np.where(place < np.repeat(self.starts, self.slots), strength, -np.inf)
        return np.maximum.reduceat(strength, self.begins) if len(self.begins) else strength


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Standardised log ratio of document frequencies, squashed."""
    toxic, clean = np.maximum(toxic, 0) + 0.5, np.maximum(clean, 0) + 0.5
    z = (np.log(toxic / (max(n_toxic, 0) + 1)) - np.log(clean / (max(n_clean, 0) + 1))) / np.sqrt(1 / toxic + 1 / clean)
    return np.tanh(z / 3).astype(np.float32)


@dataclass
class Model:
    """word_evidence, gram_evidence by bucket; word_vectors, gram_vectors: learned embeddings; the rest: weights by name."""

    word_evidence: np.ndarray
    gram_evidence: np.ndarray
    word_vectors: np.ndarray
    gram_vectors: np.ndarray
    weights: dict[str, np.ndarray]

    def inputs(self, v: Vocabulary, word_evidence=None, gram_evidence=None) -> np.ndarray:
        """The character and word inputs of each distinct word."""
        x = np.zeros((len(v), _INPUTS), np.float32)
        if len(v):
            own = (self.gram_evidence if gram_evidence is None else gram_evidence)[v.grams]
            x[:, 0] = (self.word_evidence if word_evidence is None else word_evidence)[v.word]
            x[:, 1] = np.maximum.reduceat(own, v.gram_first)
            x[:, 2] = np.add.reduceat(own, v.gram_first) / v.gram_counts
            x[:, 3 : 3 + EMBEDDING] = self.word_vectors[v.word & (len(self.word_vectors) - 1)]
            vectors = self.gram_vectors[v.grams & (len(self.gram_vectors) - 1)]
            x[:, 3 + EMBEDDING :] = np.add.reduceat(vectors, v.gram_first, axis=0) / v.gram_counts[:, None]
        return x

    def projected(self, x: np.ndarray, side: str) -> np.ndarray:
        """Input parts of the gates; the last row is the pad, whose update gate keeps the state."""
        u = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        u[:-1] = x @ self.weights["W" + side] + self.weights["b" + side]
        u[-1, HIDDEN : 2 * HIDDEN] = 30
        return u

    def logits(self, u: dict[str, np.ndarray], windows: np.ndarray, trace: dict | None = None) -> np.ndarray:
        n = len(windows)
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h, lo = np.zeros((n, HIDDEN), np.float32), 0 if side == "f" else HIDDEN
            recurrent = self.weights["R" + side]
            for t in order:
                g = u[side][windows[:, t]]
                s = h @ recurrent
                gates = 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])) + 0.5
                r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                if trace is not None:
                    trace[side, t] = (h, r, z, c, s[:, 2 * HIDDEN :])
                h = c + z * (h - c)
                states[t, :, lo : lo + HIDDEN] = h
        pad = windows.T == len(u["f"]) - 1
        a = states @ self.weights["v"] - 1e9 * pad
        a -= a.max(axis=0)
        a = np.exp(a)
        a /= a.sum(axis=0)
        context = np.einsum("tn,tnh->nh", a, states)
        if trace is not None:
            trace["states"], trace["a"], trace["context"] = states, a, context
        return context @ self.weights["w"] + self.weights["c"][0]

    def backward(self, u: dict[str, np.ndarray], windows: np.ndarray, trace: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the weights, and of the projected inputs of each side."""
        w = self.weights
        grads = {k: np.zeros_like(x) for k, x in w.items()}
        states, a, context = trace["states"], trace["a"], trace["context"]
        grads["w"], grads["c"] = context.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_context = d_logit[:, None] * w["w"]
        d_a = np.einsum("nh,tnh->tn", d_context, states)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        grads["v"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = a[:, :, None] * d_context + d_score[:, :, None] * w["v"]
        d_u = {}
        for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            lo = 0 if side == "f" else HIDDEN
            d_u[side] = np.zeros_like(u[side])
            d_h = np.zeros((len(windows), HIDDEN), np.float32)
            for t in order:
                d_h = d_h + d_states[t, :, lo : lo + HIDDEN]
                h, r, z, c, s = trace[side, t]
                d_c = d_h * (1 - z) * (1 - c * c)
                d_z = d_h * (h - c) * z * (1 - z)
                d_r = d_c * s * r * (1 - r)
                d_s = np.concatenate([d_r, d_z, d_c * r], axis=1)
                np.add.at(d_u[side], windows[:, t], np.concatenate([d_r, d_z, d_c], axis=1))
                grads["R" + side] += h.T @ d_s
                d_h = d_h * z + d_s @ w["R" + side].T
            d_u[side][-1] = 0
        return grads, d_u

    def all_logits(self, u: dict[str, np.ndarray], windows: Windows) -> np.ndarray:
        """The logit of the window at every place, as logits gives it. Neighbouring windows are neighbouring columns, so a
        step of the network reads a stretch of the text's inputs as they stand; attention is summed up on the way."""
        n_all, w = len(windows), self.weights
        real = (windows.numbers != windows.pad).astype(np.float32)
        half = np.ones((3 * HIDDEN, 1), np.float32)
        half[: 2 * HIDDEN] = 0.5  # a sigmoid is half a hyperbolic tangent of half
        inputs = {s: np.ascontiguousarray((u[s].T * half)[:, windows.numbers], np.float32) for s in "fb"}
        recurrent = {s: np.ascontiguousarray(w["R" + s].T * half, np.float32) for s in "fb"}
        heads = {s: np.stack([w["v"][k * HIDDEN : (k + 1) * HIDDEN], w["w"][k * HIDDEN : (k + 1) * HIDDEN]]).astype(np.float32) for k, s in enumerate("fb")}
        out = np.empty(n_all, np.float32)
        for i in range(0, n_all, _CHUNK):
            n = min(_CHUNK, n_all - i)
            seen = np.empty((WINDOW, 2, n), np.float32)
            value, weight, state = np.zeros(n, np.float32), np.zeros(n, np.float32), np.empty((3 * HIDDEN, n), np.float32)
            for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
                h = np.zeros((HIDDEN, n), np.float32)
                for t in order:
                    g = inputs[side][:, i + t : i + t + n]
                    np.matmul(recurrent[side], h, out=state)
                    gates, c = state[: 2 * HIDDEN], state[2 * HIDDEN :]
                    gates += g[: 2 * HIDDEN]
                    np.tanh(gates, out=gates)
                    gates += 1
                    gates *= 0.5
                    c *= gates[:HIDDEN]
                    c += g[2 * HIDDEN :]
                    np.tanh(c, out=c)
                    h -= c
                    h *= gates[HIDDEN:]
                    h += c
                    if side == "f":
                        np.matmul(heads[side], h, out=seen[t])
                        continue
                    both = heads[side] @ h
                    both += seen[t]
                    e = np.exp(both[0])
                    e *= real[i + t : i + t + n]
                    weight += e
                    e *= both[1]
                    value += e
            out[i : i + n] = value / np.maximum(weight, 1e-30)
        return out + w["c"][0]

    def scores(self, column: pa.Array) -> np.ndarray:
        """A score for each row: of all its windows, the one most likely toxic decides."""
        words = Words(column, IS_WORD)
        if not len(words.counts):
            return np.zeros(0)
        v = Vocabulary(words)
        x = self.inputs(v)
        windows = Windows(np.split(v.inverse, words.first[1:-1]), len(v))
        logits = self.all_logits({side: self.projected(x, side) for side in "fb"}, windows)
        return 1 / (1 + np.exp(-windows.strongest(logits.astype(np.float64))))


def train(toxic: list[str], clean: list[str], seed: int = 1) -> Model:
    """Learns from labelled texts. A text is the sum of its windows only in that the most toxic window decides, so each
    step takes the gradient through that window. A training text's own words do not count as evidence for it."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    sides = []
    counts = {}
    for k, texts in enumerate((toxic, clean)):
        words = Words(pa.array(texts, pa.large_string()), IS_WORD)
        v = Vocabulary(words)
        docs = np.unique(words.doc.astype(np.int64) * len(v) + v.inverse) if len(v) else np.zeros(0, np.int64)
        doc, number = (docs // max(len(v), 1), docs % max(len(v), 1))
        counts["word", k] = np.bincount(v.word[number], minlength=1 << BUCKETS)
        counts["gram", k] = np.zeros(1 << BUCKETS, np.int64)
        for start in range(0, len(texts), 32):  # some texts at a time, or the pairs of text and n-gram take much memory
            a, b = np.searchsorted(doc, (start, start + 32))
            reps = v.gram_counts[number[a:b]]
            at = np.repeat(v.gram_first[number[a:b]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            pairs = np.unique(np.repeat(doc[a:b], reps) << BUCKETS | v.grams[at].astype(np.int64))
            counts["gram", k] += np.bincount(pairs & ((1 << BUCKETS) - 1), minlength=1 << BUCKETS)
        sides.append((words, v))
    n = (len(toxic), len(clean))
    tables = {kind: [_evidence(counts[kind, 0] - a, counts[kind, 1] - b, n[0] - a, n[1] - b) for a, b in ((1, 0), (0, 1), (0, 0))] for kind in ("word", "gram")}
    weights = {"v": small(2 * HIDDEN), "w": small(2 * HIDDEN), "c": np.array([-1], np.float32)}
    for side in "fb":
        weights["W" + side], weights["R" + side], weights["b" + side] = small(_INPUTS, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    model = Model(tables["word"][2], tables["gram"][2], small(1 << 14, EMBEDDING) * 0.1, small(1 << 14, EMBEDDING) * 0.1, weights)
    items = [(k, own) for k, (words, v) in enumerate(sides) if len(words.counts) for own in np.split(v.inverse, words.first[1:-1])]  # (class, words of one text)
    if not items:
        return model
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in weights.items()}
    scale = {"word": np.full(len(model.word_vectors), 1e-6, np.float32), "gram": np.full(len(model.gram_vectors), 1e-6, np.float32)}
    balance = [0.5 * len(items) / max(x, 1) for x in n]
    step = 0
    parts = max(1, len(items) // BATCH)
    for epoch in range(max(EPOCHS, -(-STEPS // parts))):
        for part in np.array_split(rng.permutation(len(items)), parts):
            step += 1
            total = {k: np.zeros_like(x) for k, x in weights.items()}
            for k, (_, v) in enumerate(sides):
                own = [items[i][1] for i in part if items[i][0] == k]
                if not own:
                    continue
                # only the words that occur in this step
                used, numbers = np.unique(np.concatenate(own), return_inverse=True)
                sub = _Part(v, used)
                windows = Windows(np.split(numbers, np.cumsum([len(x) for x in own])[:-1]), len(used))
                x = model.inputs(sub, tables["word"][k], tables["gram"][k])
                u = {side: model.projected(x, side) for side in "fb"}
                if epoch == 0 and k == 0:
                    evidence = np.append(np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0), 0).astype(np.float64)[windows.numbers]
                    total_evidence = np.append(0, np.cumsum(evidence))
                    strength = total_evidence[WINDOW:] - total_evidence[:-WINDOW]
                else:
                    strength = model.all_logits(u, windows)
                chosen = windows.at(windows.best(strength))
                trace: dict = {}
                logit = model.logits(u, chosen, trace)
                error = (1 / (1 + np.exp(-logit)) - (1 - k)) * balance[k] / len(part)
                grads, d_u = model.backward(u, chosen, trace, error.astype(np.float32))
                d_x = np.zeros_like(x)
                for side in "fb":
                    grads["W" + side] += x.T @ d_u[side][:-1]
                    grads["b" + side] += d_u[side][:-1].sum(axis=0)
                    d_x += d_u[side][:-1] @ weights["W" + side].T
                for name, g in grads.items():
                    total[name] += g
                _nudge(model.word_vectors, scale["word"], sub.word, d_x[:, 3 : 3 + EMBEDDING])
                _nudge(model.gram_vectors, scale["gram"], sub.grams, (d_x[:, 3 + EMBEDDING :] / np.maximum(sub.gram_counts, 1)[:, None])[sub.owners])
            for name, x in weights.items():
                m, s = moments[name]
                m += 0.1 * (total[name] - m)
                s += 0.01 * (total[name] ** 2 - s)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return model


class _Part:
    """Some of a vocabulary's words."""

    def __init__(self, v: Vocabulary, numbers: np.ndarray):
        self.word = v.word[numbers]
        self.gram_counts = v.gram_counts[numbers]
        self.gram_first = np.cumsum(self.gram_counts) - self.gram_counts
        self.owners = np.repeat(np.arange(len(numbers)), self.gram_counts)
        self.grams = v.grams[np.repeat(v.gram_first[numbers] - self.gram_first, self.gram_counts) + np.arange(len(self.owners))] if len(numbers) else v.grams[:0]

    def __len__(self) -> int:
        return len(self.word)


def _nudge(table: np.ndarray, scale: np.ndarray, buckets: np.ndarray, gradient: np.ndarray) -> None:
    """One step of a hashed embedding with a rate by row."""
    rows, inverse = np.unique(buckets & (len(table) - 1), return_inverse=True)
    g = np.zeros((len(rows), table.shape[1]), np.float32)
    np.add.at(g, inverse, gradient)
    scale[rows] += (g**2).sum(axis=1)
    table[rows] -= 0.05 * g / np.sqrt(scale[rows])[:, None]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Texts labelled 1 and 0, at most so many rows of each and so long, from folds other than the held-out one. The ids
    are chosen from the labels alone, so no join moves the documents; of ids that repeat, rows are taken up to the bound."""
    allowed = labels.select(F.col("doc_id").alias("i"), F.col(label).alias("y")).filter(fold_of(F.col("i"), modulus) != held_out)
    picked = None
    for k in (1, 0):
        own = allowed.filter(F.col("y") == k).groupBy("i", "y").agg(F.lit(1)).select("i", "y").orderBy(F.xxhash64("i"), "i").limit(rows)
        picked = own if picked is None else picked.union(own)
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.length("t") <= chars)
    found = short.join(F.broadcast(picked), F.col("id") == F.col("i")).select("y", "i", "t")
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i", F.xxhash64("t")))
    got = sorted((r["i"], r["y"], r["t"]) for r in found.withColumn("n", first).filter(F.col("n") <= rows).collect())
    return [t for _, k, t in got if k == 1], [t for _, k, t in got if k == 0]


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, _SLICE):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.value.scores(piece.column(1)))], names=["id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Trains on a bounded sample of labelled rows (labels: doc_id, toxic) outside the held-out fold, which is crc32 of the
    id as text modulo modulus, and scores every window of WINDOW words of every whole text; the strongest decides. Null
    and empty texts and texts without a word get the score of an empty window. Without labels of both classes the scores
    are those of an untrained network. Ids are longs; rows that repeat are scored alike; null ids are kept; an empty table
    gives no rows; other columns, whatever their names, are not read. A very long text takes time and memory in
    proportion, one text at a time.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "toxic", modulus, held_out, id_col, text_col)))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(_scorer(model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, all columns kept; row by row, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "toxic", 4, 2, id_col, text_col)))
    index = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, index, _SLICE):
                yield piece.filter(pa.array(model.value.scores(piece.column(index)) < threshold))

    return docs.mapInArrow(run, docs.schema)
