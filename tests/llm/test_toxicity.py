"""The recurrent network: gradients, held-out accuracy, odd input."""

import random

import numpy as np
import pyarrow as pa

from textloom.llm import toxicity as tx


def made(n, seed, bad):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 120))]
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scumzor", "vilegk" + rng.choice("abcde"), "fooldom"])
        out.append(" ".join(words))
    return out


def test_gradients():
    model = tx.train(made(4, 1, True), made(4, 2, False))
    words = tx.Words(pa.array(made(3, 3, True)), tx.IS_WORD)
    v = tx.Vocabulary(words)
    every = tx.Windows(np.split(v.inverse, words.first[1:-1]), len(v))
    windows = every.at(np.arange(len(every)))
    for k in model.weights:
        model.weights[k] = model.weights[k].astype(np.float64)
    x = model.inputs(v)
    loss = lambda: float(model.logits({s: model.projected(x, s) for s in "fb"}, windows[:4]).sum())
    trace = {}
    u = {s: model.projected(x, s) for s in "fb"}
    model.logits(u, windows[:4], trace)
    grads, d_u = model.backward(u, windows[:4], trace, np.ones(4))
    grads = {**grads, **{"W" + s: grads["W" + s] + x.T @ d_u[s][:-1] for s in "fb"}}
    rng = np.random.default_rng(0)
    for name in ("Wf", "Wb", "Rf", "Rb", "v", "w"):
        at = tuple(rng.integers(0, n) for n in model.weights[name].shape)
        kept, e = model.weights[name][at], 1e-2
        model.weights[name][at] = kept + e
        up = loss()
        model.weights[name][at] = kept - e
        down = loss()
        model.weights[name][at] = kept
        assert abs((up - down) / (2 * e) - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def test_scores_against_every_window_alone():
    model = tx.train(made(20, 1, True), made(20, 2, False))
    texts = ["", "a", None, " ".join(map(str, range(31))), " ".join(map(str, range(32))), " ".join(map(str, range(33))), *made(4, 5, True), "scumzor " * 50, "é ! ?"]
    got = model.scores(pa.array(texts))
    for t, score in zip(texts, got):
        words = tx.Words(pa.array([t], pa.string()), tx.IS_WORD)
        v = tx.Vocabulary(words)
        x = model.inputs(v)
        u = {side: model.projected(x, side) for side in "fb"}
        n = len(v.inverse)
        windows = [v.inverse[i : i + tx.WINDOW].tolist() for i in range(max(1, n - tx.WINDOW + 1))]
        padded = np.array([w + [len(v)] * (tx.WINDOW - len(w)) for w in windows])
        # The plain network, one window at a time.
        best = max(float(model.logits(u, padded[i : i + 1])[0]) for i in range(len(padded)))
        assert abs(score - 1 / (1 + np.exp(-best))) < 1e-5
    assert len(model.scores(pa.array([], pa.string()))) == 0


def test_held_out_accuracy_and_odd_input(spark):
    rows = [(i, t, y) for y in (0, 1) for i, t in enumerate(made(120, 10 + y, bool(y)), 1000 * y)]
    odd = [(5000, None, None), (5001, "", None), (5002, "!!!", None), (5003, "scumzor " * 4000, None), (None, "fine", None), (7, rows[7][1], None)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows + odd], "doc_id long, text string, id string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.score, r.predicted) for r in got if r.doc_id in truth and r.held_out]
    assert sum(p == y for y, _, p in held) >= 0.9 * len(held) > 20
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score == by[5002].score and by[5003].predicted == 1
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert tx.toxicity(docs.limit(0), labels).count() == 0
    assert tx.toxicity(docs, labels.limit(0)).count() == len(rows) + len(odd)
