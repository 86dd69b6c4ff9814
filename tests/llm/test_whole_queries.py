"""The driver queries that have no SQL, over whole tables, against plain versions of what they do."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from textloom.llm import pii, quality, secret_scan, toxicity
from textloom.llm.html_extraction import extract
from textloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def rows(spark, name, data=DATA):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def ranks(y, s):
    """Area under the curve."""
    good, bad = [a for a, k in zip(s, y) if k], [a for a, k in zip(s, y) if not k]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_op2_candidates_against_a_plain_search(spark):
    pattern = regex.compile(secret_scan.PATTERN)
    data = "/root/testdata/sf0.01"  # the smallest tables hold none
    expected = {(r.doc_id, m.start(), m.end()) for r in rows(spark, "documents", data) for m in pattern.finditer(r.text or "")}
    got = QUERIES["op2_secret_scan"](spark, data).collect()
    assert {(r.doc_id, r.start, r.finish) for r in got} == expected and len(got) == len(expected) > 0
    texts = {r.doc_id: r.text for r in rows(spark, "documents", data)}
    # What is planted there is a random value with a name; the forest leaves it.
    planted = [r for r in got if re.fullmatch(r'(?i)token = "[0-9a-f]{40}"', texts[r.doc_id][r.start : r.finish])]
    assert planted and sum(r.is_secret for r in planted) >= 0.9 * len(planted)


def test_op3_against_a_plain_loop(spark):
    expected = sorted((p.page_id, p.url, extract(p.html)) for p in rows(spark, "pages"))
    got = QUERIES["op3_html_extraction"](spark, DATA).collect()
    assert sorted((r.page_id, r.url, r.text) for r in got) == expected and all(r.n_chars == len(r.text) for r in got)
    # The article of these pages is marked: its blocks, and nothing else, are the text.
    for p, (_, _, text) in zip(sorted(rows(spark, "pages"), key=lambda r: (r.page_id, r.url)), expected):
        inside = re.search(r"(?s)<article>(.*?)</article>", p.html)[1]
        plain = [" ".join(regex.sub(r"&\w+;|&#\d+;", lambda m: __import__("html").unescape(m[0]), re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)[^>]*>", inside)]
        assert text == "\n".join(b for b in plain if b)


def test_op5_against_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(*toxicity.labelled_sample(docs, labels, "toxic", 4, 2))
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, DATA).collect()}
    table = rows(spark, "documents")
    assert len(got) == len(table)
    for r in table:
        score = float(model.scores(pa.array([r.text], pa.string()))[0])
        assert abs(got[r.doc_id].score - score) < 1e-5 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op8_against_a_plain_loop(spark):
    field = pii.train(pii.training_texts(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text"))
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, DATA).collect()}
    for r in rows(spark, "documents"):
        base = pii.base_spans(r.text or "")
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(len(pii.KINDS))]
        assert got[r.doc_id].spans == pii.joined(base + field.added(r.text or "", base))


def test_op9_against_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    good, bad = toxicity.labelled_sample(docs, labels, "quality", 5, 0, rows=quality.SAMPLE_ROWS, chars=quality.SAMPLE_CHARS)
    known = [r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    model = quality.train(good, bad, (sum(k == 1 for k in known), sum(k == 0 for k in known)))
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, DATA).collect()}
    for r in rows(spark, "documents"):
        assert abs(got[r.doc_id].score - model.score(r.text)) < 1e-9 and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize("name, label, least", [("op5_toxicity", "toxic", 0.75), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.score) for r in QUERIES[name](spark, data).filter("held_out").collect() if r.doc_id in truth]
    assert len(held) > 50 and ranks(*np.array(held).T) >= least
