"""Queries that have no SQL, on their whole inputs, against brute force on the smallest tables."""

import difflib
import math
import re
from collections import Counter

import pandas as pd

from textloom import queries as Q
from textloom.operators import audit, snapshots
from textloom.plans import lists as L
from textloom.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def terms(text):
    found = (t.strip("'-") for t in re.findall(r"[a-z][a-z0-9'-]{1,}", text.lower()))
    return [t for t in found if t and t not in L.RETRIEVAL_STOPWORDS]


def test_retrieve_topk(spark):
    chunks = {r.chunk_id: Counter(terms(r.chunk)) for r in Q._chunks(spark, DATA).collect()}
    df = Counter(t for c in chunks.values() for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 0.5)) + 1 for t, n in df.items()}
    expected, longer = {}, 0
    for item in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        asked = Counter(terms(item.text))
        longer += len(item.text.split()) > 12
        scores = []
        for i, c in chunks.items():
            met = [t for t in asked if t in c]
            if len(met) >= min(2, max(len(asked), 1)):
                s = sum((1 + math.log(asked[t])) * (1 + math.log1p(c[t])) * c[t] / max(sum(c.values()), 1) * idf[t] for t in met)
                scores.append((-round((0.5 + len(met) / len(asked)) * s, 6), i, len(met), len(asked)))
        for rank, (score, i, matched, n) in enumerate(sorted(scores)[:5], 1):
            expected[item.item_id, rank] = (i, matched, n, -score)
    got = {(r.query_id, r.rank): (r.chunk_id, r.matched, r.query_terms, r.score) for r in QUERIES["retrieve_topk"](spark, DATA).collect()}
    assert longer and got.keys() == expected.keys()
    assert all(got[k][:3] == expected[k][:3] and abs(got[k][3] - expected[k][3]) < 2e-6 for k in got)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    best = {}
    for (q, _), (i, _, _, score) in got.items():
        at = (q, source[int(i.split("-")[0])])
        best[at] = max(best.get(at, 0.0), score)
    matrix = QUERIES["query_source_matrix"](spark, DATA).collect()
    assert {(r.query_id, s): r[s] for r in matrix for s in matrix[0].asDict() if s != "query_id" and r[s] is not None} == best


def test_hidden_pattern_families(spark):
    planted = [(k, f"Some prose. {phrases[-1].upper()} and more.") for k, phrases in enumerate(L.HIDDEN_PATTERNS.values())]
    planted += [(100, None), (101, ""), (102, "nothing of the kind")]
    assert len(L.HIDDEN_PATTERNS) == 21
    got = {r.family: (r.documents, [(e.id, e.matched) for e in r.examples]) for r in audit.pattern_examples(spark.createDataFrame(planted, "doc_id long, text string"), "doc_id").collect()}
    expected = {}
    for family, phrases in L.HIDDEN_PATTERNS.items():
        met = [(i, [p for p in phrases if p in (t or "").lower()][:8]) for i, t in planted if any(p in (t or "").lower() for p in phrases)]
        expected[family] = (len(met), met[:5])
    assert len(expected) == 21 and got == expected
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    counts = {f: n for f, phrases in L.HIDDEN_PATTERNS.items() if (n := sum(any(p in (d.text or "").lower() for p in phrases) for d in docs))}
    assert {r.family: r.documents for r in QUERIES["hidden_pattern_families"](spark, DATA).collect()} == counts


def brute_search(queries, rows, fuzzy):
    words = lambda t: {w for w in re.split("[^a-z0-9]+", t.lower()) if w}
    out = set()
    for i, query in queries:
        q, scores = query.strip(" ").lower(), []
        for j, hay in rows:
            h = hay.lower()
            s = (8.0 if q and q in h else 0.0) + 1.5 * len(words(q) & words(h))
            if fuzzy and len(q) >= 5 and h:
                s += difflib.SequenceMatcher(None, q, h[: max(2 * len(q), 32)]).ratio()
            if round(s, 6) > 0:
                scores.append((-round(s, 6), j))
        out |= {(i, j, -s, k) for k, (s, j) in enumerate(sorted(scores)[:5], 1)}
    return out


def test_ranked_search(spark):
    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.item_id % 100 == 0]
    docs = [(r.doc_id, " ".join(x for x in (r.text, r.source) if x is not None)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert any(len(t.split()) > 6 for _, t in items)
    assert set(map(tuple, QUERIES["ranked_search"](spark, DATA).collect())) == brute_search(items, docs, False)


def test_ranked_search_fuzzy_takes_whole_titles_of_every_hundredth_page(spark, tmp_path):
    title = lambda k: f"Report {k % 7} on the harbour of town {k % 13} and its {k % 5} bridges"
    rows = [(k, f"<title>{title(k)}</title>") for k in range(250)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = set(map(tuple, QUERIES["ranked_search_fuzzy"](spark, str(tmp_path)).collect()))
    pages = [(k, title(k)) for k in range(250)]
    assert got == brute_search([pages[0], pages[100], pages[200]], pages, True)


def test_ranked_search_in_blocks(spark):
    queries = [(k, f"town {k} bridge {k % 3}") for k in range(20)]
    rows = [(k, f"the bridge {k % 4} of town {k % 17}") for k in range(40)]
    q, r = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(rows, "id long, text string")
    got = snapshots.ranked_search(q, r, ["text"], "id", block_bytes=700).collect()
    assert set(map(tuple, got)) == brute_search(queries, rows, False)


def test_similar_search_compares_only_what_can_matter(spark, monkeypatch):
    word = lambda k: ["harbour", "bridge", "tower", "garden", "of", "naïve", "Ĳssel"][k % 7]
    rows = [(k, " ".join(word(k * j + j // 2) for j in range(1, 2 + k % 9))) for k in range(400)] + [(400, ""), (401, None)]
    queries = [(0, rows[8][1]), (1, "bridges"), (2, "gard"), (3, "zzzzzz"), (4, None), (5, " Tower of "), (6, "")]
    compared = spark.sparkContext.accumulator(0)

    class Counted(difflib.SequenceMatcher):
        def __init__(self, *given):
            compared.add(1)
            super().__init__(*given)

    monkeypatch.setattr(snapshots, "PAIRS_AT_ONCE", 900)
    frames = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(rows, "id long, text string").repartition(3)
    expected = brute_search([q for q in queries if q[1] is not None], [(i, t or "") for i, t in rows], True)
    assert set(map(tuple, snapshots.ranked_search(*frames, ["text"], "id", fuzzy=True).collect())) == expected
    shared = type("Shared", (), {"value": [(i, q.strip(" ").lower()) for i, q in queries if q is not None]})
    monkeypatch.setattr(difflib, "SequenceMatcher", Counted)
    list(snapshots._best_similar(shared, 5)([pd.DataFrame([(i, (t or "").lower()) for i, t in rows], columns=["id", "hay"])]))
    assert 0 < compared.value < 4 * len(rows) // 2


def shared_addresses(spark, path):
    """Pages of which some share an address: copies, other texts, an empty one. (query) -> its rows and those of its SQL."""
    import duckdb

    from textloom.catalogue import ORACLES

    page = lambda *sizes: "<title>T</title><main>" + "".join(f"<p>{'ab ' * (n // 3)}{'c' * (n % 3 or 3)}</p>" for n in sizes) + "</main>"
    rows = [(0, "http://x/a", page(200, 250, 300, 40)), (4, "http://x/a", page(200, 250, 300, 40)), (7, "http://x/a", page(200, 250, 300, 40)), (1, "http://x/b", page(300, 180, 499, 3)), (2, "http://x/b", page(90, 600, 7))]
    rows += [(3, "http://x/c", page(10, 700, 10)), (5, "http://x/d", ""), (6, "http://x/d", page(20)), (8, "http://x/e", page(400, 90)), (9, "http://x/team", page(30)), (12, "http://x/team", page(600, 600))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet/*.parquet')")

    def both(name):
        got = QUERIES[name](spark, str(path))
        con.execute(f"CREATE OR REPLACE TABLE o AS {ORACLES[name]}")
        return sorted(map(tuple, got.collect())), sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM o").fetchall())

    return both


def test_line_chunks_of_pages_that_share_an_address(spark, tmp_path):
    got, expected = shared_addresses(spark, tmp_path)("line_chunks_500")
    assert got == expected and len({r[:2] for r in got}) == len(got)


def test_carried_documents_that_share_an_address(spark, tmp_path):
    got, expected = shared_addresses(spark, tmp_path)("carried_documents")
    assert got == expected and len(got) == 9


def test_family_metrics_of_pages_that_share_an_address(spark, tmp_path):
    got, expected = shared_addresses(spark, tmp_path)("family_metrics")
    assert got == expected and len(got) == 2


def test_family_metrics_of_pages_without_an_address(spark, tmp_path):
    import duckdb

    from textloom.catalogue import ORACLES

    page = lambda *sizes: "<main>" + "".join(f"<p>{'a' * n}</p>" for n in sizes) + "</main>"
    rows = [(0, None, page(300, 300, 300)), (1, None, page(400, 400)), (2, "", page(300, 250)), (3, "http://x/team", page(20)), (4, "http://x/a", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    con.execute(f"CREATE TABLE o AS {ORACLES['family_metrics']}")
    got = QUERIES["family_metrics"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM o").fetchall()) == [("athletics", True, 1, 1), ("general", True, 4, 2)]


def test_snapshot_sync_of_pages_that_share_an_address(spark, tmp_path):
    got, expected = shared_addresses(spark, tmp_path)("snapshot_sync")
    assert got == expected and len(got) == 3


def test_benchmark_scores_of_repeated_and_cited_texts(spark, tmp_path):
    import duckdb

    from textloom.catalogue import ORACLES

    texts = ["the and and and and and", "the and ! ! ! ! ! !", "The [source: x] and", "the</s> and", "How can I help today, the and", "the idiot and", "The end", None, ""]
    rows = [(k, 1, "assistant", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["benchmark_scores"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["benchmark_scores"]).fetchall())


def test_context_cut_between_two_texts(spark):
    from textloom.operators import retrieve

    first = "ab " * 6 + "cd"
    hits = spark.createDataFrame([(q, r, t) for q in range(4) for r, t in ((1, first + "x" * q), (2, "more text"))], "query_id long, rank int, text string")
    got = dict(map(tuple, retrieve.context(hits, 22).collect()))
    assert got == {0: first, 1: first + "x", 2: "ab ab ab ab ab ab", 3: "ab ab ab ab ab ab"}
