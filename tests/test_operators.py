"""Mixing, packing, chat, retrieval, web, snapshot, evaluation, source, sink and streaming operators on small frames."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import audit, chat, evals, mixing, ranges, retrieve, snapshots, web
from textloom.sources import readers, sinks
from textloom.streaming import incremental


def test_next_fit_conserves_tokens():
    rng = random.Random(1)
    for size in (4, 7):
        docs = [(k, rng.choice([1, 2, size - 1, size, size + 1, 2 * size + 1])) for k in range(50)]
        parts = list(mixing.next_fit(iter(docs), size))
        for k, n in docs:
            assert sorted((a, b) for _, _, key, a, b in parts if key == k)[-1][1] == n
            assert sum(b - a for _, _, key, a, b in parts if key == k) == n
        fill = {}
        for w, _, _, a, b in parts:
            fill[w] = fill.get(w, 0) + b - a
        assert max(fill.values()) <= size and sorted(fill) == list(range(len(fill)))
    assert list(mixing.next_fit(iter([]), 4)) == []


def test_closed_form_equals_greedy_for_two_sources(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 2], i, rng.randint(1, 50)) for i in range(60)]
    shares = {"a": 0.7, "b": 0.3}
    greedy = mixing.schedule(pd.DataFrame(rows, columns=["source", "record", "n_tokens"]), shares)
    df = spark.createDataFrame(rows, "source string, record long, n_tokens long")
    closed = [r.record for r in mixing.closed_form_mix(df, shares, "record").orderBy("mix_key", F.desc("share"), "record").collect()]
    alive = min(greedy.index[greedy.source == s].max() for s in "ab")  # up to where the first source ends
    assert closed[: alive + 1] == greedy.record.tolist()[: alive + 1]


def test_schedule_repeats_stay_in_cap():
    rows = pd.DataFrame([("a", i, 10) for i in range(100)] + [("b", i, 10) for i in range(5)], columns=["source", "record", "n_tokens"])
    out = mixing.schedule(rows, {"a": 0.5, "b": 0.5}, repeat_cap=0.4)
    b = out[out.source == "b"]
    assert (b.epoch > 0).any() and (b.epoch > 0).sum() <= 0.4 * len(b) and (out.source == "a").sum() == 100


def test_pack_windows_and_rebuild(spark):
    docs = [(i, "s", ["t"] * n) for i, n in enumerate([1, 0, 5, 12, 3])]
    df = spark.createDataFrame(docs, "doc_id long, source string, ids array<string>")
    parts = mixing.pack_windows(df.withColumn("n", F.size("ids")), "doc_id", "n", 6)
    rows = mixing.window_rows(parts, df, "doc_id", F.col("ids"), "</s>", "<pad>", 6, "source").collect()
    assert all(len(r.ids) == 6 for r in rows)
    assert sum(x == "</s>" for r in rows for x in r.ids) == 4  # the last window of record 3 holds its end mark alone and is left out
    one = parts.orderBy("window", "part").collect()
    many = mixing.pack_windows(spark.range(20).select(F.col("id").alias("doc_id"), F.lit(4).alias("n")), "doc_id", "n", 6, shards=3).collect()
    held = lambda ps: {(p.record, p.token_start, p.token_end) for p in ps}
    assert held(one) >= {(3, 0, 6), (3, 6, 12)} and len({p.shard for p in many}) > 1


def test_budget_prefix_matches_running_sum(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 9)) for i in range(200)]
    kept = {r.i for r in mixing.budget_prefix(spark.createDataFrame(rows, "i long, n long"), ["i"], "n", 100).collect()}
    total, expected = 0, set()
    for i, n in rows:
        if total < 100:
            expected.add(i)
        total += n
    assert kept == expected


def test_planner():
    available = {"constructive_direct": 220, "clarifying_question": 48, "informative_abstention": 8, "hard_refusal": 0}
    total = chat.plan_total(available)
    quotas = chat.plan_quotas(available, total)
    assert sum(quotas.values()) == total <= 276 and all(quotas[b] <= available[b] for b in quotas)
    assert quotas["constructive_direct"] >= 96 and quotas["clarifying_question"] == 48
    assert chat.plan_total({"a": 10, "b": 5}) == 15
    assert chat.holdout_target(25, 0.1) == 2 and chat.holdout_target(3, 0.1, 1) == 1


def test_chat_columns(spark):
    rows = [(1, 0, "user", "Hi  there"), (1, 1, "assistant", "Tell me more?"), (2, 0, "user", "hi there"), (2, 1, "assistant", None), (3, 0, "user", "Hi there")]
    m = chat.gather(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in m.select("conv_id", chat.signature(F.col("messages")).alias("s"), chat.bucket_of(chat.last_answer(F.col("messages"))).alias("b"), chat.encode_labels(F.col("messages"), 20).alias("e")).collect()}
    assert got[1].s == got[3].s != got[2].s
    assert [got[i].b for i in (1, 2, 3)] == ["clarifying_question", "hard_refusal", "hard_refusal"]
    assert got[1].e["ids"] == ["<|user|>", "Hi", "there", "</s>", "<|assistant|>", "Tell", "me", "more?", "</s>"] and got[1].e["labels"][-4:] == ["Tell", "me", "more?", "</s>"]
    bad = spark.createDataFrame([(1, 0, "robot", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="unknown role"):
        chat.gather(bad).select(chat.render(F.col("messages"))).collect()
    sig = m.select(chat.signature(F.col("messages")).alias("s"))
    with pytest.raises(ValueError):
        chat.assert_no_leaks(sig, sig.limit(1), "s")


def test_grouped_split_keeps_groups_whole(spark):
    rows = [(g, i) for g, n in enumerate([1, 2, 10, 3, 4]) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long")
    got = chat.grouped_split(df, "g", 0.25, 7).groupBy("g").agg(F.countDistinct("is_validation").alias("n"), F.first("is_validation").alias("v")).collect()
    assert all(r.n == 1 for r in got) and 0 < sum(r.v for r in got) < len(got)
    with pytest.raises(ValueError):
        chat.grouped_split(df.filter("g = 2"), "g", 0.25, 7)


def slow_windows(text, target, enough, overlap, least):
    import re

    runs, run = [], []
    size = lambda r: sum(len(s.split()) for s in r)
    for s in [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]:
        if run and size(run) + len(s.split()) > target and size(run) >= enough:
            runs.append(run)
            tail = [run[-1]]
            for x in reversed(run[:-1]):
                if size(tail) + len(x.split()) > overlap:
                    break
                tail.insert(0, x)
            run = tail
        run = [*run, s]
    return [" ".join(r) for r in [*runs, *([run] if size(run) >= least else [])]]


def test_sentence_windows(spark):
    rng = random.Random(4)
    texts = [" ".join(" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(0, 40))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = retrieve.sentence_windows(df, "doc_id", target=22, enough=12, overlap=5, least=8).orderBy("doc_id", "chunk_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.chunk)
    assert [by.get(i, []) for i in range(20)] == [slow_windows(t, 22, 12, 5, 8) for t in texts]


def test_retrieval_gates(spark):
    chunks = spark.createDataFrame([("c1", "Solar panels turn sunlight into power for Berlin"), ("c2", "Wind turbines turn moving air into power"), ("c3", "Nothing shared")], "chunk_id string, text string")
    index = retrieve.build_index(chunks)
    ask = lambda text, **kw: [r.chunk_id for r in retrieve.retrieve(spark.createDataFrame([(1, text)], "query_id long, query string"), index, **kw).orderBy("rank").collect()]
    assert ask("solar power") == ["c1", "c2"] and ask("the of and") == [] and ask("solar power", min_matched=2) == ["c1"]
    assert ask("power Berlin", names=True) == ["c1"] and ask("power Paris", names=True) == [] and ask("turn power", margin=9.0) == [] and ask("power", k=1) in (["c1"], ["c2"])


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><script>var x='</p>';</script></head><body><h2>One</h2><main><p>x &lt; y</p><ul><li>i<li>j</ul></main></body></html>"
    row = spark.createDataFrame([(1, "http://s.example/courses/2024-25", page)], "page_id long, url string, html string")
    r = row.select(web.title(F.col("html")).alias("t"), web.headings(F.col("html")).alias("h"), web.to_text(web.main_content(F.col("html"))).alias("x"), web.page_type(F.col("url")).alias("k"), web.school_year(F.col("url")).alias("y"), web.unescape(F.lit("&eacute;")).alias("u")).first()
    assert tuple(r) == ("A & B", ["One"], "x < y\ni j", "course_catalog", "2024-25", "é")
    got = spark.range(1).select(web.line_chunks(F.lit("aaa\nbbb\n" + "c" * 20 + "\nd"), 8).alias("c")).first().c
    assert got == ["aaa\nbbb", "c" * 20, "d"]
    pages = spark.createDataFrame([(1, '<script type="application/json">{"a": {"b": 1}, "c": [{"d": 2}]}</script>')], "page_id long, html string")
    assert [json.loads(r.object) for r in web.page_objects(pages).orderBy("object_no").collect()][1:] == [{"b": 1}, {"d": 2}]


def test_snapshots(spark):
    a = spark.createDataFrame([("u1", "1"), ("u2", "2"), ("u3", "3")], "url string, h string")
    b = spark.createDataFrame([("u2", "2"), ("u3", "x"), ("u4", "4")], "url string, h string")
    assert dict(snapshots.compare(a, b, "url", "h").collect()) == {"u1": "removed", "u2": "unchanged", "u3": "changed", "u4": "added"}
    assert sorted(map(tuple, snapshots.upsert(a, b, ["url"]).collect())) == [("u1", "1"), ("u2", "2"), ("u3", "x"), ("u4", "4")]
    s = spark.createDataFrame([("a", "2024-01-01", True, False), ("b", "2024-02-01", True, False), ("c", "2024-03-01", False, True)], "id string, created_at string, completed boolean, current boolean")
    assert snapshots.resolve(s).first().id == "b"
    pages = spark.createDataFrame([(1, "http://x/faculty", "<p>a</p>"), (2, "http://x/other", "<p>b</p>")], "page_id long, url string, html string")
    docs = web.documents_of(pages, "s1")
    moved, parts = snapshots.carry_forward(docs, web.chunks_of(docs), "s1", "s2", ["faculty"])
    assert [r.snapshot_id for r in moved.collect()] == ["s2"] and parts.join(moved.select(F.col("id").alias("document_id")), "document_id").count() == 1
    r = snapshots.route(spark.createDataFrame([("Who teaches art?",), ("xyzzy",)], "question string")).collect()
    assert (r[0].route, r[0].score, r[0].low_confidence) == ("faculty", 4, True) and (r[1].route, r[1].low_confidence) == ("chat", False)


def test_evaluation(spark):
    rows = [(1, "wow wow wow wow then calm"), (2, ""), (3, "A clear answer is given here. It ends."), (4, None), (5, "!!! ..."), (6, "a-b-c-d-e-f good"), (7, "Copyright 2020 site")]
    got = {r.i: r for r in evals.generation_quality(spark.createDataFrame(rows, "i long, t string"), "t").collect()}
    assert got[1].reasons == ["repeated_token_burst"] and not got[1].degenerate and got[1].repeated_token_run == 4
    assert got[2].reasons == ["blank_output", "too_short_no_content"] == got[4].reasons and got[2].degenerate
    assert got[3].reasons == [] and "punctuation_only" in got[5].reasons and got[6].reasons == ["hyphen_letter_garbage"] and got[7].reasons == ["copyright_date_residue"]
    asked = spark.createDataFrame([("What colour is the northern lighthouse?", "The lighthouse is red and white.", "It is red and white, the lighthouse of the north."), ("What colour is the northern lighthouse?", "Bananas grow quickly there.", "Nothing relevant whatsoever")], "p string, r string, c string")
    found = [r.reasons for r in evals.generation_quality(asked, "r", "p", "c", grounded=True).collect()]
    assert found == [["low_prompt_retention"], ["ignores_provided_context", "prompt_not_reflected", "low_prompt_retention"]]
    gates = evals.release_gates(spark.createDataFrame([("x", 0.5)], "name string, value double"), spark.createDataFrame([("x", "min", 0.5), ("x", "max", 0.4), ("y", "min", 0.0)], "name string, kind string, threshold double"))
    assert sorted((r.name, r.kind, r.passed) for r in gates.collect()) == [("x", "max", False), ("x", "min", True), ("y", "min", False)]
    score = lambda t, **kw: spark.range(1).select(evals.assistant_score(F.lit(t), F.array(F.lit("yes"), F.lit("no")), F.array(F.lit("bad")), F.lit(True), **kw).alias("s")).first().s
    assert score("Yes [source: x]") == 1.0 and score("yes no") == 0.5 and score("yes no bad") == 0.0 and score("yes no [source: x]", reference=F.lit("yes no [source: x]")) == 2.5
    e = spark.sql("SELECT array('a', 'b') AS x, cast(array() as array<string>) AS n")
    one = lambda t, a, b, x: e.select(evals.exact_score(F.lit(t), F.col(a), F.col(b), F.lit(x)).alias("s")).first().s
    assert one("A B", "x", "n", False) and not one("A", "x", "n", False) and one("A", "n", "x", False) and one("I don't know", "x", "n", True) and not one(" ", "n", "n", False)


def test_water_filling():
    got = audit.allocate(100, {"a": 0.5, "b": 0.5}, {"a": 20.0, "b": 200.0})
    assert got == {"a": 20.0, "b": 80.0}
    assert sum(audit.allocate(100, {"a": 0.5, "b": 0.5}, {"a": 20.0, "b": 30.0}).values()) == 50.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\nthree\n")
    spec = readers.SourceSpec("s", [str(tmp_path / "a.txt")], skip_records=1, max_records=2)
    assert [r.text for r in readers.read(spark, spec).collect()] == ["two", ""]
    assert readers.advanced(spec, 1).skip_records == 2 and readers.advanced(spec, 5).max_records == 0
    (tmp_path / "b.jsonl").write_text('{"text": "x", "id": 7}\n{"other": 1}\n')
    got = readers.read(spark, readers.SourceSpec("j", [str(tmp_path / "b.jsonl")], format="jsonl", id_field="id")).collect()
    assert [(r.text, r.document_id) for r in got] == [("x", "7"), (None, None)]
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "c.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("text", pa.string())])) as w:
        w.write_table(pa.table({"text": ["p", "q"]}))
    assert sorted(r.text for r in readers.read(spark, readers.SourceSpec("a", [str(tmp_path / "c.arrow")], format="arrow")).collect()) == ["p", "q"]
    df = spark.range(25).select(F.col("id").alias("i"), F.lit(2).alias("n"))
    placed = sinks.with_shards(df, ["i"], 10)
    assert {(r.i, r.shard_index, r.row_index) for r in placed.collect()} == {(i, i // 10, i % 10) for i in range(25)}
    folder, config = str(tmp_path / "out"), {"a": 1}
    assert sinks.resolve_target(spark, folder, "packed", config) == "fresh"
    manifest = sinks.write_prepared(placed, folder, "packed", config, 10, "n")
    assert manifest["num_sequences"] == 25 and manifest["num_tokens"] == 50 and sinks.validate(spark, folder, "packed") == []
    assert sinks.resolve_target(spark, folder, "packed", config) == "reuse" and sinks.read_prepared(spark, folder, "packed").count() == 25
    with pytest.raises(ValueError):
        sinks.resolve_target(spark, folder, "packed", {"a": 2})
    assert sinks.validate(spark, folder, "sft") == ["kind is packed"]
    capped = readers.dual_cap(spark.createDataFrame([(i, "x" * 9) for i in range(10)], "i long, t string"), "i", "t", 8, 25)
    assert sorted(r.i for r in capped.collect()) == [0, 1, 2]


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(i, f"document number {i % 7} " + "word " * 40) for i in range(a, b)], "doc_id long, text string")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows(0, 5).write.parquet(source)
    for more in (None, rows(5, 20)):
        if more is not None:
            more.write.mode("append").parquet(source)
        stream = incremental.distinct_documents(incremental.document_stream(spark, source, "doc_id long, text string"))
        incremental.run_available(stream, out, state, ["doc_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 7 == rows(0, 20).select(T.document_hash(T.squeeze(F.col("text")))).distinct().count()


def test_allocation_shares_out_what_targets_leave():
    # The source without a target takes what is left once the others are full.
    assert audit.allocate(100, {"a": 0.5, "b": 0.5, "c": 0.0}, {"a": 20.0, "b": 30.0, "c": 70.0}) == {"a": 20.0, "b": 30.0, "c": 50.0}
    assert audit.allocate(100, {"a": 0.5, "b": 0.5, "c": 0.0}, {"a": 20.0, "b": 30.0, "c": 10.0})["c"] == 10.0
    # Within a pass the second source sees what the first one left.
    assert audit.allocate(100, {"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 44.0}) == {"a": 10.0, "b": 44.0}


def test_running_sums_over_ranges(spark):
    # A third of all rows share one key, and ties stand in their full order.
    rows = [(i, 5 if i % 3 == 0 else i, i % 7, "g" if i % 2 else "h") for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k long, v long, grp string")
    got = {r.i: r.before for r in ranges.running(df, ["k", "i"], "v", "before").collect()}
    expected, total = {}, 0
    for i, k, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        expected[i], total = total, total + v
    assert got == expected
    own = {r.i: r.n for r in ranges.ranked(df, ["k", "i"], "n", ["grp"]).collect()}
    for g in "gh":
        order = sorted((k, i) for i, k, _, x in rows if x == g)
        assert [own[i] for _, i in order] == list(range(len(order)))
    assert ranges.ranked(df.limit(0), ["i"], "n").count() == 0


def test_restarts_pass_over_what_other_sources_gave():
    rows = pd.DataFrame([("a", 0, 10, "x"), ("a", 1, 10, "y"), ("b", 0, 10, "x"), ("b", 1, 10, "z"), ("b", 2, 10, "w"), ("b", 3, 10, "v"), ("b", 4, 10, "u")], columns=["source", "record", "n_tokens", "key"])
    out = mixing.schedule(rows, {"a": 0.5, "b": 0.5}, repeat_cap=0.5)
    given = out.merge(rows, on=["source", "record"])
    # b's copy of x is never given, and only a, which ended first, repeats its own.
    assert not ((given.source == "b") & (given.key == "x")).any()
    assert set(given[given.epoch > 0].source) <= {"a"} and set(given.key) == set("xyzwvu")
    plain = mixing.schedule(rows.drop(columns="key"), {"a": 0.5, "b": 0.5})
    assert len(plain) == 7


def test_capped_mix_against_plain_rules(spark):
    """Every step of the mix is the one that the rules name, recomputed from what was given before."""
    rng = random.Random(5)
    rows = [(s, k, rng.randint(1, 40)) for s, n in (("a", 60), ("b", 25), ("c", 8)) for k in range(n)]
    df = spark.createDataFrame(rows, "source string, record long, n_tokens long")
    target = {"a": 0.2, "b": 0.5, "c": 0.3}
    out = sorted(mixing.capped_mix(df, target, "record", max_share=0.6, budget=200).collect(), key=lambda r: r.mix_order)
    assert sorted((r.source, r.record) for r in out) == sorted((s, k) for s, k, _ in rows)
    left, got = {s: [k for x, k, _ in rows if x == s] for s in target}, dict.fromkeys(target, 0)
    for r in out:
        total = sum(got.values())
        ready = [s for s in target if left[s]]
        share = lambda s: got[s] / total if total else 0.0
        free = [s for s in ready if not (total >= 200 and total and share(s) > 0.6 and any(got[x] < got[s] for x in ready if x != s))] or ready
        assert r.source == max(free, key=lambda s: (target[s] - share(s), -share(s) / target[s], target[s], -got[s])) and r.record == left[r.source].pop(0)
        got[r.source] += r.n_tokens


def test_file_order_over_several_files(spark, tmp_path):
    # The largest file comes last by name, so tasks read it first.
    for name, n in (("a", 3), ("b", 5), ("c", 4000)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {k}\n" for k in range(n)))
    spec = readers.SourceSpec("s", [str(tmp_path)], skip_records=2, max_records=8)
    got = readers.read(spark, spec).orderBy(*readers.ORDER)
    assert [r.text for r in got.collect()] == ["a 2", "b 0", "b 1", "b 2", "b 3", "b 4", "c 0", "c 1"]


def test_targets_and_progress(spark, tmp_path):
    folder, config = f"file://{tmp_path}/out", {"a": 1}
    assert sinks.resolve_target(spark, folder, "sft", config) == "fresh"
    sinks.save_progress(spark, folder, "sft", config, {"consumed": 5})
    assert sinks.resolve_target(spark, folder, "sft", config) == "resume" and sinks.load_progress(spark, folder)["consumed"] == 5
    with pytest.raises(ValueError):
        sinks.resolve_target(spark, folder, "sft", {"a": 2})
    rows = sinks.with_shards(spark.range(7).withColumnRenamed("id", "k"), ["k"], 3)
    sinks.write_prepared(rows, folder, "sft", config, 3)
    assert sinks.resolve_target(spark, folder, "sft", config) == "reuse" and sinks.read_prepared(spark, folder, "sft").count() == 7


def test_retrieval_in_blocks_with_a_single_hit(spark, monkeypatch):
    rows = [(f"c{k:03}", f"Berlin tower {'stone ' * (k % 7)}bridge{k % 5} walk") for k in range(90)] + [("x", "lone " + "river " * 300)]
    index = retrieve.build_index(spark.createDataFrame(rows, "chunk_id string, text string").repartition(3))
    asked = spark.createDataFrame([(1, "stone bridge3 Berlin"), (2, "lone"), (3, "tower walk"), (4, "the of")], "query_id long, query string")
    found = lambda **kw: sorted(map(tuple, retrieve.retrieve(asked, index, 4, names=True, **kw).collect()))
    pairs = {(r.query_id, r.chunk_id): r for r in retrieve.candidates(asked, index, names=True).collect() if r.n_named >= r.wanted}
    whole = found()
    monkeypatch.setattr(retrieve, "CELLS", 1)
    assert found() == whole
    for q in (1, 2, 3):
        best = sorted((-r.score, c) for (i, c), r in pairs.items() if i == q)[:4]
        assert [(-s, c) for i, c, s, *_ in sorted(whole, key=lambda r: (r[0], r[-1])) if i == q] == best
    # The only hit stays however low its score is.
    assert [r[:2] for r in found(margin=0.5) if r[0] == 2] == [(2, "x")] and [r for r in whole if r[0] == 2][0][2] < 0.5
    plan = retrieve.retrieve(asked, index, 4)._jdf.queryExecution().toString()
    assert "Join" not in plan
