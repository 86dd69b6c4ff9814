"""The pipeline against a plain version of each stage on that stage's own input, and the guard of the driver entry."""

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from textloom.llm.packing import MAX_TOKENS, optimal_boundaries

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    from tests.llm.test_text_operators import slow_fingerprint, slow_hits

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    before = [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(before, docs.schema), DATA)
        assert out.columns == docs.columns
        after = sorted(tuple(r) for r in out.collect())
        assert set(after) <= set(before) and after
        if name == "exact_dedup":
            first = {}
            for r in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
            assert after == sorted(first.values())
        if name == "near_dedup":
            prints = {r[0]: slow_fingerprint(r[1]) for r in before}
            least = {i: i for i in prints}
            changed = True
            while changed:
                changed = False
                for a in prints:
                    for b in prints:
                        if bin(prints[a] ^ prints[b]).count("1") <= 2 and least[b] > least[a]:
                            least[b], changed = least[a], True
            assert [r[0] for r in after] == sorted(i for i in prints if least[i] == i)
        if name == "decontamination":
            assert [r[0] for r in after] == sorted(r[0] for r in before if not slow_hits(r[1], bench)[1])
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(before, docs.schema), DATA).collect()
    lengths = [min(MAX_TOKENS, n - a) for r in before for n in [len((r[1] or "").split())] for a in range(0, n, MAX_TOKENS)]
    assert sorted(r.n_tokens for r in packed) == sorted(lengths)
    assert {r.bucket_tokens for r in packed} <= set(optimal_boundaries({n: lengths.count(n) for n in lengths}))


def test_run_writes_every_stage_and_returns_the_last(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_library_stands_without_this_package(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for p in root.iterdir():
        if p.name not in ("textloom", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "textloom").mkdir()
    for p in (root / "textloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "textloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries())); assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    for p in (root / "textloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "textloom.llm" not in p.read_text()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def odd_documents(spark):
    """Nulls in every column, blank and very long texts, repeated rows and ids, and columns named like the operators' own."""
    texts = [None, "", " \t", "a b c", "a  b\tc", "a b c", "plain words of no interest " * 30, "x" * 50_000, "word " * 30_000, "é ü 漢字", "one two three four five six seven eight nine ten eleven"]
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None if i % 3 else "s", i, 1, 2.0, "m", None, "k") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text of the same id", "en", "s", 1, 1, 2.0, "m", None, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, id int, t double, mark string, fp string, kept_n string")


def test_stages_on_odd_and_empty_input(spark):
    docs = odd_documents(spark)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema == docs.schema or out.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert all(given.count(x) >= kept.count(x) > 0 for x in kept)
        if name == "exact_dedup":
            assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in given})
        if name in ("toxicity", "decontamination"):  # clean documents stay, repeated ones with all their rows
            assert len(kept) == len(given)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.packing(spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} == {i for i, t in given if (t or "").split()} and corpus_pipeline.packing(spark, docs.limit(0), DATA).count() == 0
