"""Cleaning rules on rows inside and outside their thresholds, and deduplication."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clean
from textloom.plans import rules

PROSE = (
    "The old garden, which lay behind the house, was quiet because nobody had walked there for years. "
    "However, the neighbours still talked about {} and its long history. "
)


def prose(n, words=("roses", "stones", "rivers", "bridges", "lanterns", "orchards", "towers", "letters", "winters", "singers")):
    return "".join(
        f"Visitors {a} crossed seven {w} while {b} watched their {a}s; therefore everyone remembered {w}{i} and {b}{i} fondly. "
        for i, (a, b, w) in enumerate(((words[k % 10] + chr(97 + k), words[(3 * k + 1) % 10] + chr(98 + k), words[(7 * k + 2) % 10] + chr(99 + k)) for k in range(n)))
    )


def reason(spark, text, mode, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return clean.clean(df, mode, **kw).first().drop_reason


BASE = prose(10)


@pytest.mark.parametrize(
    "text, mode, expected",
    [
        (None, "basic", "non_text"),
        ("short", "basic", "too_short"),
        ("a" * 127, "basic", "too_short"),
        ("a" * 128, "basic", None),
        ("-" * 150, "basic", "low_alpha_ratio"),
        ("http " * 101 + "abc " * 100, "basic", "too_many_urls"),
        ("http " * 100 + "abc " * 100, "basic", None),
        (BASE, "broad_lm", None),
        (BASE, "curated_lm", None),
        (BASE + " http://a.example/x http://b.example/y http://c.example/z", "broad_lm", "broad_lm_url_heavy"),
        (BASE + " click here and read more", "broad_lm", "broad_lm_navigation_boilerplate"),
        (BASE + " click here only", "broad_lm", None),
        ("\n".join(["- item number one is here for all to see"] * 2 + [f"* other line {k} with several more words in it" for k in range(3)] + ["plain line of text with many words inside it"]), "broad_lm", "broad_lm_list_heavy"),
        ("\n".join(f"Chapter {k} of this long book ......... {k}" for k in range(4)), "broad_lm", "broad_lm_table_of_contents"),
        ("\n".join(f"tiny line {k}" for k in range(20)), "broad_lm", "broad_lm_fragment_heavy"),
        ("\n".join(["the very same line of eight words is here"] * 9), "broad_lm", "broad_lm_repeated_lines"),
        ("too few words in this one but still long enough to be over the limit of one hundred and twenty eight characters. Yes. No. Maybe.", "curated_lm", "curated_lm_too_few_words"),
        (BASE.replace(".", ""), "curated_lm", "curated_lm_too_few_sentences"),
        (BASE + " Watch queue queue", "curated_lm", "curated_lm_cookie_video_widget_boilerplate"),
        (BASE + " ==== ---- **** ####", "curated_lm", "curated_lm_separator_heavy"),
        (BASE + " blood disease doctor medical pain infection", "curated_lm", "curated_lm_medical_body_dense"),
        (BASE + " bloodhound diseased doctored", "curated_lm", None),
        (BASE + " copyright permalink", "curated_lm", "curated_lm_page_boilerplate"),
        (BASE + " one two three four five six." * 4, "curated_lm", "curated_lm_repeated_ngram_heavy"),
        ("Source: Book. Section: Contents page with many words that go on for a while " + BASE, "domain_lm", "domain_lm_table_of_contents"),
        ("the model " + BASE, "domain_lm", "domain_lm_synthetic_training_scaffold"),
        (BASE, "domain_lm", None),
    ],
)
def test_first_failing_rule(spark, text, mode, expected):
    assert reason(spark, text, mode) == expected


def test_normal_forms(spark):
    row = spark.sql(r"SELECT 'a\0b  c\n d' AS a, 'mail x.y@z.com or 415-555-2671 or 123-45-6789' AS b, 'A1 b-B, 22!' AS s, '12 !' AS e").select(
        T.squeeze(F.col("a")).alias("a"), T.scrub(F.col("b")).alias("b"), (T.signature(F.col("s")) == T.signature(F.lit("a b b"))).alias("s"), T.signature(F.col("e")).alias("e")
    )
    assert tuple(row.first()) == ("a b c d", "mail [EMAIL] or [PHONE] or [SSN]", True, None)


def test_ngram_signal(spark):
    df = spark.createDataFrame([("a b a b a b",), ("a",), ("",)], "t string").select(T.split_words(F.col("t")).alias("w"))
    got = [tuple(r.s) for r in df.select(rules.ngram_signal(F.col("w"), 2).alias("s")).collect()]
    assert got == [(3, 0.6), (0, 0.0), (0, 0.0)]


def test_first_wins_across_sources(spark):
    rows = [(1, "a", None, True), (2, "a", None, True), (3, "a", "too_short", True), (4, "a", None, False), (0, "a", "too_short", True), (5, "b", None, True)]
    df = spark.createDataFrame(rows, "doc_id long, document_hash string, drop_reason string, dedup boolean")
    got = {r.doc_id: r.drop_reason for r in clean.first_wins(df, ["doc_id"], dedup="dedup").collect()}
    assert got == {0: "too_short", 1: None, 2: "exact_duplicate", 3: "too_short", 4: None, 5: None}


def test_filter_mode_hook(spark):
    rules.mode_rules("basic", 1, 10)
    rules.register_filter_mode("no_x", [("has_x", F.col("text").contains("x"))])
    assert reason(spark, "ax", "no_x", min_chars=1) == "has_x" and reason(spark, "ab", "no_x", min_chars=1) is None
