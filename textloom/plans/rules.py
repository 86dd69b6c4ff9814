"""Ordered reason chains: the first rule that holds names why a document is dropped.

Rules are pairs (reason, condition) over the metric columns that with_metrics adds. They are folded into one CASE, so a
costly condition is only evaluated for rows that every cheaper one before it let through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans import lists as L

Rules = Sequence[tuple[str, Column]]
c = F.col

#: Filter modes that a source may name; more can be registered.
MODES: dict[str, Rules] = {}


def first_reason(rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    for reason, condition in reversed(list(rules)):
        out = F.when(condition, reason).otherwise(out)
    return out


def register_filter_mode(name: str, rules: Rules) -> None:
    """Adds a mode: its rules follow the global ones."""
    MODES[name] = rules


def lines_of(raw: Column) -> Column:
    trimmed = F.transform(F.split(raw, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def with_metrics(df: DataFrame, text: str = "text", raw: str = "raw") -> DataFrame:
    """Adds the columns that rules read: lower-cased text, words, lines and counts."""
    low = F.lower(c(text))
    df = df.withColumns({"low": low, "raw_low": F.lower(c(raw)), "n_split": T.count_split_words(c(text)), "words": T.letter_words(low), "lines": lines_of(c(raw))})
    return df.withColumns(
        {
            "n_words": F.size("words"),
            "n_sentences": T.count_sentences(c(text)),
            "n_urls": F.regexp_count(c(text), F.lit(T.URL)),
            "n_lines": F.size("lines"),
        }
    )


def line_shape() -> Rules:
    matching = lambda pattern: F.size(F.filter("lines", lambda x: x.rlike(pattern)))
    enough = c("n_lines") >= 4
    bullets, labels, toc = matching(L.BULLET_LINE), matching(L.LABEL_LINE), matching(L.TOC_LINE)
    short = F.size(F.filter("lines", lambda x: F.size(F.split(x, r"(?U)\s+")) <= 6))
    share = lambda n: T.ratio(n, c("n_lines"))
    return [
        ("broad_lm_table_of_contents", enough & (toc >= 3)),
        ("broad_lm_list_heavy", enough & (bullets >= 4) & (share(bullets) >= 0.45)),
        ("broad_lm_metadata_heavy", enough & (labels >= 3) & (share(labels) >= 0.25)),
        ("broad_lm_fragment_heavy", enough & (short >= 6) & (share(short) >= 0.6)),
        ("broad_lm_repeated_lines", (c("n_lines") >= 8) & (1 - share(F.size(F.array_distinct("lines"))) >= 0.35)),
    ]


def global_rules(min_chars: int, max_chars: int) -> Rules:
    size = F.length("text")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return [
        ("too_short", size < min_chars),
        ("too_long", size > max_chars),
        ("empty", size == 0),
        ("low_alpha_ratio", T.ratio(letters, size) < 0.2),
        ("too_many_urls", T.occurrences(c("text"), "http") > 100),
    ]


def broad_rules() -> Rules:
    return [
        ("broad_lm_url_heavy", (c("n_urls") >= 3) | (T.ratio(c("n_urls"), c("n_split")) > 0.015)),
        ("broad_lm_navigation_boilerplate", T.count_containing(c("low"), L.BOILERPLATE_PHRASES) >= 2),
        *line_shape(),
        ("broad_lm_metadata_heavy", F.regexp_count("low", F.lit("(?U)" + L.METADATA_WORDS)) >= 8),
    ]


def ngram_signal(words: Column, n: int) -> Column:
    """(max_count, extra): how often the most frequent n-gram occurs, and the share of occurrences beyond each first.

    One fold over the sorted n-grams gives both; words should be a column, not an expression.
    """
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("different"), F.lit(0).alias("n"))

    def step(s: Column, g: Column) -> Column:
        again = (g == s["last"]) & (s["run"] > 0)
        run = F.when(again, s["run"] + 1).otherwise(1)
        return F.struct(
            g.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"), (s["different"] + F.when(again, 0).otherwise(1)).alias("different"), (s["n"] + 1).alias("n")
        )

    return F.aggregate(
        F.array_sort(T.ngrams(words, n)), start, step, lambda s: F.struct(s["best"].alias("max_count"), T.ratio(s["n"] - s["different"], s["n"]).alias("extra"))
    )


def pipe_menu() -> Column:
    pipes = F.length("raw") - F.length(F.translate("raw", "|", ""))
    names = "|".join(L.CATEGORY_NAMES)
    chain = rf"(?iU)\b(?:{names})\b(?:\s*\|\s*\b(?:{names})\b){{3,}}"
    segments = F.filter(F.transform(F.split("raw", r"\|"), T.squeeze), lambda s: s != "")
    short = F.size(F.filter(segments, lambda s: F.regexp_count(s, F.lit(T.LETTER_WORD)).between(1, 4)))
    many = (F.instr("raw", "|") - 1 <= 450) & (F.size(segments) >= 5) & (pipes >= 6)
    return (pipes >= 4) & (c("raw").rlike(chain) | many & (T.ratio(short, F.size(segments)) >= 0.6) & (T.ratio(pipes, c("n_words")) > 0.01))


def prose_score() -> Column:
    average = T.ratio(c("n_words"), c("n_sentences"))
    signs = [
        c("n_sentences") >= 5,
        (average >= 9) & (average <= 34),
        T.contains_any([c("low")], L.DISCOURSE_MARKERS),
        c("text").rlike("[,;:]"),
        T.ratio(F.size(F.array_distinct("words")), c("n_words")) >= 0.38,
    ]
    return sum((s.cast("int") for s in signs), F.lit(0))


def diagnostics(df: DataFrame) -> DataFrame:
    """The 25 metrics of each document that the rules look at, over the columns of with_metrics, and the line rule that
    holds first."""
    density = lambda n: T.ratio(n, c("n_words"))
    df = df.withColumns({f"s{n}": ngram_signal(c("words"), n) for n in (5, 8)})
    terms = {"medical_terms": L.MEDICAL_TERMS, "product_terms": L.PRODUCT_TERMS, "dictionary_terms": L.DICTIONARY_TERMS, "page_terms": L.PAGE_TERMS}
    df = df.withColumns({k: T.count_terms(c("low"), v) for k, v in terms.items()})
    strike = lambda column, sign: F.length(column) - F.length(F.translate(column, sign, ""))
    return df.withColumns(
        {
            "chars": F.length("text"), "split_words": c("n_split"), "sentences": c("n_sentences"), "questions": strike("text", "?"), "urls": c("n_urls"),
            "separators": F.regexp_count("raw", F.lit(L.SEPARATORS)), "pipes": strike("raw", "|"), "max_5": c("s5.max_count"), "max_8": c("s8.max_count"), "prose_score": prose_score(),
            "sentence_words": T.ratio(c("n_words"), c("n_sentences")), "distinct_ratio": T.ratio(F.size(F.array_distinct("words")), c("n_words")),
            "alpha_ratio": T.ratio(F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.length("text")), "url_density": density(c("n_urls")), "medical_density": density(c("medical_terms")),
            "product_density": density(c("product_terms")), "page_density": density(c("page_terms")), "extra_5": c("s5.extra"), "extra_8": c("s8.extra"), "line_reason": first_reason(line_shape()),
        }
    ).withColumns({"words": c("n_words"), "lines": c("n_lines")})


def curated_rules() -> Rules:
    both = [c("low"), c("raw_low")]
    density = lambda n: T.ratio(n, c("n_words"))
    packed = T.compact(F.concat_ws(" ", "text", "raw"))
    average = T.ratio(c("n_words"), c("n_sentences"))
    questions = F.length("text") - F.length(F.translate("text", "?", ""))
    separators = F.regexp_count("raw", F.lit(L.SEPARATORS))
    medical, product, page, entries = (T.count_terms(c("low"), t) for t in (L.MEDICAL_TERMS, L.PRODUCT_TERMS, L.PAGE_TERMS, L.DICTIONARY_TERMS))
    repeats = F.exists(
        F.array(*[F.struct(ngram_signal(c("words"), n).alias("s"), F.lit(most).alias("most"), F.lit(share).alias("share")) for n, most, share in ((5, 4, 0.06), (8, 3, 0.035))]),
        lambda x: (x["s"]["max_count"] >= x["most"]) | (x["s"]["extra"] > x["share"]),
    )
    return [
        *broad_rules(),
        ("curated_lm_familysearch_wiki_boilerplate", T.contains_any([packed], L.COMPACT_WIKI)),
        ("curated_lm_html_archive_boilerplate", T.contains_any(both, L.HTML_ARCHIVE)),
        ("curated_lm_science_fair_encyclopedia", T.contains_any(both, L.SCIENCE_FAIR)),
        ("curated_lm_dictionary_or_encyclopedia_fragment", T.contains_any(both, L.LOOKUP_FRAGMENTS)),
        ("curated_lm_cookie_video_widget_boilerplate", T.contains_any(both, L.COOKIE_VIDEO)),
        ("curated_lm_product_commercial_dense", T.contains_any(both, L.PRODUCT_WIDGETS)),
        ("curated_lm_newsletter_or_source_tagline", T.contains_any(both, L.TAGLINES)),
        ("curated_lm_question_list_or_seo_fragments", T.contains_any(both, L.SEO_FRAGMENTS)),
        ("curated_lm_residual_web_boilerplate", T.contains_any(both, L.RESIDUAL_WEB)),
        ("curated_lm_category_menu_boilerplate", pipe_menu()),
        ("curated_lm_too_few_words", c("n_words") < 80),
        ("curated_lm_too_few_sentences", c("n_sentences") < 3),
        (
            "curated_lm_question_list_or_seo_fragments",
            (questions >= 5) & (F.regexp_count("low", F.lit("(?U)" + L.QUESTION_STARTS)) >= 4) & (T.ratio(questions, c("n_sentences")) >= 0.35),
        ),
        ("curated_lm_fragmentary_sentences", average < 7),
        ("curated_lm_runon_or_low_sentence_structure", (average > 48) & (c("n_sentences") < 6)),
        ("curated_lm_separator_heavy", (separators >= 4) | (density(separators) > 0.01)),
        ("curated_lm_url_or_metadata_heavy", (c("n_urls") >= 2) | (density(c("n_urls")) > 0.008)),
        ("curated_lm_medical_body_dense", (medical >= 5) & (density(medical) > 0.015)),
        ("curated_lm_product_commercial_dense", (product >= 4) & (density(product) > 0.012)),
        ("curated_lm_page_boilerplate", (page >= 2) | (density(page) > 0.012)),
        ("curated_lm_page_instruction_boilerplate", T.contains_any([c("low")], L.PAGE_INSTRUCTIONS)),
        (
            "curated_lm_dictionary_or_encyclopedia_fragment",
            c("low").contains("american heritage") & c("low").contains("dictionary") | (entries >= 3) & ((density(entries) > 0.01) | (c("n_sentences") <= 5)),
        ),
        ("curated_lm_repeated_ngram_heavy", repeats),
        ("curated_lm_low_prose_quality_signal", prose_score() < 2),
    ]


def domain_rules(list_heading: str | None = None) -> Rules:
    """list_heading: a heading that, with under 20 words, marks a list fragment."""
    both = [c("low"), c("raw_low")]
    pipes = F.length("raw") - F.length(F.translate("raw", "|", ""))
    fragment = [("domain_lm_list_fragment", c("raw_low").contains(list_heading) & (c("n_split") < 20))] if list_heading else []
    return [
        ("domain_lm_synthetic_training_scaffold", T.contains_any(both, L.SCAFFOLD_PHRASES)),
        ("domain_lm_structured_source_junk", T.contains_any([c("raw_low")], ("american heritage dictionary of the english language", "curriculum detail", "photo of "))),
        ("domain_lm_table_of_contents", c("raw_low").contains("section: contents") | c("raw").rlike(L.TOC_LINE) | c("raw").rlike(r"\.{5,}")),
        *fragment,
        ("domain_lm_fragment", c("n_split") < 8),
        ("domain_lm_dense_table_row", (pipes >= 12) & (c("n_split") < 80)),
        ("domain_lm_metadata_heavy", F.regexp_count("raw_low", F.lit(r"(?U)\bsource:\s*")) + F.regexp_count("raw_low", F.lit(r"(?U)\bsection:\s*")) >= 3),
    ]


def mode_rules(mode: str, min_chars: int, max_chars: int) -> Rules:
    if not MODES:
        MODES.update({"basic": [], "broad_lm": broad_rules(), "curated_lm": curated_rules(), "domain_lm": domain_rules()} | MODES)
    return [*global_rules(min_chars, max_chars), *MODES[mode]]
