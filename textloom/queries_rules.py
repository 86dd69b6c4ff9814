"""Driver queries of the text rules: reason chains, their parts, and corpus statistics by family of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import audit, clean, reports
from textloom.plans import lists as L
from textloom.plans import rules
from textloom.queries import PREPARED, SCRUB, SENTENCES, SIGNATURE, SQUEEZED, WORDS, prepared, query, squeezed, table

quoted = lambda s: "'" + s.replace("'", "''") + "'"
any_of = lambda x, phrases: "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in phrases) + ")"
number_of = lambda x, phrases: "(" + " + ".join(f"CAST(contains({x}, {quoted(p)}) AS INT)" for p in phrases) + ")"
hits_of = lambda x, pattern: f"len(regexp_extract_all({x}, {quoted(pattern)}))"
terms_of = lambda x, terms: hits_of(x, "|".join(r"\b" + r"\s+".join(map(T.literal_pattern, t.lower().split())) + r"\b" for t in terms))
ratio = lambda n, d: f"({n}) / greatest({d}, 1)"

URLS = r"'(?i)(?:https?://|www\.)\S+|\S+\.(?:com|org|net|edu|gov|io|co)\S*'"
DOMAIN_TEXT = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(" + SCRUB + r", '(?i)^\s*Source:\s*.+?\.\s*Section:\s*', '')), '\s*\|\s*', ', ', 'g'), '\s+-\s+', '; ', 'g'),"
    r" '\.{5,}', ' ', 'g'), '[\x00\s\p{Z}]+', ' ', 'g'))"
)
LINES = r"list_filter(list_transform(regexp_split_to_array(coalesce(raw, ''), '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '')"
SEGMENTS = r"list_filter(list_transform(string_split(raw, '|'), lambda x: trim(regexp_replace(x, '[\x00\s\p{Z}]+', ' ', 'g'))), lambda x: x <> '')"
_CATEGORY = "(?:" + "|".join(L.CATEGORY_NAMES) + ")"


def metrics(text: str = SCRUB) -> str:
    """CTEs up to m: the columns that rules read."""
    return rf"""WITH d AS (SELECT doc_id, source, text AS raw, {text} AS t FROM documents),
a AS (SELECT *, lower(t) AS low, lower(coalesce(raw, '')) AS rlow, {WORDS} AS n_split, {LINES} AS lines FROM d),
m AS (SELECT *, regexp_extract_all(low, '[A-Za-z][A-Za-z'']*') AS w, len(regexp_extract_all(low, '[A-Za-z][A-Za-z'']*')) AS n_words, {SENTENCES} AS n_sentences,
  len(regexp_extract_all(t, {URLS})) AS n_urls, len(lines) AS n_lines FROM a)"""


#: Grams of the words of m: the largest count and the share of repeats, for 5 and 8.
GRAMS = """, gx AS (SELECT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM m, (VALUES (5), (8)) AS s(k) WHERE len(w) >= k)),
gc AS (SELECT doc_id, k, g, count(*) AS c FROM gx GROUP BY ALL), gs AS (SELECT doc_id, max(c) FILTER (k = 5) AS m5, sum(c - 1) FILTER (k = 5) / sum(c) FILTER (k = 5) AS e5,
  max(c) FILTER (k = 8) AS m8, sum(c - 1) FILTER (k = 8) / sum(c) FILTER (k = 8) AS e8 FROM gc GROUP BY doc_id)"""

GLOBAL_SQL = [
    ("non_text", "raw IS NULL"), ("too_short", "length(t) < 128"), ("too_long", "length(t) > 200000"), ("low_alpha_ratio", r"length(regexp_replace(t, '[^\p{L}]', '', 'g')) / greatest(length(t), 1) < 0.2"),
    ("too_many_urls", "(length(t) - length(replace(t, 'http', ''))) / 4 > 100"),
]
_count = lambda pattern: f"len(list_filter(lines, lambda x: regexp_matches(x, {quoted(pattern)})))"
LINE_SQL = [
    ("broad_lm_table_of_contents", f"n_lines >= 4 AND {_count(L.TOC_LINE)} >= 3"),
    ("broad_lm_list_heavy", f"n_lines >= 4 AND {_count(L.BULLET_LINE)} >= 4 AND {_count(L.BULLET_LINE)} / n_lines >= 0.45"),
    ("broad_lm_metadata_heavy", f"n_lines >= 4 AND {_count(L.LABEL_LINE)} >= 3 AND {_count(L.LABEL_LINE)} / n_lines >= 0.25"),
    ("broad_lm_fragment_heavy", r"n_lines >= 4 AND len(list_filter(lines, lambda x: len(regexp_split_to_array(x, '\s+')) <= 6)) >= 6 AND len(list_filter(lines, lambda x: len(regexp_split_to_array(x, '\s+')) <= 6)) / n_lines >= 0.6"),
    ("broad_lm_repeated_lines", "n_lines >= 8 AND 1 - len(list_distinct(lines)) / n_lines >= 0.35"),
]
BROAD_SQL = [
    ("broad_lm_url_heavy", f"n_urls >= 3 OR {ratio('n_urls', 'n_split')} > 0.015"), ("broad_lm_navigation_boilerplate", f"{number_of('low', L.BOILERPLATE_PHRASES)} >= 2"), *LINE_SQL,
    ("broad_lm_metadata_heavy", f"{hits_of('low', L.METADATA_WORDS)} >= 8"),
]
PIPES = "(length(raw) - length(replace(raw, '|', '')))"
_SHORT = rf"len(list_filter({SEGMENTS}, lambda s: len(regexp_extract_all(s, '[A-Za-z][A-Za-z'']*')) BETWEEN 1 AND 4))"
MENU_SQL = (
    f"{PIPES} >= 4 AND (regexp_matches(raw, '(?i)\\b{_CATEGORY}\\b(?:\\s*\\|\\s*\\b{_CATEGORY}\\b){{3,}}') OR "
    f"(strpos(raw, '|') - 1 <= 450 AND len({SEGMENTS}) >= 5 AND {PIPES} >= 6 AND {_SHORT} / greatest(len({SEGMENTS}), 1) >= 0.6 AND {ratio(PIPES, 'n_words')} > 0.01))"
)
PROSE_SQL = (
    "(CAST(n_sentences >= 5 AS INT) + CAST(n_words / greatest(n_sentences, 1) >= 9 AND n_words / greatest(n_sentences, 1) <= 34 AS INT)"
    f" + CAST({any_of('low', L.DISCOURSE_MARKERS)} AS INT) + CAST(regexp_matches(t, '[,;:]') AS INT) + CAST(len(list_distinct(w)) / greatest(n_words, 1) >= 0.38 AS INT))"
)
_either = lambda phrases: f"({any_of('low', phrases)} OR {any_of('rlow', phrases)})"
_packed = r"regexp_replace(lower(t || ' ' || coalesce(raw, '')), '[^a-z0-9]+', '', 'g')"
_per_word = lambda n: ratio(n, "n_words")
_average = "n_words / greatest(n_sentences, 1)"
_questions = "(length(t) - length(replace(t, '?', '')))"
_separators = hits_of("coalesce(raw, '')", L.SEPARATORS)
CURATED_SQL = [
    *BROAD_SQL, ("curated_lm_familysearch_wiki_boilerplate", any_of(_packed, L.COMPACT_WIKI)), ("curated_lm_html_archive_boilerplate", _either(L.HTML_ARCHIVE)),
    ("curated_lm_science_fair_encyclopedia", _either(L.SCIENCE_FAIR)), ("curated_lm_dictionary_or_encyclopedia_fragment", _either(L.LOOKUP_FRAGMENTS)),
    ("curated_lm_cookie_video_widget_boilerplate", _either(L.COOKIE_VIDEO)), ("curated_lm_product_commercial_dense", _either(L.PRODUCT_WIDGETS)), ("curated_lm_newsletter_or_source_tagline", _either(L.TAGLINES)),
    ("curated_lm_question_list_or_seo_fragments", _either(L.SEO_FRAGMENTS)), ("curated_lm_residual_web_boilerplate", _either(L.RESIDUAL_WEB)), ("curated_lm_category_menu_boilerplate", MENU_SQL),
    ("curated_lm_too_few_words", "n_words < 80"), ("curated_lm_too_few_sentences", "n_sentences < 3"),
    ("curated_lm_question_list_or_seo_fragments", f"{_questions} >= 5 AND {hits_of('low', L.QUESTION_STARTS)} >= 4 AND {_questions} / greatest(n_sentences, 1) >= 0.35"),
    ("curated_lm_fragmentary_sentences", f"{_average} < 7"), ("curated_lm_runon_or_low_sentence_structure", f"{_average} > 48 AND n_sentences < 6"),
    ("curated_lm_separator_heavy", f"{_separators} >= 4 OR {_per_word(_separators)} > 0.01"), ("curated_lm_url_or_metadata_heavy", f"n_urls >= 2 OR {_per_word('n_urls')} > 0.008"),
    ("curated_lm_medical_body_dense", f"{terms_of('low', L.MEDICAL_TERMS)} >= 5 AND {_per_word(terms_of('low', L.MEDICAL_TERMS))} > 0.015"),
    ("curated_lm_product_commercial_dense", f"{terms_of('low', L.PRODUCT_TERMS)} >= 4 AND {_per_word(terms_of('low', L.PRODUCT_TERMS))} > 0.012"),
    ("curated_lm_page_boilerplate", f"{terms_of('low', L.PAGE_TERMS)} >= 2 OR {_per_word(terms_of('low', L.PAGE_TERMS))} > 0.012"), ("curated_lm_page_instruction_boilerplate", any_of("low", L.PAGE_INSTRUCTIONS)),
    (
        "curated_lm_dictionary_or_encyclopedia_fragment",
        f"contains(low, 'american heritage') AND contains(low, 'dictionary') OR {terms_of('low', L.DICTIONARY_TERMS)} >= 3 AND ({_per_word(terms_of('low', L.DICTIONARY_TERMS))} > 0.01 OR n_sentences <= 5)",
    ),
    ("curated_lm_repeated_ngram_heavy", "coalesce(m5, 0) >= 4 OR coalesce(e5, 0) > 0.06 OR coalesce(m8, 0) >= 3 OR coalesce(e8, 0) > 0.035"), ("curated_lm_low_prose_quality_signal", f"{PROSE_SQL} < 2"),
]
_DOMAIN_META = f"{hits_of('rlow', r'\bsource:\s*')} + {hits_of('rlow', r'\bsection:\s*')}"
DOMAIN_SQL = [
    ("domain_lm_synthetic_training_scaffold", _either(L.SCAFFOLD_PHRASES)),
    ("domain_lm_structured_source_junk", any_of("rlow", ("american heritage dictionary of the english language", "curriculum detail", "photo of "))),
    ("domain_lm_table_of_contents", rf"contains(rlow, 'section: contents') OR regexp_matches(raw, {quoted(L.TOC_LINE)}) OR regexp_matches(raw, '\.{{5,}}')"), ("domain_lm_fragment", "n_split < 8"),
    ("domain_lm_dense_table_row", f"{PIPES} >= 12 AND n_split < 80"), ("domain_lm_metadata_heavy", f"{_DOMAIN_META} >= 3"),
]


def judged(chain: list[tuple[str, str]], text: str = SCRUB, grams: bool = False) -> str:
    """CTEs up to p: documents with the first reason of a chain, and later copies of kept texts as duplicates."""
    cases = " ".join(f"WHEN {condition} THEN '{reason}'" for reason, condition in [*GLOBAL_SQL, *chain])
    source = "m LEFT JOIN gs USING (doc_id)" if grams else "m"
    return f"""{metrics(text)}{GRAMS if grams else ''}, r AS (SELECT doc_id, source, t, n_split, CASE {cases} END AS reason FROM {source}),
p AS (SELECT doc_id, source, t, n_split, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY t, reason IS NULL ORDER BY doc_id) > 1 THEN 'exact_duplicate' ELSE reason END AS drop_reason FROM r)"""


_HISTOGRAM = "SELECT source, drop_reason, count(*) AS n FROM p GROUP BY ALL"


def _histogram(p):
    return p.groupBy("source", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"{judged(CURATED_SQL, grams=True)} {_HISTOGRAM}")
def curated_reasons(spark, sf_dir):
    return _histogram(prepared(spark, sf_dir, "curated_lm"))


@query(f"{judged(BROAD_SQL)} {_HISTOGRAM}")
def broad_reasons(spark, sf_dir):
    return _histogram(prepared(spark, sf_dir, "broad_lm"))


@query(f"{judged(DOMAIN_SQL, DOMAIN_TEXT)} {_HISTOGRAM}")
def domain_reasons(spark, sf_dir):
    return _histogram(prepared(spark, sf_dir, "domain_lm"))


@query(f"{judged(CURATED_SQL, grams=True)} SELECT doc_id, drop_reason FROM p")
def curated_verdicts(spark, sf_dir):
    return prepared(spark, sf_dir, "curated_lm").select("doc_id", "drop_reason")


@query(f"WITH d AS (SELECT doc_id, {DOMAIN_TEXT} AS t FROM documents) SELECT doc_id, md5(coalesce(t, '')) AS digest FROM d")
def domain_normalized(spark, sf_dir):
    t = T.drop_provenance(T.scrub(T.squeeze(F.coalesce("text", F.lit("")))))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"))


def _metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("raw"))
    return rules.with_metrics(d.withColumn("text", T.scrub(T.squeeze(F.col("raw")))))


@query(f"{metrics()} SELECT doc_id, coalesce({MENU_SQL}, false) AS menu, {PROSE_SQL} AS prose_score FROM m")
def menu_and_prose(spark, sf_dir):
    return _metrics(spark, sf_dir).select("doc_id", rules.pipe_menu().alias("menu"), rules.prose_score().alias("prose_score"))


_NUMBERS = {
    "chars": "length(t)", "words": "n_words", "split_words": "n_split", "sentences": "n_sentences", "questions": _questions, "urls": "n_urls", "lines": "n_lines", "separators": _separators,
    "pipes": f"coalesce({PIPES}, 0)", "medical_terms": terms_of("low", L.MEDICAL_TERMS), "product_terms": terms_of("low", L.PRODUCT_TERMS), "dictionary_terms": terms_of("low", L.DICTIONARY_TERMS),
    "page_terms": terms_of("low", L.PAGE_TERMS), "max_5": "coalesce(m5, 0)", "max_8": "coalesce(m8, 0)", "prose_score": PROSE_SQL,
}
_RATES = {
    "sentence_words": _average, "distinct_ratio": "len(list_distinct(w)) / greatest(n_words, 1)", "alpha_ratio": r"length(regexp_replace(t, '[^\p{L}]', '', 'g')) / greatest(length(t), 1)",
    "url_density": _per_word("n_urls"), "medical_density": _per_word(terms_of("low", L.MEDICAL_TERMS)), "product_density": _per_word(terms_of("low", L.PRODUCT_TERMS)), "page_density": _per_word(terms_of("low", L.PAGE_TERMS)),
    "extra_5": "coalesce(e5, 0)", "extra_8": "coalesce(e8, 0)",
}
_LINE_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in LINE_SQL) + " END"


@query(f"""{metrics()}{GRAMS} SELECT doc_id, {', '.join(f'CAST({e} AS BIGINT) AS {k}' for k, e in _NUMBERS.items())}, {', '.join(f'round({e}, 6) AS {k}' for k, e in _RATES.items())}, {_LINE_CASE} AS line_reason
FROM m LEFT JOIN gs USING (doc_id)""")
def document_diagnostics(spark, sf_dir):
    out = rules.diagnostics(_metrics(spark, sf_dir))
    return out.select("doc_id", *[F.col(k).cast("long").alias(k) for k in _NUMBERS], *[F.round(k, 6).alias(k) for k in _RATES], "line_reason")


# A corpus for a tokenizer: squeezed texts of some length, up to two limits.
@query(f"""{SQUEEZED}, k AS (SELECT doc_id, t, row_number() OVER (ORDER BY doc_id) - 1 AS before_docs, coalesce(sum(length(t) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_chars
FROM d WHERE length(t) >= 200) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM k WHERE before_docs < 400 AND before_chars < 300000""")
def tokenizer_corpus(spark, sf_dir):
    from textloom.sources.readers import dual_cap

    kept = clean.corpus_texts(table(spark, sf_dir, "documents"), 200)
    return dual_cap(kept, "doc_id", "text", 400, 300_000).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"""{PREPARED}, k AS (SELECT doc_id, CASE WHEN drop_reason IS NULL AND n <= 40 THEN 'too_short_tokenized' ELSE drop_reason END AS drop_reason FROM p) SELECT drop_reason, count(*) AS n FROM k GROUP BY ALL""")
def tokenized_drops(spark, sf_dir):
    # 40 tokens stand for the one that nothing here is as short as.
    p = clean.drop_short_tokenized(prepared(spark, sf_dir), T.count_split_words(F.col("text")), least=41)
    return p.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{PREPARED.replace("PARTITION BY t, reason IS NULL ORDER", "PARTITION BY t, reason IS NULL AND source <> 'src1' ORDER")} SELECT doc_id, CASE WHEN drop_reason = 'exact_duplicate' AND source = 'src1' THEN NULL ELSE drop_reason END AS drop_reason FROM p""")
def dedup_with_opt_out(spark, sf_dir):
    d = clean.clean(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "basic").withColumn("takes_part", F.col("source") != "src1")
    return clean.first_wins(d.withColumn("document_hash", T.document_hash(F.col("text"))), ["doc_id"], dedup="takes_part").select("doc_id", "drop_reason")


_ARTIFACTS = {
    "excessive_hyphen_fragments": hits_of("low", audit.MALFORMED), "broken_quote_fragments": hits_of("low", audit.BROKEN_QUOTES), "navigation_like_text": terms_of("low", L.NAVIGATION_TERMS),
    "generic_article_formula": terms_of("low", L.GENERIC_FORMULAE), "medical_body_health": terms_of("low", L.MEDICAL_TERMS), "product_commercial": terms_of("low", L.PRODUCT_TERMS),
    "dictionary_fragment": terms_of("low", L.DICTIONARY_TERMS), "page_boilerplate": terms_of("low", (*L.PAGE_TERMS, *L.PAGE_INSTRUCTIONS)),
}
_ARTIFACT_SQL = f"""{SQUEEZED}, c AS (SELECT source, n, {', '.join(f'{e} AS {k}' for k, e in _ARTIFACTS.items())} FROM (SELECT source, {WORDS} AS n, lower(t) AS low FROM d)),
x AS ({' UNION ALL '.join(f"SELECT source, CAST(sum(n) AS BIGINT) AS tokens, '{k}' AS family, count(*) FILTER ({k} > 0) AS documents, CAST(sum({k}) AS BIGINT) AS occurrences, round(sum({k}) / greatest(sum(n), 1), 6) AS density FROM c GROUP BY source" for k in _ARTIFACTS)})"""


@query(f"{_ARTIFACT_SQL} SELECT * FROM x")
def artifact_densities(spark, sf_dir):
    return audit.artifact_counts(squeezed(spark, sf_dir), "source")


_WIDE = ", ".join(f"max(density) FILTER (family = '{k}') AS {k}" for k in _ARTIFACTS)


@query(f"""{_ARTIFACT_SQL}, y AS (SELECT source, {_WIDE} FROM x GROUP BY source)
SELECT *, round(least(1.0, medical_body_health + 2 * navigation_like_text + 4 * (excessive_hyphen_fragments + broken_quote_fragments) + 2 * generic_article_formula), 6) AS junk_score FROM y""")
def junk_scores(spark, sf_dir):
    return audit.junk_score(audit.artifact_counts(squeezed(spark, sf_dir), "source"), "source")


_HIDDEN_SQL = " UNION ALL ".join(f"SELECT '{k}' AS family, doc_id, list_filter([{', '.join(map(quoted, v))}], lambda p: contains(low, p)) AS matched FROM l" for k, v in L.HIDDEN_PATTERNS.items())


@query(f"""WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), m AS (SELECT * FROM ({_HIDDEN_SQL}) WHERE len(matched) > 0),
t AS (SELECT family, count(*) AS documents FROM m GROUP BY family), e AS (SELECT family, doc_id, matched[1:8] AS matched FROM m QUALIFY row_number() OVER (PARTITION BY family ORDER BY doc_id) <= 5)
SELECT family, documents, string_agg(doc_id || ':' || array_to_string(matched, '|'), ' ' ORDER BY doc_id) AS examples FROM e JOIN t USING (family) GROUP BY ALL""")
def hidden_pattern_families(spark, sf_dir):
    from textloom.queries import _shown

    return _shown(audit.pattern_examples(table(spark, sf_dir, "documents"), "doc_id"))


_PHRASES = " UNION ALL ".join(f"SELECT source, {quoted(p)} AS phrase, CAST(sum(length(low) - length(replace(low, {quoted(p)}, ''))) // {len(p)} AS BIGINT) AS occurrences FROM ls GROUP BY source" for p in L.SCAFFOLD_PHRASES)
_ALLOWED = ", ".join(map(quoted, reports.BROAD_ALLOWED_PHRASES))
GATE_SQL = rf"""{PREPARED}, k AS (SELECT doc_id, source, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w FROM p WHERE drop_reason IS NULL),
g AS (SELECT source, doc_id, k, lim, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT source, doc_id, w, s.k, lim, unnest(range(1, len(w) - s.k + 2)) AS i FROM k, (VALUES (4, 8), (8, 6), (12, 4), (20, 3)) AS s(k, lim) WHERE len(w) >= s.k)),
f AS (SELECT source, doc_id, k, lim, g, min(i) AS i FROM g GROUP BY ALL), l AS (SELECT source, k, g FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) <= lim),
c AS (SELECT source, k, count(*) AS c FROM l GROUP BY source, k, g), top AS (SELECT source, k, max(c) AS c FROM c GROUP BY ALL),
n AS (SELECT source, count(*) FILTER (drop_reason IS NULL) AS documents FROM p GROUP BY source), dom AS (SELECT source, CASE WHEN documents < 16 THEN 0 ELSE coalesce(max(c) FILTER (k IN (8, 12, 20)), 0) / documents END AS dominance FROM n LEFT JOIN top USING (source) GROUP BY source, documents),
sg AS (SELECT source, {SIGNATURE} AS sg, count(*) AS c FROM p WHERE drop_reason IS NULL GROUP BY ALL), near AS (SELECT source, sum(c) FILTER (c > 1 AND sg <> '') / greatest(max(documents), 1) AS r FROM sg JOIN n USING (source) GROUP BY source),
ls AS (SELECT source, lower(coalesce(text, '')) AS low FROM documents), ph AS ({_PHRASES}),
o AS (SELECT coalesce((SELECT max(c) FROM top WHERE k = 4), 0) AS max_4gram, coalesce((SELECT max(c) FROM top WHERE k = 8), 0) AS max_8gram, coalesce((SELECT max(c) FROM top WHERE k = 12), 0) AS max_12gram,
  coalesce((SELECT max(c) FROM top WHERE k = 20 AND source IN ('src0', 'src1')), 0) AS max_domain_20gram, coalesce((SELECT max(round(dominance, 6)) FROM dom), 0) AS max_dominance,
  coalesce((SELECT max(round(coalesce(r, 0), 6)) FROM near WHERE source IN ('src0', 'src1')), 0) AS max_near_duplicate,
  CAST(coalesce((SELECT sum(occurrences) FROM ph WHERE source IN ('src0', 'src1') OR phrase NOT IN ({_ALLOWED})), 0) AS BIGINT) AS scaffold_phrases)
SELECT *, array_to_string(list_filter([CASE WHEN scaffold_phrases > 0 THEN 'synthetic_meta_phrase_count_nonzero' END, CASE WHEN max_4gram > 8000 THEN 'repeated_4gram_count_above_limit' END, CASE WHEN max_8gram > 4000 THEN 'repeated_8gram_count_above_limit' END,
  CASE WHEN max_12gram > 2500 THEN 'repeated_12gram_count_above_limit' END, CASE WHEN max_dominance > 0.2 THEN 'template_family_dominance_above_limit' END, CASE WHEN max_near_duplicate > 0.12 THEN 'near_duplicate_ratio_above_limit' END,
  CASE WHEN max_domain_20gram > 500 THEN 'domain_repeated_20gram_count_above_limit' END], lambda x: x IS NOT NULL), ',') AS failures FROM o"""


@query(GATE_SQL)
def corpus_quality_gate(spark, sf_dir):
    p = prepared(spark, sf_dir)
    domain = F.col("source").isin("src0", "src1")
    families = audit.leading_families(p.filter("drop_reason IS NULL"), "source", 1)
    out = reports.corpus_gate(families, audit.source_report(p), reports.scaffold_counts(table(spark, sf_dir, "documents")), domain, domain)
    return out.withColumn("failures", F.array_join("failures", ",")).drop("passed")
