"""Driver queries of raw-model samples, gated retrieval, decisions, sampling of packed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chat, mixing, rawlm, retrieve, snapshots
from textloom.operators import tokenize as tk
from textloom.queries import _ASSISTANT, _chunks, RETRIEVE_SQL, SQUEEZED, query, squeezed, table
from textloom.queries_rules import any_of, hits_of, number_of, quoted
from textloom.queries_web import _NAMED_SQL

_inlist = lambda words: "(" + ", ".join(map(quoted, words)) + ")"
_among = lambda x, words: f"len(list_filter({x}, lambda y: y IN {_inlist(words)}))"
_SAMPLE = """CASE conv_id % 6 WHEN 0 THEN '' WHEN 1 THEN coalesce(text, '') || ' catalog entry should be read. The course credit is open' WHEN 2 THEN 'a b-c-d-e or "x" and "y" is "x" berled the' WHEN 3 THEN 'water water water water river water time time water water fire water land water' ELSE coalesce(text, '') END"""
_PROMPT = "CASE conv_id % 5 WHEN 0 THEN 'Tell of the river and land' WHEN 1 THEN 'The course has credit for juniors' WHEN 2 THEN 'What recommendation is in the catalog' ELSE 'Some plain passage' END"
_BUCKET = "CASE turn % 4 WHEN 1 THEN 'narrative' WHEN 2 THEN 'everyday life' WHEN 3 THEN 'catalog' END"
_PROBE = "CASE conv_id % 7 WHEN 0 THEN 'Domain probe' END"
_KW = lambda w: f"list_distinct(list_filter({w}, lambda y: length(y) >= 4 AND y NOT IN {_inlist(rawlm.STOPWORDS)} AND y NOT IN {_inlist(rawlm.GENERIC)}))"
_HEAD = lambda n: f"(len(w[1:{n}]) >= 8 AND len(list_distinct(w[1:{n}])) / greatest(len(w[1:{n}]), 1) >= 0.32 AND weird / greatest(len(w[1:{n}]), 1) <= 0.04 AND coalesce(h{n}, 0) / greatest(len(w[1:{n}]), 1) < 0.22)"
_GRAMS = lambda source, key, sizes: f"SELECT {key}, k, max(c) AS m, sum(c - 1) / sum(c) AS e FROM (SELECT {key}, k, g, count(*) AS c FROM (SELECT {key}, k, array_to_string(x[i : i + k - 1], ' ') AS g FROM (SELECT {key}, x, k, unnest(range(1, len(x) - k + 2)) AS i FROM {source}, (VALUES {sizes}) AS s(k) WHERE len(x) >= k)) GROUP BY ALL) GROUP BY ALL"
_WEIRD = rawlm.WEIRD_HYPHEN
_BOIL = number_of("low", rawlm.DOMAIN_BOILERPLATE)
_IS_DOMAIN = "(contains(k, 'domain') OR contains(b, 'catalog') OR contains(p, 'catalog') OR contains(p, 'course'))"
RAW_SQL = rf"""WITH s0 AS (SELECT conv_id, turn, {_SAMPLE} AS raw, lower({_PROMPT}) AS p, lower(coalesce({_BUCKET}, '')) AS b, lower(coalesce({_PROBE}, '')) AS k FROM conversations WHERE role = 'assistant'),
s1 AS (SELECT *, trim(regexp_replace(raw, '[\x00\s\p{{Z}}]+', ' ', 'g')) AS r FROM s0), s2 AS (SELECT *, lower(r) AS low, list_transform(regexp_extract_all(r, '[a-zA-Z][a-zA-Z'']*'), lambda y: lower(y)) AS w, regexp_extract_all(p, '[a-zA-Z][a-zA-Z'']*') AS pw FROM s1),
s3 AS (SELECT *, list_filter(w, lambda y: length(y) >= 4 AND y NOT IN {_inlist(rawlm.STOPWORDS)}) AS c, {_KW('w')} AS kw, {_KW('pw')} AS pk, {hits_of('r', _WEIRD)} AS weird FROM s2),
gw AS ({_GRAMS('(SELECT conv_id, turn, w AS x FROM s3)', 'conv_id, turn', '(4)')}), h40 AS ({_GRAMS('(SELECT conv_id, turn, w[1:40] AS x FROM s3)', 'conv_id, turn', '(1)')}), h128 AS ({_GRAMS('(SELECT conv_id, turn, w[1:128] AS x FROM s3)', 'conv_id, turn', '(1)')}),
gc AS ({_GRAMS('(SELECT conv_id, turn, c AS x FROM s3)', 'conv_id, turn', '(1), (2), (3)')}), gp AS (SELECT conv_id, turn, max(m) FILTER (k = 1) AS c1, max(e) FILTER (k = 2) AS e2, max(e) FILTER (k = 3) AS e3, max(m) FILTER (k = 3) AS m3 FROM gc GROUP BY ALL),
s4 AS (SELECT s3.*, h40.m AS h40, h128.m AS h128, coalesce(gw.m, 0) AS max_4gram, coalesce(c1, 0) AS c1, coalesce(e2, 0) AS e2, coalesce(e3, 0) AS e3, coalesce(m3, 0) AS m3, list_transform(regexp_extract_all(r, {quoted(rawlm.SMALL_QUOTED)}, 1), lambda y: lower(y)) AS small,
  list_transform(regexp_extract_all(right(r, 80), '[a-zA-Z][a-zA-Z'']*'), lambda y: lower(y)) AS tail FROM s3 LEFT JOIN h40 USING (conv_id, turn) LEFT JOIN h128 USING (conv_id, turn) LEFT JOIN gw USING (conv_id, turn) LEFT JOIN gp USING (conv_id, turn)),
s5 AS (SELECT *, len(w) AS word_count, r = '' AS blank, {_HEAD(40)} AS first_40_legible, {_HEAD(128)} AS full_128_legible,
  CASE WHEN len(pk) = 0 THEN len(kw) > 0 ELSE list_has_any(pk, kw) OR ((contains(k, 'domain') OR contains(b, 'catalog')) AND {_among('kw', rawlm.DOMAIN_TERMS)} > 0) END AS topic_retained,
  {hits_of('r', rawlm.MALFORMED_WORD)} + weird + CAST(regexp_matches(r, {quoted(rawlm.QUOTE_LOOP)}) AS INT) + CAST(len(small) >= 6 AND len(list_distinct(small)) <= 4 AS INT) AS malformed_tokens,
  r = '' OR (NOT regexp_matches(r, '[.!?"''”’)\]]$') AND (len(tail) = 0 OR coalesce(tail[-1], 'a') IN {_inlist(rawlm.UNFINISHED_WORDS)})) AS unfinished, {_among('w', rawlm.GENERIC)} AS generic_words, {_BOIL} AS boilerplate_hits,
  CASE WHEN NOT {_IS_DOMAIN} THEN NULL WHEN {_among('w', rawlm.DOMAIN_TERMS)} = 0 THEN false WHEN {_BOIL} >= 2 THEN false
    WHEN {_among('pw', ('credit', 'juniors', 'seniors', 'open'))} > 0 OR contains(p, 'one-half credit') THEN {_among('w', rawlm.CREDIT_GROUNDING)} > 0
    WHEN {_among('pw', ('recommendation', 'recommendations', 'background'))} > 0 OR contains(p, 'different from recommendations') THEN {_among('w', rawlm.RECOMMENDATION_GROUNDING)} > 0
    WHEN contains(b, 'catalog') OR contains(p, 'catalog') OR contains(p, 'course') OR contains(p, 'class') THEN {_among('w', rawlm.CATALOG_CONTEXT)} > 0 AND {_among('w', rawlm.CATALOG_GROUNDING)} > 0
    WHEN contains(k, 'domain') THEN {_among('w', (*rawlm.CATALOG_GROUNDING, *rawlm.RECOMMENDATION_GROUNDING))} > 0 ELSE true END AS domain_phrase_accurate,
  NOT {_IS_DOMAIN} AND NOT {any_of('p', rawlm.CATALOG_DRIFT)} AND {any_of('low', rawlm.CATALOG_DRIFT)} AS catalog_drift, contains(b, 'narrative') AND {any_of('low', rawlm.NARRATIVE_DRIFT)} AS narrative_drift,
  contains(b, 'everyday') AND {_among('pw', rawlm.MEDICAL_DRIFT)} = 0 AND {_among('w', rawlm.MEDICAL_DRIFT)} > 0 AS medical_drift, contains(b, 'everyday') AND {_among('pw', rawlm.PRODUCT_DRIFT)} = 0 AND {_among('w', rawlm.PRODUCT_DRIFT)} >= 2 AS product_drift,
  c1 / greatest(len(c), 1) AS dominant FROM s4),
s6 AS (SELECT *, generic_words / greatest(word_count, 1) >= 0.16 OR generic_words >= 20 AS generic_attractor, len(c) >= 8 AND (dominant >= 0.24 OR e2 >= 0.18 OR e3 >= 0.12 OR m3 >= 3) AS semantic_loop FROM s5),
s7 AS (SELECT *, least(1.0, CASE WHEN topic_retained THEN 0 ELSE 0.35 END + CASE WHEN generic_attractor THEN 0.2 ELSE 0 END + CASE WHEN max_4gram >= 3 THEN 0.15 ELSE 0 END + CASE WHEN malformed_tokens > 0 OR weird > 0 THEN 0.15 ELSE 0 END
  + CASE WHEN semantic_loop THEN 0.15 ELSE 0 END + CASE WHEN narrative_drift OR medical_drift OR product_drift OR catalog_drift THEN 0.1 ELSE 0 END + CASE WHEN unfinished THEN 0.05 ELSE 0 END)::DOUBLE AS drift_score FROM s6)"""
_FLAGS = ("blank", "first_40_legible", "full_128_legible", "topic_retained", "unfinished", "domain_phrase_accurate", "catalog_drift", "narrative_drift", "medical_drift", "product_drift", "generic_attractor", "semantic_loop")
_COUNTS = ("word_count", "max_4gram", "malformed_tokens", "generic_words", "boilerplate_hits")


def _raw(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter(_ASSISTANT).select("conv_id", "turn", F.expr(_SAMPLE).alias("response"), F.expr(_PROMPT).alias("prompt"), F.expr(_BUCKET).alias("bucket"), F.expr(_PROBE).alias("probe_type"))
    return rawlm.assess(rows)


@query(f"{RAW_SQL} SELECT conv_id, turn, {', '.join(_FLAGS)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, weird AS weird_hyphens, round(dominant, 6) AS dominant_content_rate, round(e2, 6) AS content_bigram_rate, round(e3, 6) AS content_trigram_rate, round(drift_score, 6) AS drift_score FROM s7")
def raw_samples(spark, sf_dir):
    rates = ("dominant_content_rate", "content_bigram_rate", "content_trigram_rate", "drift_score")
    return _raw(spark, sf_dir).select("conv_id", "turn", *_FLAGS, *[F.col(c).cast("long").alias(c) for c in _COUNTS], F.col("weird_hyphens").cast("long").alias("weird_hyphens"), *[F.round(c, 6).alias(c) for c in rates])


_SHORT = "word_count <= 60"
_GATE = lambda name, where: f"""{name}o AS (SELECT count(*) AS samples, count(*) FILTER (blank) AS blank, count(*) FILTER (first_40_legible) AS f40, count(*) FILTER (topic_retained) AS kept, max(max_4gram) AS m4, sum(weird) / greatest(sum(word_count), 1) AS wr, count(*) FILTER (weird > 0) AS ws,
  sum(malformed_tokens) / greatest(sum(word_count), 1) AS mr, count(*) FILTER (malformed_tokens > 0) AS ms, count(*) FILTER (domain_phrase_accurate IS NOT NULL) AS dm, count(*) FILTER (boilerplate_hits > 0) AS bp, count(*) FILTER (catalog_drift) AS cd, count(*) FILTER (semantic_loop) AS lp, max(e2) AS e2, max(e3) AS e3,
  count(*) FILTER (narrative_drift) AS nd, count(*) FILTER (medical_drift) AS md, count(*) FILTER (product_drift) AS pd, count(*) FILTER (generic_attractor) / greatest(count(*), 1) AS gr, avg(drift_score) AS dr FROM s7 WHERE {where}),
{name} AS (SELECT *, list_filter([CASE WHEN blank > 0 THEN 'blank_sample_output' END, CASE WHEN f40 < least(10, samples) THEN 'first_40_tokens_not_legible_enough' END, CASE WHEN kept < least(8, samples) THEN 'prompt_topic_retention_too_low' END, CASE WHEN m4 >= 4 THEN 'dominant_repeated_4gram' END,
  CASE WHEN wr > 0.025 OR ws >= greatest(2, samples // 5) THEN 'weird_hyphen_or_subword_artifacts' END, CASE WHEN mr > 0.015 OR ms >= greatest(1, samples // 6) THEN 'malformed_token_rate_high' END, CASE WHEN dm > 0 AND bp >= dm THEN 'domain_boilerplate_repetition' END, CASE WHEN dm > 0 AND bp >= dm THEN 'boilerplate_repetition' END,
  CASE WHEN cd > 0 THEN 'catalog_advising_drift_into_unrelated_prompt' END, CASE WHEN lp > 0 OR e2 >= 0.18 OR e3 >= 0.12 THEN 'semantic_repetition' END, CASE WHEN nd >= 1 THEN 'narrative_prompts_drift_to_expository_history' END, CASE WHEN nd >= 1 THEN 'narrative_to_expository_drift' END,
  CASE WHEN md >= 1 OR pd >= 1 THEN 'everyday_prompts_drift_to_medical_body_child_content' END, CASE WHEN md >= 1 OR pd >= 1 THEN 'everyday_to_medical_drift' END, CASE WHEN gr > 0.4 THEN 'generic_attractor_collapse' END, CASE WHEN dr > 0.45 THEN 'semantic_drift_too_high' END], lambda x: x IS NOT NULL) AS reasons FROM {name}o)"""  # noqa: E731
_MAJOR = "[" + ", ".join(map(quoted, rawlm.MAJOR_FAILURES)) + "]"


@query(f"""{RAW_SQL}, {_GATE('a', _SHORT)}, {_GATE('b', 'NOT (' + _SHORT + ')')}
SELECT 'short' AS part, samples, array_to_string(reasons, ',') AS reasons, round(dr, 6) AS drift FROM a UNION ALL SELECT 'long', samples, array_to_string(reasons, ','), round(dr, 6) FROM b
UNION ALL SELECT 'status', a.samples + b.samples, CASE WHEN list_has_any(list_concat(a.reasons, b.reasons), {_MAJOR}) THEN 'weak_raw_lm' WHEN len(a.reasons) = 0 AND len(b.reasons) = 0 THEN 'usable_raw_lm'
  WHEN a.f40 / greatest(a.samples, 1) >= 0.75 AND a.kept / greatest(a.samples, 1) >= 0.55 AND b.dr <= 0.4 AND b.gr <= 0.3 THEN 'improving_raw_lm' ELSE 'weak_raw_lm' END, 0 FROM a, b""")
def raw_gates(spark, sf_dir):
    rows = _raw(spark, sf_dir)
    short, long = rawlm.gate(rows.filter(_SHORT)), rawlm.gate(rows.filter(f"NOT ({_SHORT})"))
    show = lambda part, g: g.select(F.lit(part).alias("part"), "samples", F.array_join("reasons", ",").alias("reasons"), F.round("drift", 6).alias("drift"))
    both = short.select("samples").union(long.select("samples")).agg(F.sum("samples").alias("samples"))
    status = rawlm.status(short, long).crossJoin(both).select(F.lit("status").alias("part"), "samples", F.col("status").alias("reasons"), F.lit(0.0).alias("drift"))
    return show("short", short).union(show("long", long)).union(status)


# --- gated retrieval -------------------------------------------------------------------------------------------------


@query(f"""{RETRIEVE_SQL[: RETRIEVE_SQL.index("h AS (SELECT query_id")]} nm AS (SELECT item_id AS query_id, {_NAMED_SQL("' ' || text")} AS names FROM benchmark),
hn AS (SELECT query_id, chunk_id, count(*) AS n FROM nm JOIN po ON list_contains(names, term) GROUP BY ALL),
h AS (SELECT m.query_id, m.chunk_id, round((0.5 + matched / query_terms) * s, 6) AS score FROM m JOIN nm USING (query_id) LEFT JOIN hn USING (query_id, chunk_id) WHERE matched >= 1 AND coalesce(hn.n, 0) >= len(names)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS next_score, count(*) OVER (PARTITION BY query_id) AS n FROM h WHERE score > 0),
t AS (SELECT query_id, n = 1 OR score - next_score >= 0.01 AS ok FROM r WHERE rank = 1) SELECT query_id, chunk_id, score, rank FROM r JOIN t USING (query_id) WHERE ok AND rank <= 3""".replace("(\"i'm\"", "('i''m'").replace("\"i'm\"", "'i''m'"))
def named_retrieval(spark, sf_dir):
    index = retrieve.build_index(_chunks(spark, sf_dir), "chunk_id", "chunk")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.retrieve(asked, index, 3, names=True, margin=0.01).select("query_id", "chunk_id", "score", "rank")


# --- decisions, samples ----------------------------------------------------------------------------------------------


_QUESTION = "coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' in 2021-22' ELSE '' END || CASE conv_id % 2 WHEN 0 THEN ' right now' ELSE '' END"


@query(f"""WITH q AS (SELECT conv_id, turn, lower({_QUESTION}) AS low, conv_id % 4 AS hits, conv_id % 7 = 0 AS passages, conv_id % 6 = 0 AS manual, conv_id % 5 <> 0 AS grounded FROM conversations WHERE role = 'user'),
p AS (SELECT *, grounded AND NOT (passages AND NOT manual) AS looks, regexp_matches(low, '\\b20\\d{{2}}\\s*[-–—/]\\s*(?:20\\d{{2}}|\\d{{2}})\\b') AND {any_of('low', snapshots.CURRENT_MARKERS)} AS mixed FROM q),
d AS (SELECT conv_id, turn, CASE WHEN looks AND mixed THEN 'timeframe_clarification_required' WHEN looks AND hits = 0 THEN 'deterministic_no_hit_fallback' WHEN looks THEN 'grounded' WHEN passages AND NOT manual THEN 'retrieved_context' WHEN manual THEN 'manual_context' ELSE 'model_only' END AS path FROM p)
SELECT conv_id, turn, path, CASE WHEN path IN ('timeframe_clarification_required', 'deterministic_no_hit_fallback') THEN 'Abstained' WHEN path IN ('grounded', 'retrieved_context') THEN 'Generated with sources' ELSE 'Generated' END AS label FROM d""".replace("\\\\", "\\"))
def grounded_decisions(spark, sf_dir):
    n = F.col("conv_id")
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.expr(_QUESTION).alias("question"))
    decided = snapshots.decide(F.col("question"), n % 5 != 0, n % 4, F.when(n % 7 == 0, 1).otherwise(0), n % 6 == 0)
    return q.select("conv_id", "turn", F.inline(F.array(decided)))


@query(f"""{SQUEEZED}, w AS (SELECT doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''), x AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 256 + 1)) AS k FROM w), y AS (SELECT doc_id, k, w[k * 256 + 1 : k * 256 + 256] AS p, row_number() OVER (ORDER BY doc_id, k) - 1 AS row, count(*) OVER () AS n FROM x),
i AS (SELECT DISTINCT CAST(round_even(j * (n - 1) / 19.0, 0) AS BIGINT) AS row FROM (SELECT DISTINCT n FROM y), range(0, 20) AS s(j)) SELECT doc_id, k AS "window", md5(array_to_string(p, ' ')) AS decoded FROM y JOIN i USING (row)""")
def packed_samples(spark, sf_dir):
    windows = mixing.fixed_windows(squeezed(spark, sf_dir).select("doc_id", T.split_words(F.col("text")).alias("w")), "doc_id", "w", 256, "<pad>")
    placed = windows.withColumn("place", F.struct("doc_id", "window"))
    return mixing.even_sample(placed, "place", 20).select("doc_id", "window", F.md5(tk.decode(F.col("ids"))).alias("decoded"))


@query("""SELECT DISTINCT lang AS bucket, CASE lang WHEN 'en' THEN 0.68::DOUBLE WHEN 'fr' THEN 0.04::DOUBLE ELSE 0.68::DOUBLE END AS share, CASE lang WHEN 'fr' THEN 8 ELSE 96 END AS least FROM documents""")
def bucket_targets(spark, sf_dir):
    name = F.when(F.col("lang") == "en", "constructive_direct").when(F.col("lang") == "fr", "hard_refusal").otherwise(F.col("lang"))
    t = chat.targets_of(name)
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), t["share"].alias("share"), t["least"].alias("least")).distinct()
