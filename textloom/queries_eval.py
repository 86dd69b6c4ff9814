"""Driver queries of evaluation: samples, benchmarks, audits, rollups, gates, output cases and the smaller reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import audit, evals, reports
from textloom.queries import _ASSISTANT, _lanes, PREPARED, ROLLUP_SQL, SQUEEZE, SQUEEZED, TIERS, prepared, query, squeezed, table
from textloom.queries_rules import any_of, quoted

# --- generated samples -----------------------------------------------------------------------------------------------

_NORM = r"list_transform(raw, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'))"
REASONS_SQL = rf"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '^[\s]+|[\s]+$', '', 'g')) AS t FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS raw, regexp_replace(t, '\s+', '', 'g') AS s FROM a),
n AS (SELECT *, {_NORM} AS norm, list_filter({_NORM}, lambda x: x <> '') AS w FROM r),
e AS (SELECT conv_id, turn, k, g, count(*) AS c FROM (SELECT conv_id, turn, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT conv_id, turn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k)) GROUP BY ALL),
m AS (SELECT conv_id, turn, coalesce(max(c) FILTER (k = 1), 0) AS m1, coalesce(max(c) FILTER (k = 2), 0) AS m2, coalesce(max(c) FILTER (k = 3), 0) AS m3 FROM e GROUP BY ALL),
u AS (SELECT conv_id, turn, i, w[i] AS x, i - row_number() OVER (PARTITION BY conv_id, turn, w[i] ORDER BY i) AS grp FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM n)),
ru AS (SELECT conv_id, turn, max(c) AS run FROM (SELECT conv_id, turn, x, grp, count(*) AS c FROM u GROUP BY ALL) GROUP BY ALL),
q AS (SELECT n.*, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(run, 1) AS run, length(s) AS solid, len(raw) AS tokens, len(w) AS words,
  CASE WHEN s = '' THEN 0 ELSE length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) / length(s) END AS alpha, CASE WHEN s = '' THEN 0 ELSE (length(s) - length(replace(s, ',', ''))) / length(s) END AS commas,
  len(regexp_extract_all(t, ',{{3,}}|\.{{3,}}|/{{3,}}|>{{3,}}|-{{3,}}')) AS bursts, CASE WHEN len(raw) = 0 THEN 0 ELSE len(list_filter(norm, lambda x: length(x) <= 2)) / len(raw) END AS short,
  CASE WHEN len(raw) = 0 THEN 0 ELSE len(list_filter(raw, lambda x: regexp_matches(x, '[,./>-]$'))) / len(raw) END AS suffix, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS variety,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9''-]{{2,}}'), lambda x: regexp_replace(lower(x), '^[''-]+|[''-]+$', '', 'g')), lambda x: x NOT IN {tuple(evals.COMMON_WORDS)}))) AS content
  FROM n LEFT JOIN m USING (conv_id, turn) LEFT JOIN ru USING (conv_id, turn)),
z AS (SELECT *, list_filter([CASE WHEN bursts >= 2 THEN 'separator_spam' END, CASE WHEN solid >= 40 AND alpha < 0.45 THEN 'low_alphabetic_ratio' END, CASE WHEN tokens >= 12 AND short > 0.55 THEN 'too_many_short_fragments' END,
  CASE WHEN tokens >= 12 AND suffix > 0.55 THEN 'malformed_token_dump' END, CASE WHEN run >= 4 THEN 'repeated_token_burst' END, CASE WHEN solid >= 40 AND commas > 0.12 THEN 'comma_spam' END, CASE WHEN words >= 12 AND variety < 0.3 THEN 'low_token_variety' END,
  CASE WHEN t = '' THEN 'blank_output' END, CASE WHEN t <> '' AND regexp_matches(t, '^[^\p{{L}}\p{{M}}\p{{N}}]+$') THEN 'punctuation_only' END, CASE WHEN solid <= 3 OR words <= 2 AND content = 0 THEN 'too_short_no_content' END,
  CASE WHEN regexp_matches(t, '\b(?:[A-Za-z]{{1,3}}-){{3,}}[A-Za-z]{{1,3}}\b') THEN 'hyphen_letter_garbage' END, CASE WHEN tokens <= 8 AND regexp_matches(t, '(?i)(?:©|copyright)\s*(?:19|20)\d{{2}}') THEN 'copyright_date_residue' END,
  CASE WHEN solid BETWEEN 1 AND 39 AND alpha < 0.35 THEN 'low_alphabetic_ratio' END, CASE WHEN m2 >= 4 OR m3 >= 3 THEN 'repeated_phrase' END, CASE WHEN words >= 10 AND m1 >= 3 AND m1 / words >= 0.18 THEN 'dominant_repeated_token' END], lambda x: x IS NOT NULL) AS reasons FROM q)"""
_FATAL = ", ".join(map(quoted, evals.FATAL))


@query(f"""{REASONS_SQL} SELECT conv_id, turn, array_to_string(reasons, ',') AS reasons, CAST(run AS INT) AS repeated_token_run,
  len(reasons) >= 2 OR bursts >= 4 OR run >= 6 OR (tokens >= 16 AND suffix > 0.7 AND short > 0.6) OR list_has_any(reasons, [{_FATAL}]) AS degenerate FROM z""")
def generation_reasons(spark, sf_dir):
    a = evals.generation_quality(table(spark, sf_dir, "conversations").filter(_ASSISTANT), "text")
    return a.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"), "degenerate", "repeated_token_run")


_SAMPLE = """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN coalesce(text, '') || ' [Source:  Course Catalog]' WHEN 2 THEN 'The handbook says so.' WHEN 3 THEN 'I cannot confirm this. What do you mean?' ELSE coalesce(text, '') END AS response,
  CASE turn % 3 WHEN 0 THEN 'Abstain' WHEN 1 THEN 'clarify' END AS mode, conv_id % 2 = 0 AS has_ok, conv_id % 7 = 1 AS has_no, conv_id % 4 = 0 AS needs FROM conversations WHERE role = 'assistant'"""
GROUNDED_SQL = f"""WITH s0 AS ({_SAMPLE}), s AS (SELECT *, trim(regexp_replace(response, '[\\x00\\s\\p{{Z}}]+', ' ', 'g')) AS r FROM s0), l AS (SELECT *, lower(r) AS low FROM s),
g AS (SELECT *, list_distinct(list_concat(list_transform(regexp_extract_all(r, '(?i)\\[source:\\s*([^\\]]+)\\]', 1), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))),
  list_concat(CASE WHEN {any_of('low', evals.SOURCE_MENTIONS['course catalog'])} THEN ['course catalog'] ELSE [] END, CASE WHEN {any_of('low', evals.SOURCE_MENTIONS['handbook'])} THEN ['handbook'] ELSE [] END))) AS m FROM l),
c AS (SELECT conv_id, turn, response, low, lower(coalesce(mode, '')) AS mode, len(m) > 0 AS said, has_ok, needs, (has_ok AND len(m) > 0 AND len(list_filter(m, lambda x: x <> 'handbook')) > 0) OR (has_no AND list_contains(m, 'course catalog')) AS wrong,
  lower(coalesce(mode, '')) = 'abstain' AND NOT {any_of('low', evals.SAMPLE_ABSTENTIONS)} AS silent, contains(low, '?') OR {any_of('low', evals.SAMPLE_CLARIFICATIONS)} AS asks FROM g),
k AS (SELECT conv_id, turn, low, CASE WHEN low = '' THEN 0 ELSE CAST(said AND NOT has_ok AND NOT needs AS INT) + CAST(needs AND NOT said AS INT) END AS unsupported_source_tag, CASE WHEN low = '' THEN 0 ELSE CAST(wrong AS INT) END AS wrong_source_attribution,
  CASE WHEN low = '' THEN 0 ELSE CAST(silent AS INT) END AS grounded_abstention_fail, CASE WHEN low = '' THEN 0 ELSE CAST(mode = 'clarify' AND NOT asks AS INT) END AS clarification_missing,
  CASE WHEN low = '' THEN 0 ELSE CAST(silent AND said AS INT) + CAST(mode IN ('abstain', 'clarify') AND said AND {any_of('low', evals.FABRICATED)} AS INT) END AS fabricated_fact_pattern FROM c)""".replace("\\\\", "\\")


def _samples(spark, sf_dir):
    n, t = F.col("conv_id"), F.coalesce("text", F.lit(""))
    response = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(t, F.lit(" [Source:  Course Catalog]"))).when(n % 5 == 2, "The handbook says so.").when(n % 5 == 3, "I cannot confirm this. What do you mean?").otherwise(t)
    mode = F.when(F.col("turn") % 3 == 0, "Abstain").when(F.col("turn") % 3 == 1, "clarify")
    some = lambda cond, x: F.when(cond, F.array(F.lit(x)))
    rows = table(spark, sf_dir, "conversations").filter(_ASSISTANT).select(
        "conv_id", "turn", response.alias("response"), mode.alias("expected_mode"), some(n % 2 == 0, "Handbook ").alias("allowed_sources"), some(n % 7 == 1, "course catalog").alias("forbidden_sources"), (n % 4 == 0).alias("requires_source")
    )
    return evals.grounded_sample(rows)


@query(f"{GROUNDED_SQL} SELECT * EXCLUDE (low) FROM k")
def grounded_samples(spark, sf_dir):
    return _samples(spark, sf_dir).select("conv_id", "turn", *evals.GROUNDED_COUNTS)


@query(f"""{GROUNDED_SQL}, w AS (SELECT *, CASE WHEN low = '' THEN [] ELSE string_split(low, ' ') END AS w FROM k), f AS (SELECT conv_id, turn, max(c) AS m FROM (SELECT conv_id, turn, x, count(*) AS c FROM (SELECT conv_id, turn, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY ALL),
b AS (SELECT count(*) FILTER (low = '') AS blank, count(*) FILTER (low <> '' AND {any_of('low', evals.SAMPLE_REFUSALS)}) AS generic_refusal, count(*) FILTER (len(w) >= 6 AND coalesce(m, 0) / greatest(len(w), 1) >= 0.35) AS repetitive,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in evals.GROUNDED_COUNTS)} FROM w LEFT JOIN f USING (conv_id, turn))
SELECT *, blank > 0 OR generic_refusal > 0 OR repetitive >= 2 OR wrong_source_attribution > 0 OR grounded_abstention_fail > 0 OR unsupported_source_tag >= 2 AS collapse_detected,
  array_to_string(list_filter([CASE WHEN blank > 0 THEN 'blank_sample_output' END, CASE WHEN generic_refusal > 0 THEN 'generic_refusal_collapse' END, CASE WHEN repetitive > 0 THEN 'repetitive_sample_collapse' END,
    CASE WHEN unsupported_source_tag >= 2 OR fabricated_fact_pattern >= 2 THEN 'unsupported_grounded_claims' END, CASE WHEN grounded_abstention_fail > 0 THEN 'grounded_abstention_failures' END,
    CASE WHEN wrong_source_attribution > 0 THEN 'source_attribution_failures' END], lambda x: x IS NOT NULL), ',') AS blockers FROM b""")
def sample_behavior(spark, sf_dir):
    return evals.sample_behavior(_samples(spark, sf_dir)).withColumn("blockers", F.array_join("blockers", ","))


_STOPS = """SELECT event_id, event_id % 50 AS step, 1 + event_id % 20 AS per_epoch, event_id % 3 = 0 AS collapse, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS blank, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS abst FROM events"""


@query(f"""WITH s AS ({_STOPS}) SELECT event_id, step > 0 AND collapse AND (blank > 0 OR CASE WHEN abst > 0 THEN step >= greatest(1, ceil(greatest(per_epoch, 1) * 0.5)) ELSE true END) AS counts, step = 0 OR event_id % 97 = 0 OR step = 17 OR (step > 0 AND step % 10 = 0) AS sampled FROM s""")
def qualitative_stops(spark, sf_dir):
    n, zero = F.col("event_id"), F.lit(0)
    rows = table(spark, sf_dir, "events").select(
        "event_id", (n % 50).alias("step"), (1 + n % 20).alias("per_epoch"), (n % 3 == 0).alias("collapse_detected"), (n % 5 == 0).cast("int").alias("blank"), (n % 4 == 0).cast("int").alias("grounded_abstention_fail"),
        zero.alias("generic_refusal"), zero.alias("repetitive"), zero.alias("wrong_source_attribution"), zero.alias("unsupported_source_tag"),
    )
    return rows.select("event_id", evals.counts_as_collapse(F.col("step"), F.col("per_epoch")).alias("counts"), evals.includes_samples(F.col("step"), n % 97 == 0, F.lit(17), 10).alias("sampled"))


@query("""SELECT lang, array_to_string(list_filter([CASE WHEN t < 300 THEN 'dpo_train_dataset_too_small' END, CASE WHEN v < 60 THEN 'dpo_validation_dataset_too_small' END], lambda x: x IS NOT NULL), ',') AS blockers
FROM (SELECT lang, count(*) FILTER (doc_id % 5 <> 0) AS t, count(*) FILTER (doc_id % 5 = 0) AS v FROM documents GROUP BY lang)""")
def dataset_size_blockers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("doc_id") % 5 != 0).alias("t"), F.count_if(F.col("doc_id") % 5 == 0).alias("v"))
    return d.select("lang", F.array_join(evals.size_blockers(F.col("t"), F.col("v"), 300, 60), ",").alias("blockers"))


# --- audits and rollups ----------------------------------------------------------------------------------------------

_LANE = """SELECT source AS lane, lang, count(*) AS examples, avg(quality) AS exactness, avg(toxic) AS citation_rate, avg(CAST(quality + toxic = 0 AS INT)) AS abstention_rate FROM documents JOIN labels USING (doc_id) GROUP BY ALL"""


@query(f"""WITH l AS ({_LANE}) SELECT lane, CAST(sum(examples) AS BIGINT) AS examples, {', '.join(f'round(sum({r} * examples) / greatest(sum(examples), 1), 6) AS {r}' for r in ('exactness', 'citation_rate', 'abstention_rate'))} FROM l GROUP BY lane""")
def lane_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("lane"), "lang")
    lanes = d.agg(F.count(F.lit(1)).alias("examples"), F.avg("quality").alias("exactness"), F.avg("toxic").alias("citation_rate"), F.avg((F.col("quality") + F.col("toxic") == 0).cast("int")).alias("abstention_rate"))
    out = evals.lane_rollup(lanes)
    return out.select("lane", "examples", *[F.round(r, 6).alias(r) for r in ("exactness", "citation_rate", "abstention_rate")])


_TOTALS = {
    "queries": "TRUE", "router_triggers": "user_id % 2 = 0", "retrieval_hits": "value > 10", "present_queries": "event_id % 3 < 2", "retrieval_false_negatives": "event_id % 3 < 2 AND value < 3", "missing_queries": "event_id % 3 = 2",
    "true_missing_answers": "event_id % 3 = 2 AND value < 20", "model_hallucinations_after_no_hit": "event_id % 3 = 2 AND value < 1",
}


@query(f"""WITH t AS (SELECT event_type, {', '.join(f'count(*) FILTER ({c}) AS {k}' for k, c in _TOTALS.items())} FROM events GROUP BY event_type)
SELECT event_type, round(router_triggers / queries, 6) AS router_trigger_rate, round(retrieval_hits / queries, 6) AS retrieval_hit_rate, round((present_queries - retrieval_false_negatives) / present_queries, 6) AS present_query_hit_rate,
  round(retrieval_false_negatives / present_queries, 6) AS retrieval_false_negative_rate, round(true_missing_answers / missing_queries, 6) AS true_missing_rate, round(model_hallucinations_after_no_hit / missing_queries, 6) AS model_hallucination_after_no_hit_rate FROM t""")
def retrieval_audit(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.expr(c)).alias(k) for k, c in _TOTALS.items()])
    rates = ("router_trigger_rate", "retrieval_hit_rate", "present_query_hit_rate", "retrieval_false_negative_rate", "true_missing_rate", "model_hallucination_after_no_hit_rate")
    return evals.retrieval_rates(t).select("event_type", *[F.round(r, 6).alias(r) for r in rates])


_DOMAINS = "CASE conv_id % 6 WHEN 0 THEN 'Webster handbook' WHEN 1 THEN 'faculty_pages' WHEN 2 THEN 'college_guidance' WHEN 3 THEN 'athletics' WHEN 4 THEN 'course' END"


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'stated' WHEN conv_id % 6 = 0 THEN 'handbook_policy' WHEN conv_id % 6 = 1 THEN 'faculty' WHEN conv_id % 6 = 2 THEN 'admissions_general' WHEN conv_id % 6 = 3 THEN 'athletics' WHEN conv_id % 6 = 4 THEN 'course_catalog' ELSE 'chat' END AS x FROM conversations),
p AS (SELECT *, CASE WHEN turn % 2 = 0 THEN x ELSE 'faculty' END AS route, CASE WHEN turn % 3 = 0 THEN x ELSE 'athletics' END AS second FROM e)
SELECT count(*) AS questions, round(avg(CAST(route = x AS INT)), 6) AS route_accuracy, round(avg(CAST(route = x OR second = x AS INT)), 6) AS fanout_recall FROM p""")
def route_audit(spark, sf_dir):
    explicit = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("stated")))
    c = table(spark, sf_dir, "conversations").withColumn("expected", evals.expected_routes(explicit, F.expr(_DOMAINS)))
    first = F.when(F.col("turn") % 2 == 0, F.get("expected", F.lit(0))).otherwise("faculty")
    second = F.when(F.col("turn") % 3 == 0, F.get("expected", F.lit(0))).otherwise("athletics")
    return evals.route_audit(c.withColumn("route", first).withColumn("routes", F.array(first, second)), "route", "expected")


@query("SELECT source, count(*) AS n, round(1.0::DOUBLE / greatest(count(*), 1), 6) AS per_example, count(*) < 8 AS few FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source")
def reliability(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic = 1").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    s = reports.swing(F.col("n"))
    return d.select("source", "n", F.round(s["per_example"], 6).alias("per_example"), s["few"].alias("few"))


_PROMPT = "CASE conv_id % 3 WHEN 0 THEN 'Who is the dean that the page does not name?' WHEN 1 THEN 'Is the prerequisite a recommendation?' ELSE 'Tell about numbers' END"
_ANSWER = "CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(text, '') || ' It is required, not required [Source: x]' WHEN 2 THEN 'The text does not contain enough information about numbers.' ELSE coalesce(text, '') END"


@query(rf"""WITH a AS (SELECT conv_id, turn, {_PROMPT} AS p, {_ANSWER} AS o FROM conversations WHERE role = 'assistant'), l AS (SELECT *, lower(o) AS low, lower(p) AS ap, regexp_extract_all(lower(o), '[A-Za-z0-9'']+') AS w FROM a),
g AS (SELECT conv_id, turn, max(c) AS m FROM (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) - 2)) AS i FROM l WHERE len(w) >= 4)) GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, turn, trim(regexp_replace(o, '^\s+|\s+$', '', 'g')) = '' AS blank, regexp_matches(o, '(?i)\[(source|citation):') AS fake_citation, {any_of('low', ('does not contain enough information', 'cannot answer'))} AND NOT (contains(ap, 'dean') AND contains(ap, 'does not name')) AS over_refusal,
  coalesce(m, 0) >= 3 AS semantic_repetition, len(list_filter(regexp_extract_all(p, '[A-Za-z]{{5,}}')[1:3], lambda x: contains(low, lower(x)))) > 0 AS prompt_retention,
  CASE WHEN contains(ap, 'prerequisite') AND contains(ap, 'recommendation') THEN contains(low, 'required') AND {any_of('low', ('suggested', 'not required'))} END AS context_grounded,
  CASE WHEN contains(ap, 'dean') AND contains(ap, 'does not name') THEN {any_of('low', ('does not contain', 'not name', 'not enough'))} END AS missing_context_honesty, turn % 2 > 0 AS retrieved_chunk_usage,
  len(list_filter(string_split({SQUEEZE.replace("coalesce(text, '')", "o")}, ' '), lambda x: x <> '')) > 90 AS copies_context_too_much, {any_of('low', ('dean is', 'deadline is', 'phone number is'))} AS unsupported_fact_risk
FROM l LEFT JOIN g USING (conv_id, turn)""")
def checkpoint_flags(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(_ASSISTANT)
    return c.select("conv_id", "turn", F.inline(F.array(evals.output_flags(F.expr(_PROMPT), F.expr(_ANSWER), F.col("turn") % 2))))


@query("""SELECT count(*) AS prompts, count(*) FILTER (turn % 3 > 0) AS with_hits, count(*) FILTER (conv_id % 5 = 0) AS output_degenerate, count(*) FILTER (conv_id % 7 = 0) AS abstained, count(*) FILTER (conv_id % 7 <> 0) AS answered,
  count(*) FILTER (turn % 3 > 0 AND conv_id % 7 <> 0) AS grounded, count(*) FILTER (conv_id % 11 = 0) AS fallback FROM conversations""")
def fixed_prompts(spark, sf_dir):
    n, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select((t % 3).alias("hits"), F.when(n % 2 == 0, n % 5 == 0).when(n % 5 == 0, True).alias("output_degenerate"), (n % 7 == 0).alias("abstained"), (n % 7 != 0).alias("answered"), ((t % 3 > 0) & (n % 7 != 0)).alias("grounded"), (n % 11 == 0).alias("fallback"))
    return evals.fixed_prompt_rollup(rows)


@query(rf"""{SQUEEZED}, w AS (SELECT doc_id, regexp_extract_all(lower(t), '[A-Za-z][A-Za-z'']*') AS w FROM d), g AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, round(greatest(0, least(1, 1 - len(list_distinct(w)) / greatest(len(w), 1) + 0.12 * greatest(coalesce(m, 0) - 1, 0))), 6) AS repetition FROM w LEFT JOIN g USING (doc_id)""")
def repetition_scores(spark, sf_dir):
    d = squeezed(spark, sf_dir).select("doc_id", T.letter_words(F.lower("text")).alias("w"))
    return d.select("doc_id", F.round(evals.repetition_score(F.col("w")), 6).alias("repetition"))


@query("""SELECT event_id, round(least(event_id % 40, 40) / 40, 6) AS share, CASE WHEN event_id % 40 > 0 AND value > 0 THEN round((40 - event_id % 40) / (event_id % 40 / value), 4) END AS seconds_left FROM events""")
def run_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40).alias("done"), F.lit(40).alias("total"), F.col("value").cast("double").alias("seconds"))
    return reports.progress(e, "done", "total", "seconds").select("event_id", F.round("share", 6).alias("share"), F.round("seconds_left", 4).alias("seconds_left"))


@query("""WITH f AS (SELECT event_type AS family, round(avg(value), 6) AS loss, round(exp(least(avg(value), 20.0)), 6) AS perplexity, count(*) AS windows FROM events GROUP BY event_type) SELECT *, row_number() OVER (ORDER BY loss, family) AS place FROM f""")
def holdout_ranking(spark, sf_dir):
    return evals.family_ranking(table(spark, sf_dir, "events"), "event_type", "value").withColumnRenamed("event_type", "family").withColumn("place", F.col("place").cast("long"))


@query("""WITH m AS (SELECT user_id % 10 AS run, 0.1 * ((value / 10 - 1) - (event_id % 7 / 7.0 - 1)) AS m FROM events) SELECT run, round(avg(ln(1 + exp(-m))), 6) AS loss, round(avg(CAST(m > 0 AS INT)), 6) AS accuracy, round(avg(m), 6) AS margin FROM m GROUP BY run""")
def preference_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("run"), (F.col("value") / 10).alias("c"), (F.col("event_id") % 7 / 7.0).alias("r"), F.lit(1.0).alias("cb"), F.lit(1.0).alias("rb"))
    return reports.preference_metrics(e, "c", "r", "cb", "rb", by=["run"]).select("run", *[F.round(x, 6).alias(x) for x in ("loss", "accuracy", "margin")])


@query("""WITH s AS (SELECT event_id AS step, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN event_id % 2 = 0 THEN value / 2 END AS b, CASE WHEN event_id % 5 = 0 THEN value * 2 END AS p FROM events)
SELECT step, round(coalesce(a, b), 6) AS loss, round(coalesce(p, exp(least(coalesce(a, b), 13.8))), 4) AS perplexity FROM s WHERE coalesce(a, b, p) IS NOT NULL""")
def loss_series(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    h = table(spark, sf_dir, "events").select(n.alias("step"), F.when(n % 3 == 0, v).alias("a"), F.when(n % 2 == 0, v / 2).alias("b"), F.when(n % 5 == 0, v * 2).alias("p"))
    return evals.series(h, "step", ["a", "b"], ["p"]).select("step", F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'train.lr' WHEN 1 THEN 'loss.value' WHEN 2 THEN 'eval.margin_mean' WHEN 3 THEN 'base_learning_rate.x' ELSE 'rate' END AS key, CASE event_id % 5 WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 8 ELSE 2 END AS n FROM events)
SELECT event_id, key, n AS decimals, CASE WHEN n = 2 THEN CAST(round_even(CAST((event_id % 1000) / 8.0 AS DOUBLE), 2) AS DOUBLE) ELSE CAST((event_id % 1000) / 8.0 AS DOUBLE) END AS shown FROM e""")
def output_rounding(spark, sf_dir):
    n = F.col("event_id") % 5
    key = F.when(n == 0, "train.lr").when(n == 1, "loss.value").when(n == 2, "eval.margin_mean").when(n == 3, "base_learning_rate.x").otherwise("rate")
    e = table(spark, sf_dir, "events").select("event_id", key.alias("key"), (F.col("event_id") % 1000 / 8.0).alias("v"))
    return e.select("event_id", "key", evals.output_precision(F.col("key")).alias("decimals"), evals.rounded_output(F.col("v"), F.col("key")).alias("shown"))


_OUTPUTS = "SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'It does not contain enough information.' ELSE coalesce(text, '') END AS t FROM conversations WHERE role = 'assistant'"


@query(f"""WITH o AS ({_OUTPUTS}), p AS (SELECT *, lower(t) LIKE '%does not contain enough information%' OR turn % 9 = 1 AS ab, conv_id % 4 = 0 AS weak, conv_id % 5 = 0 AS fb, conv_id % 8 = 0 AS failed, turn % 3 AS hits FROM o),
g AS (SELECT *, trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) <> '' AND NOT ab AS gen FROM p)
SELECT 'Generated' AS outcome, count(*) FILTER (gen) AS n FROM g UNION ALL SELECT 'Generated with sources', count(*) FILTER (gen AND hits > 0) FROM g UNION ALL SELECT 'Weak generation', count(*) FILTER (weak) FROM g
UNION ALL SELECT 'Abstained', count(*) FILTER (ab) FROM g UNION ALL SELECT 'Generation failed', count(*) FILTER (failed OR fb AND weak) FROM g""".replace("\\\\", "\\"))
def output_outcomes(spark, sf_dir):
    n, t = F.col("conv_id"), F.coalesce("text", F.lit(""))
    text = F.when(n % 6 == 0, "").when(n % 6 == 1, "It does not contain enough information.").otherwise(t)
    status = F.struct((F.col("turn") % 9 == 1).alias("abstained"), (n % 8 == 0).alias("generation_failed"), F.when(n % 5 == 0, "Fallback used").otherwise("Answered").alias("final_label"))
    rows = table(spark, sf_dir, "conversations").filter(_ASSISTANT).select(text.alias("response"), status.alias("status"), (n % 4 == 0).alias("output_degenerate"), (F.col("turn") % 3).alias("retrieved_hit_count"))
    return evals.outcome_counts(rows)


@query(f"""WITH o AS ({_OUTPUTS}) SELECT 'after' AS source, 'p' || conv_id AS prompt, t AS text, 'r' AS reasons FROM o WHERE t <> '' UNION ALL SELECT 'demo', 'prompt', t, '' FROM o WHERE t <> '' AND turn % 2 = 1""")
def output_case_union(spark, sf_dir):
    n, t = F.col("conv_id"), F.coalesce("text", F.lit(""))
    text = F.when(n % 6 == 0, "").when(n % 6 == 1, "It does not contain enough information.").otherwise(t)
    rows = table(spark, sf_dir, "conversations").filter(_ASSISTANT)
    after = rows.select(F.concat(F.lit("p"), n).alias("asked"), text.alias("text"), F.array(F.lit("r")).alias("quality_reasons"))
    demo = rows.filter("turn % 2 = 1").select(F.struct(text.alias("text")).alias("response"), F.lit(None).cast("string").alias("q"))
    out = evals.output_cases([("after", after), ("demo", demo)], {"after": {"prompt": "asked", "text": "text", "reasons": "quality_reasons"}, "demo": {"prompt": "q", "text": "response.text"}})
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{ROLLUP_SQL}, h AS (SELECT lang, CAST(count(*) AS BIGINT) AS examples, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 AND lang <> 'fr' GROUP BY lang)
SELECT lang, r.examples AS examples_a, h.examples AS examples_b, r.quality AS quality_a, h.quality AS quality_b, h.examples - r.examples AS examples_delta, round(h.quality - r.quality, 6) AS quality_delta FROM r FULL JOIN h USING (lang)""")
def checkpoint_comparison(spark, sf_dir):
    a = evals.weighted_average(_lanes(spark, sf_dir), ["lang"], ["quality", "toxic"], "examples")
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0 AND lang <> 'fr'").join(table(spark, sf_dir, "labels"), "doc_id")
    b = d.groupBy("lang").agg(F.count(F.lit(1)).alias("examples"), F.round(F.avg("quality"), 6).alias("quality"))
    out = evals.checkpoint_deltas(a, b, ["lang"], ["examples", "quality"])
    return out.withColumn("quality_delta", F.round("quality_delta", 6))


@query("""WITH a AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0.5 END AS threshold, CASE conv_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS score, conv_id % 5 = 0 AS exact, turn % 2 = 0 AS cited FROM conversations)
SELECT count(*) AS examples, round(avg(score), 6)::DOUBLE AS average_score, round(avg(CAST(score >= coalesce(threshold, 1.0) AS INT)), 6) AS pass_rate, round(avg(CAST(exact AS INT)), 6) AS exact_rate, round(avg(CAST(cited AS INT)), 6) AS citation_rate FROM a""")
def assistant_benchmark(spark, sf_dir):
    n = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(F.when(n % 3 == 0, 0.5).alias("threshold"), F.when(n % 4 == 0, 1.0).when(n % 4 == 1, 0.5).otherwise(0.0).alias("score"), (n % 5 == 0).alias("exact"), (F.col("turn") % 2 == 0).alias("cited"))
    out = evals.assistant_benchmark(rows)
    return out.select("examples", *[F.round(c, 6).alias(c) for c in out.columns if c != "examples"])


@query(rf"""SELECT conv_id, turn, trim(replace(replace(replace(CASE WHEN contains(t, 'STOP') THEN left(t, strpos(t, 'STOP') - 1) ELSE t END, '</s>', ''), '<pad>', ''), '<unk>', '')) AS cleaned FROM (SELECT conv_id, turn, '<pad> ' || left(coalesce(text, ''), 40) || '</s>' || CASE WHEN turn % 2 = 0 THEN ' STOP rest' ELSE ' tail' END AS t FROM conversations)""")
def cleaned_responses(spark, sf_dir):
    t = F.concat(F.lit("<pad> "), F.left(F.coalesce("text", F.lit("")), F.lit(40)), F.lit("</s>"), F.when(F.col("turn") % 2 == 0, " STOP rest").otherwise(" tail"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evals.clean_response(t, ["STOP"]).alias("cleaned"))


@query(rf"""{SQUEEZED}, p AS (SELECT doc_id, t, strpos(t, 'the') AS pos FROM d) SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(left(t, 60)) || '...' END AS excerpt, CASE WHEN pos > 0 THEN substr(t, greatest(1, pos - 36), pos + 3 + 36 - greatest(1, pos - 36)) END AS context FROM p""")
def excerpts(spark, sf_dir):
    d = squeezed(spark, sf_dir)
    return d.select("doc_id", T.excerpt(F.col("text"), 60).alias("excerpt"), T.context_around(F.col("text"), F.lit("the"), 36).alias("context"))


@query(rf"""{PREPARED}, rj AS (SELECT source, drop_reason, doc_id, row_number() OVER (PARTITION BY source, drop_reason ORDER BY doc_id) AS n FROM p WHERE drop_reason IS NOT NULL),
k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS total FROM p WHERE drop_reason IS NULL),
e AS (SELECT DISTINCT source, CAST(round_even(j * (total - 1) / greatest(least(30, total) - 1, 1)::DOUBLE, 0) AS BIGINT) AS i FROM (SELECT DISTINCT source, total FROM k), range(0, 30) AS g(j) WHERE j < total)
SELECT source, drop_reason AS kind, doc_id FROM rj WHERE n <= 10 UNION ALL SELECT source, 'accepted', doc_id FROM k JOIN e USING (source, i)""")
def captured_samples(spark, sf_dir):
    return audit.captured_samples(prepared(spark, sf_dir), "doc_id")


@query(rf"""{PREPARED} SELECT 'source ' || source || ': ' || count(*) FILTER (drop_reason IS NULL) || ' kept of ' || count(*) AS line FROM p GROUP BY source UNION ALL SELECT 'total: ' || count(*) FILTER (drop_reason IS NULL) || ' kept of ' || count(*) FROM p
UNION ALL SELECT line FROM (SELECT 'reject ' || drop_reason || ': ' || count(*) AS line FROM p WHERE drop_reason IS NOT NULL GROUP BY drop_reason ORDER BY count(*) DESC, drop_reason LIMIT 3)""")
def console_report(spark, sf_dir):
    return reports.console_lines(prepared(spark, sf_dir), 3)


@query("""SELECT kind, reason, CAST(n AS BIGINT) AS n FROM (SELECT 'manifest' AS kind, lang AS reason, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) UNION ALL SELECT 'fallback', 'rejected', 5""")
def rejection_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").groupBy(F.col("lang").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    fallback = spark.createDataFrame([("rejected", 5)], "reason string, n long")
    first = reports.first_counts([d, fallback]).select(F.lit("manifest").alias("kind"), "reason", "n")
    return first.union(reports.first_counts([d.filter("false"), fallback]).select(F.lit("fallback"), "reason", "n"))


@query("""SELECT source, CASE WHEN source IN ('src0', 'src3') OR right(source, 1) = '7' THEN 'domain' ELSE 'broad' END AS class, CASE WHEN right(source, 1) = '7' THEN true ELSE source = 'src0' END AS gated FROM (SELECT DISTINCT source FROM documents)""")
def source_classes(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("source", F.right("source", F.lit(1)).alias("family")).distinct()
    domain = audit.named_or_family(F.col("source"), F.col("family"), ["src0", "src3"], ["7"])
    return s.select("source", F.when(domain, "domain").otherwise("broad").alias("class"), audit.named_or_family(F.col("source"), F.col("family"), ["src0"], ["7"]).alias("gated"))


@query("""SELECT item_id, regexp_replace(regexp_replace(lower(left(text, 30)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'x-' || left(sha256('["' || item_id || '","b"]'), 24) AS id,
  CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'v' || item_id END AS given, coalesce(CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'v' || item_id END, 'unspecified') AS tier FROM benchmark""")
def keys_and_defaults(spark, sf_dir):
    from textloom.operators.web import stable_id

    n = F.col("item_id")
    raw = F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit(" v"), n, F.lit(" ")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.slug(F.left("text", F.lit(30))).alias("slug"), stable_id("x", n, F.lit("b")).alias("id"), T.nonempty(raw).alias("given"), F.coalesce(T.nonempty(raw), F.lit("unspecified")).alias("tier"))


@query("""WITH e AS (SELECT event_id, event_type, user_id, value, CASE WHEN value < 2.0 THEN 'severe' WHEN value < 5.0 THEN 'suspicious' WHEN value < 10.0 THEN 'broad' END AS tier FROM events), k AS (SELECT * FROM e WHERE tier IS NOT NULL)
SELECT 'source' AS kind, name, n FROM (SELECT event_type AS name, count(*) AS n FROM k GROUP BY event_type ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT 'contributor', name, n FROM (SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM k GROUP BY user_id ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT 'least', 'all', (SELECT arg_min(event_id, struct_pack(v := value, i := event_id)) FROM k) UNION ALL SELECT 'least', tier, arg_min(event_id, struct_pack(v := value, i := event_id)) FROM k GROUP BY tier""")
def low_loss_summary(spark, sf_dir):
    e = evals.event_tiers(table(spark, sf_dir, "events"), "value", TIERS)
    return evals.low_loss_summary(e, {"source": "event_type", "contributor": "user_id"}, "value", "event_id", 10)


@query(rf"""WITH RECURSIVE {PREPARED.strip().removeprefix("WITH")}, sc AS (SELECT source, count(*) FILTER (drop_reason IS NULL) AS documents, sum(n) FILTER (drop_reason IS NULL) AS tokens FROM p GROUP BY source),
cp AS (SELECT list(c ORDER BY source) AS caps, list(source ORDER BY source) AS names, count(*) AS k FROM (SELECT source, documents / (1 - 0.35::DOUBLE) * round(tokens / greatest(documents, 1), 2) AS c FROM sc)),
st AS (SELECT 1::BIGINT AS i, 200000::DOUBLE AS rem, 1::DOUBLE AS weight, list_transform(caps, lambda x: false) AS shut, list_transform(caps, lambda x: 0::DOUBLE) AS got, false AS capped, false AS done, 0 AS step FROM cp
  UNION ALL SELECT CASE WHEN i <= k THEN i + 1 ELSE 1 END, CASE WHEN full_now THEN rem - caps[i] ELSE rem END, CASE WHEN i > k THEN len(list_filter(shut, lambda x: NOT x)) / k ELSE weight END,
    CASE WHEN full_now THEN list_transform(shut, lambda x, j: x OR j = i) ELSE shut END,
    CASE WHEN full_now THEN list_transform(got, lambda x, j: CASE WHEN j = i THEN caps[i] ELSE x END) WHEN i > k AND NOT capped THEN list_transform(got, lambda x, j: CASE WHEN shut[j] THEN x ELSE rem / k / weight END) ELSE got END,
    CASE WHEN i > k THEN false ELSE capped OR full_now END, i > k AND (NOT capped OR rem <= 0 OR len(list_filter(shut, lambda x: NOT x)) = 0), step + 1
  FROM (SELECT *, i <= k AND NOT coalesce(shut[i], true) AND rem / k / weight > coalesce(caps[i], 0) + 1e-8 AS full_now FROM st, cp) WHERE NOT done)
SELECT unnest(names) AS source, round(unnest(caps), 4) AS capacity, round(unnest(got), 4) AS tokens FROM st, cp WHERE done""")
def capacity_allocation(spark, sf_dir):
    report = audit.source_report(prepared(spark, sf_dir)).select("source", "documents", "average_tokens").orderBy("source").collect()  # a row per source
    caps = {r["source"]: audit.realizable(r["documents"], r["average_tokens"], 0.35) for r in report}
    got = audit.allocate(200_000, {r["source"]: 1 / len(report) for r in report}, caps)
    return spark.createDataFrame([(s, round(float(caps[s]), 4), round(float(got[s]), 4)) for s in sorted(got)], "source string, capacity double, tokens double")
