"""Driver queries of the stage builders, full reports, prepared targets, trust and raw samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.operators import audit, chat, evals, rawlm, retrieve
from textloom.plans import lists as L
from textloom.plans import stages
from textloom.queries import _buckets, _chunks, _conversations, BUCKETS_SQL, INDEX_SQL, PREPARED, SCRUB, SIGNATURE, WORDS, prepared, query, table
from textloom.queries_chat import TOKENS_OF
from textloom.queries_rules import _ARTIFACTS, _PHRASES, quoted
from textloom.sources import sinks


def _sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("record_no"), "text")
    return [stages.Source(s, d.filter(F.col("source") == s).drop("source"), deduplicate=s != "src2") for s in ("src1", "src0", "src2")]


#: Three sources in an order of their own, the last of which takes no part in deduplication.
SOURCES_SQL = rf"""d AS (SELECT doc_id, source, text AS raw, CASE source WHEN 'src1' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END AS source_no, {SCRUB} AS t FROM documents WHERE source IN ('src0', 'src1', 'src2')),
r AS (SELECT *, {WORDS} AS n, CASE WHEN length(t) < 128 THEN 'too_short' WHEN length(t) > 200000 THEN 'too_long' WHEN length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(length(t), 1) < 0.2 THEN 'low_alpha_ratio'
  WHEN (length(t) - length(replace(t, 'http', ''))) / 4 > 100 THEN 'too_many_urls' END AS reason FROM d),
p AS (SELECT * EXCLUDE (reason), CASE WHEN reason IS NULL AND source <> 'src2' AND row_number() OVER (PARTITION BY t, reason IS NULL AND source <> 'src2' ORDER BY source_no, doc_id) > 1 THEN 'exact_duplicate' ELSE reason END AS drop_reason FROM r)"""


@query(f"WITH {SOURCES_SQL} SELECT source, doc_id AS record_no, drop_reason FROM p")
def judged_sources(spark, sf_dir):
    return stages.judged_sources(_sources(spark, sf_dir)).select("source", "record_no", "drop_reason")


@query(f"""WITH RECURSIVE {SOURCES_SQL}, kp AS (SELECT source, t, n, row_number() OVER (ORDER BY source_no, doc_id) - 1 AS place FROM p WHERE drop_reason IS NULL AND n > 1),
q AS (SELECT place, source, n + 1 AS n, shard, row_number() OVER (PARTITION BY shard ORDER BY place) AS k FROM (SELECT *, ('0x' || left(md5(CAST(place AS VARCHAR)), 8))::BIGINT % 4 AS shard FROM kp)),
st AS (SELECT DISTINCT shard, 0::BIGINT AS k, 0::BIGINT AS w, 0::BIGINT AS f, 0::BIGINT AS np, 0::BIGINT AS g, NULL::BIGINT AS begun, NULL::BIGINT AS shut, NULL::BIGINT AS shut_at FROM q
  UNION ALL SELECT st.shard, q.k, CASE WHEN q.n > 256 THEN w + (q.n - 1) // 256 + 1 WHEN f + q.n > 256 AND np > 0 THEN w + 1 ELSE w END, CASE WHEN q.n > 256 THEN f WHEN f + q.n > 256 AND np > 0 THEN q.n ELSE f + q.n END,
    CASE WHEN q.n > 256 THEN np WHEN f + q.n > 256 AND np > 0 THEN 1 ELSE np + 1 END, CASE WHEN q.n <= 256 AND f + q.n > 256 AND np > 0 THEN g + 1 ELSE g END, CASE WHEN q.n > 256 THEN w END,
    CASE WHEN q.n <= 256 AND f + q.n > 256 AND np > 0 THEN g END, CASE WHEN q.n <= 256 AND f + q.n > 256 AND np > 0 THEN w END FROM st JOIN q ON q.shard = st.shard AND q.k = st.k + 1),
sh AS (SELECT shard, shut AS g, shut_at AS win FROM st WHERE shut IS NOT NULL UNION ALL SELECT shard, arg_max(g, k), arg_max(w, k) FROM st GROUP BY shard),
pt AS (SELECT st.shard, win, st.np - 1 AS part, q.place, 0::BIGINT AS a, CAST(q.n AS BIGINT) AS b FROM st JOIN q ON q.shard = st.shard AND q.k = st.k JOIN sh ON sh.shard = st.shard AND sh.g = st.g WHERE st.k > 0 AND q.n <= 256
  UNION ALL SELECT shard, begun + i, 0, place, i * 256, least(n, (i + 1) * 256) FROM (SELECT st.shard, begun, place, n, unnest(range(0, (n - 1) // 256 + 1)) AS i FROM st JOIN q ON q.shard = st.shard AND q.k = st.k WHERE st.k > 0 AND q.n > 256)),
pw AS (SELECT * FROM pt QUALIFY sum(b - a) OVER (PARTITION BY shard, win) >= 3), ids AS (SELECT place, source, list_concat(string_split(t, ' '), ['</s>']) AS ids FROM kp)
SELECT shard, win AS "window", count(*) AS packed_document_count, md5(array_to_string(list_resize(flatten(list(ids[a + 1 : b] ORDER BY part)), 256, '<pad>'), ' ')) AS ids, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM pw JOIN ids USING (place) GROUP BY ALL""")
def pretrain_stage(spark, sf_dir):
    w = stages.pretrain_windows(_sources(spark, sf_dir), 256, 4)
    return w.select("shard", "window", F.col("packed_document_count").cast("long").alias("packed_document_count"), F.md5(F.array_join("ids", " ")).alias("ids"), F.array_join(F.array_sort("source_names"), ",").alias("sources"))


SFT_SQL = f"""{BUCKETS_SQL}, tk AS (SELECT conv_id, turn, role, text, list_concat(list_concat(['<|' || role || '|>'], {TOKENS_OF}), ['</s>']) AS ids FROM conversations),
lb AS (SELECT *, CASE WHEN role = 'assistant' THEN list_concat(['-100'], ids[2:]) ELSE list_transform(ids, lambda x: '-100') END AS labels FROM tk),
g AS (SELECT conv_id, flatten(list(ids ORDER BY turn, role, text))[1:128] AS ids, flatten(list(labels ORDER BY turn, role, text))[1:128] AS labels FROM lb GROUP BY conv_id),
k AS (SELECT g.*, bucket FROM g JOIN b USING (conv_id) JOIN a USING (conv_id) WHERE a NOT IN ('i can''t help with that.', 'i cannot help with that.', 'i''m sorry, i can''t help with that.') AND NOT (bucket = 'informative_abstention' AND len(list_filter(labels, lambda x: x <> '-100')) < 24)),
o AS (SELECT *, row_number() OVER (ORDER BY md5('17:' || conv_id), conv_id) - 1 AS before, count(*) OVER () AS total FROM k)"""


@query(f"""{SFT_SQL} SELECT conv_id, bucket, before < greatest(1, CAST(round_even(total * 0.2, 0) AS BIGINT)) AND before + 1 < total AS is_validation, md5(array_to_string(list_resize(ids, 128, '<pad>'), ' ')) AS ids, md5(array_to_string(list_resize(labels, 128, '-100'), ' ')) AS labels FROM o""")
def sft_stage(spark, sf_dir):
    c = _conversations(spark, sf_dir).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))))
    out = stages.sft_examples(c, 128, 0.2, 17)
    return out.select("conv_id", "bucket", "is_validation", F.md5(F.array_join("ids", " ")).alias("ids"), F.md5(F.array_join("labels", " ")).alias("labels"))


@query(f"""{SFT_SQL}, r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS row FROM o) SELECT conv_id, row // 16 AS shard_index, row % 16 AS row_index FROM r""")
def sft_shards(spark, sf_dir):
    c = _conversations(spark, sf_dir).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))))
    folder = f"{sinks.shared_folder(spark)}/sft-{uuid.uuid4().hex}"
    sinks.write_prepared(sinks.with_shards(stages.sft_examples(c, 128, 0.2, 17), ["conv_id"], 16), folder, "sft", {"size": 128}, 16)
    return sinks.read_prepared(spark, folder, "sft").select("conv_id", F.col("shard_index").cast("long").alias("shard_index"), "row_index")


_PREFERENCE_ROWS = """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'human_reviewed' WHEN 1 THEN 'bad' ELSE 'model_reviewed' END AS tier, CASE conv_id % 3 WHEN 0 THEN 'over_refusal' ELSE 'unspecified' END AS negative_type FROM (SELECT DISTINCT conv_id FROM conversations)"""


@query(f"WITH p AS ({_PREFERENCE_ROWS}), k AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS row FROM p WHERE tier <> 'bad') SELECT conv_id AS id, tier, negative_type, row // 8 AS shard_index, row % 8 AS row_index, 64 AS n_chosen, 64 AS n_rejected FROM k")
def preference_shards(spark, sf_dir):
    n = F.col("conv_id")
    rows = _conversations(spark, sf_dir).select(
        n.alias("id"), F.filter("messages", lambda m: m["role"] != "assistant").alias("messages"), F.lit("yes it is").alias("chosen"), F.lit("no").alias("rejected"),
        F.when(n % 4 == 0, "human_reviewed").when(n % 4 == 1, "bad").when(n % 4 == 2, " ").alias("tier"), F.when(n % 3 == 0, "over_refusal").alias("negative_type"),
    )
    made = stages.preference_examples(rows, 64, ["human_reviewed", "model_reviewed"], ["over_refusal", "unspecified"])
    folder = f"{sinks.shared_folder(spark)}/preference-{uuid.uuid4().hex}"
    sinks.write_prepared(sinks.with_shards(made, ["id"], 8), folder, "preference", {"size": 64}, 8)
    got = sinks.read_prepared(spark, folder, "preference")
    return got.select("id", "tier", "negative_type", F.col("shard_index").cast("long").alias("shard_index"), "row_index", F.size("chosen").alias("n_chosen"), F.size("rejected").alias("n_rejected"))


_SUMS = ", ".join(f"CAST(sum({e}) AS BIGINT) AS {k}" for k, e in _ARTIFACTS.items())
REPORT_SQL = rf"""{PREPARED}, b AS (SELECT source, count(*) AS raw_records, count(*) FILTER (drop_reason IS NULL) AS kept_documents, count(*) FILTER (drop_reason = 'exact_duplicate') AS duplicates, count(*) FILTER (drop_reason IS NOT NULL) AS dropped FROM p GROUP BY source),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS kept_tokens, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(t, '[.!?]+(?:\s+|$)'))) AS BIGINT) AS sentences, count(*) FILTER (t <> '') AS paragraphs FROM p WHERE drop_reason IS NULL GROUP BY source),
sg AS (SELECT source, {SIGNATURE} AS k, count(*) AS c FROM p WHERE drop_reason IS NULL GROUP BY ALL),
nr AS (SELECT source, count(*) FILTER (c > 1) AS near_duplicate_clusters, max(c) AS largest_cluster, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS near_duplicate_documents, CAST(sum(c - 1) AS BIGINT) AS normalized_duplicates FROM sg WHERE k <> '' GROUP BY source),
ar AS (SELECT source, sum(n) AS n, {_SUMS} FROM (SELECT source, n, lower(t) AS low FROM p WHERE drop_reason IS NULL) GROUP BY source),
ad AS (SELECT source, {', '.join(f'round({k} / greatest(n, 1), 6) AS {k}' for k in _ARTIFACTS)} FROM ar),
ls AS (SELECT source, lower(coalesce(text, '')) AS low FROM documents), ph AS ({_PHRASES}), sc AS (SELECT source, CAST(sum(occurrences) AS BIGINT) AS scaffold_phrases FROM ph GROUP BY source),
kw AS (SELECT doc_id, source, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w FROM p WHERE drop_reason IS NULL),
gg AS (SELECT source, doc_id, k, lim, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT source, doc_id, w, v.k, lim, unnest(range(1, len(w) - v.k + 2)) AS i FROM kw, (VALUES (4, 8), (8, 6), (12, 4), (20, 3)) AS v(k, lim) WHERE len(w) >= v.k)),
gf AS (SELECT source, doc_id, k, lim, g, min(i) AS i FROM gg GROUP BY ALL), gl AS (SELECT source, k, g FROM gf QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) <= lim),
gt AS (SELECT source, k, max(c) AS c FROM (SELECT source, k, g, count(*) AS c FROM gl GROUP BY ALL) GROUP BY ALL), gw AS (SELECT source, {', '.join(f'max(c) FILTER (k = {k}) AS top_{k}gram' for k in (4, 8, 12, 20))} FROM gt GROUP BY source),
rp AS (SELECT b.source, raw_records, kept_documents, duplicates, dropped, coalesce(kept_tokens, 0) AS kept_tokens, coalesce(near_duplicate_clusters, 0) AS near_duplicate_clusters, coalesce(largest_cluster, 0) AS largest_cluster, coalesce(normalized_duplicates, 0) AS normalized_duplicates,
  {', '.join(f'coalesce({k}, 0) AS {k}' for k in _ARTIFACTS)}, round(least(1.0, coalesce(medical_body_health, 0) + 2 * coalesce(navigation_like_text, 0) + 4 * (coalesce(excessive_hyphen_fragments, 0) + coalesce(broken_quote_fragments, 0)) + 2 * coalesce(generic_article_formula, 0)), 6) AS junk_score,
  coalesce(scaffold_phrases, 0) AS scaffold_phrases, {', '.join(f'coalesce(top_{k}gram, 0) AS top_{k}gram' for k in (4, 8, 12, 20))}, round(chars / greatest(kept_documents, 1), 2) AS avg_document_chars, round(kept_tokens / greatest(kept_documents, 1), 2) AS avg_document_words,
  round(sentences / greatest(kept_documents, 1), 2) AS avg_sentences_per_document, round(paragraphs / greatest(kept_documents, 1), 2) AS avg_paragraphs_per_document, round(kept_tokens / greatest(sentences, 1), 2) AS avg_sentence_words,
  round(coalesce(near_duplicate_documents, 0) / greatest(kept_documents, 1), 6) AS near_duplicate_ratio, round(duplicates / greatest(kept_documents, 1), 6) AS repeat_rate
  FROM b LEFT JOIN s USING (source) LEFT JOIN nr USING (source) LEFT JOIN ad USING (source) LEFT JOIN sc USING (source) LEFT JOIN gw USING (source))"""


def _report(spark, sf_dir):
    return stages.full_report(prepared(spark, sf_dir))


@query(f"{REPORT_SQL} SELECT * FROM rp")
def full_source_report(spark, sf_dir):
    return _report(spark, sf_dir).drop("chars", "sentences", "paragraphs", "near_duplicate_documents")


_AVG = ("avg_document_chars", "avg_document_words", "avg_sentences_per_document", "avg_paragraphs_per_document", "avg_sentence_words")


@query(f"""{REPORT_SQL}, o AS (SELECT CAST(sum(kept_tokens) AS BIGINT) AS tokens, CAST(sum(kept_documents) AS BIGINT) AS documents, round(max(kept_tokens) / greatest(sum(kept_tokens), 1), 6) AS max_source_share, max(repeat_rate) AS max_repeat_rate, {', '.join(f'max(top_{k}gram) AS top_{k}gram' for k in (4, 8, 12, 20))},
  max(largest_cluster) AS largest_cluster, CAST(sum(scaffold_phrases) AS BIGINT) AS scaffold_phrases, CAST(sum(normalized_duplicates) AS BIGINT) AS normalized_duplicates, {', '.join(f'round(sum({c} * kept_documents) / greatest(sum(kept_documents), 1), 2) AS {c}' for c in _AVG)}, max(junk_score) AS max_junk_score FROM rp)
SELECT *, array_to_string(list_filter([CASE WHEN max_source_share > 0.45 THEN 'single_source_token_share_above_local_mvp_limit' END, CASE WHEN top_4gram > 8000 THEN 'repeated_phrase_count_above_local_mvp_limit' END, CASE WHEN top_8gram > 4000 THEN 'repeated_8gram_count_above_local_mvp_limit' END,
  CASE WHEN top_12gram > 2500 THEN 'repeated_12gram_count_above_local_mvp_limit' END, CASE WHEN scaffold_phrases > 0 THEN 'synthetic_meta_phrase_observed' END, CASE WHEN largest_cluster > 1 THEN 'near_duplicate_clusters_detected' END, CASE WHEN max_junk_score > 0 THEN 'quality_artifacts_detected' END], lambda x: x IS NOT NULL), ',') AS warnings FROM o""")
def corpus_diagnostics(spark, sf_dir):
    return stages.corpus_diagnostics(_report(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", ","))


@query(f"""{PREPARED}, b AS (SELECT source, count(*) AS raw_records, count(*) FILTER (drop_reason IS NULL) AS kept_documents, count(*) FILTER (drop_reason = 'exact_duplicate') AS duplicates, CAST(coalesce(sum(n) FILTER (drop_reason IS NULL), 0) AS BIGINT) AS kept_tokens FROM p GROUP BY source)
SELECT source, raw_records * 2 AS raw_records, kept_documents * 2 AS kept_documents, kept_tokens * 2 AS kept_tokens, duplicates * 2 AS duplicates, round(duplicates / greatest(kept_documents, 1), 6) AS repeat_rate, round(kept_tokens / greatest(kept_documents, 1), 2) AS avg_document_words FROM b""")
def prepared_manifest_audit(spark, sf_dir):
    report = audit.source_report(prepared(spark, sf_dir)).select("source", "raw_records", F.col("documents").alias("kept_documents"), F.col("tokens").alias("kept_tokens"), "duplicates")
    folder = f"{sinks.shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    for _ in range(2):  # two manifests of the same sources
        sinks.append_history(report, folder)
    return stages.merged_reports(spark.read.parquet(folder))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT event_id AS position, doc_id, source FROM events JOIN r ON k = event_id % 997 % n WHERE event_id % 10 = 0""")
def indexed_examples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    wanted = table(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.col("event_id").alias("position"), (F.col("event_id") % 997 % d.count()).alias("index"))
    return stages.by_index(d, wanted, ["doc_id"]).select("position", "doc_id", "source")


@query("""SELECT * FROM (VALUES ('nothing', 'fresh'), ('same', 'reuse'), ('resumable', 'resume'), ('forced', 'rebuild'), ('other kind', 'error'), ('other input', 'error'), ('partial', 'error'), ('other resume', 'error'), ('empty', 'fresh')) AS t("case", outcome)""")
def prepared_targets(spark, sf_dir):
    rows = sinks.with_shards(table(spark, sf_dir, "region").select("r_regionkey"), ["r_regionkey"], 2)
    base, out = f"{sinks.shared_folder(spark)}/targets-{uuid.uuid4().hex}", []

    def outcome(name, folder, kind, config, **options):
        try:
            out.append((name, sinks.resolve_target(spark, f"{base}/{folder}", kind, config, **options)))
        except ValueError:
            out.append((name, "error"))

    sinks.write_prepared(rows, f"{base}/done", "packed_lm", {"a": 1}, 2)
    sinks.save_progress(spark, f"{base}/half", "sft", {"a": 1}, {"consumed": 10})
    rows.write.parquet(f"{base}/part/rows")
    spark.range(0).select(F.lit("").alias("value")).write.text(f"{base}/empty/manifest")
    outcome("nothing", "none", "sft", {"a": 1})
    outcome("same", "done", "packed_lm", {"a": 1})
    outcome("resumable", "half", "sft", {"a": 1})
    outcome("forced", "done", "sft", {"a": 2}, force=True)
    outcome("other kind", "done", "sft", {"a": 1})
    outcome("other input", "done", "packed_lm", {"a": 2})
    outcome("partial", "part", "packed_lm", {"a": 1})
    outcome("other resume", "half", "sft", {"a": 2})
    outcome("empty", "empty", "sft", {"a": 1})
    return spark.createDataFrame(out, "case string, outcome string")


@query("SELECT r_regionkey AS k, sha256('{\"name\":\"' || r_name || '\",\"size\":' || r_regionkey || '}') AS fingerprint, r_regionkey % 2 = 0 AS reusable FROM region")
def config_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # 5 rows
    configs = [{"size": r.r_regionkey, "name": r.r_name} for r in rows]
    stored = [c if r.r_regionkey % 2 == 0 else c | {"size": -1} for r, c in zip(rows, configs)]
    return spark.createDataFrame([(r.r_regionkey, sinks.fingerprint(c), sinks.fingerprint(s) == sinks.fingerprint(c)) for r, c, s in zip(rows, configs, stored)], table(spark, sf_dir, "region").selectExpr("r_regionkey AS k", "'' AS fingerprint", "true AS reusable").schema)


@query(f"{INDEX_SQL} SELECT c.chunk_id, sha256(chunk) AS sha256, word_count, st.length, (SELECT count(*) FROM po WHERE po.chunk_id = c.chunk_id) AS terms FROM c JOIN st USING (chunk_id)")
def rag_export(spark, sf_dir):
    """Chunks and their index as JSON lines, written and read back."""
    chunks = _chunks(spark, sf_dir).select("chunk_id", F.col("chunk").alias("text"), "word_count").withColumn("sha256", F.sha2("text", 256))
    base = f"{sinks.shared_folder(spark)}/rag-{uuid.uuid4().hex}"
    written = sinks.export_examples(chunks, f"{base}/chunks")
    postings, _, stats = retrieve.build_index(written)
    index = postings.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("terms")).join(stats, "chunk_id", "right")
    stored = sinks.export_examples(index, f"{base}/index")
    return written.join(stored, "chunk_id").select("chunk_id", "sha256", "word_count", "length", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("terms"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'dev_only' ELSE 'promotable' END AS artifact_status, page_id % 4 = 3 AS promotion_eligible, CASE page_id % 4 WHEN 3 THEN '' WHEN 0 THEN 'artifact_trust' WHEN 1 THEN 'stage_summary' ELSE 'checkpoint_metadata' END AS source,
  CASE page_id % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'pretrain' END AS stage FROM pages""")
def artifact_trust(spark, sf_dir):
    n = F.col("page_id")
    payload = lambda cond, **values: F.when(cond, F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()])))
    rows = table(spark, sf_dir, "pages").select(
        "page_id", payload(n % 4 == 0, artifact_status="blocked", promotion_eligible=False).alias("artifact_trust"), payload(n % 4 <= 1, artifact_status="dev_only").alias("stage_summary"), payload(n % 4 <= 2, stage="x").alias("checkpoint_metadata"),
        F.when(n % 3 == 0, "runs/a/sft/best").when(n % 3 == 1, "runs/pretrain/x").otherwise("runs/other").alias("path"),
    )
    return evals.artifact_trust(rows).select("page_id", "artifact_status", "promotion_eligible", "source", evals.stage_of(F.col("path")).alias("stage"))


_SHARES = "[" + ", ".join(f"{{'bucket': '{b}', 'share': {s}::DOUBLE, 'least': {m}}}" for b, (s, _, m) in L.BUCKET_TARGETS.items()) + "]"


@query(f"""WITH RECURSIVE {BUCKETS_SQL.removeprefix("WITH ")}, n AS (SELECT bucket, count(*) AS available FROM b GROUP BY bucket), w AS (SELECT n.bucket, available, t.share, t.least FROM n JOIN (SELECT unnest({_SHARES}) AS t) x ON x.t.bucket = n.bucket),
t AS (SELECT sum(available) AS total, sum(least(available, w.least)) AS floor, min(CASE WHEN available >= w.least THEN floor(available / share) END) AS carried FROM w),
pl AS (SELECT CASE WHEN total <= 40 OR carried IS NULL THEN total ELSE least(total, greatest(floor, carried)) END AS planned FROM t),
q AS (SELECT 0 AS step, bucket, available, share, least(available, w.least)::BIGINT AS quota FROM w
  UNION ALL SELECT step + 1, bucket, available, share, quota + CASE WHEN quota < available AND row_number() OVER (ORDER BY quota < available DESC, share - quota / planned DESC, share DESC, available - quota DESC, bucket <> 'constructive_direct' DESC, bucket DESC) = 1 THEN 1 ELSE 0 END
  FROM q, pl WHERE (SELECT sum(quota) FROM q) < planned)
SELECT bucket, available, quota FROM q WHERE step = (SELECT max(step) FROM q)""")
def planned_quotas(spark, sf_dir):
    available = {r["bucket"]: r["n"] for r in _buckets(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bucket
    quotas = chat.plan_quotas(available, chat.plan_total(available))
    return spark.createDataFrame([(b, available[b], quotas[b]) for b in sorted(available)], "bucket string, available long, quota long")


@query("""WITH r AS (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN 'before' ELSE 'after' END AS run, conv_id % 3 AS hits, conv_id % 4 = 0 AS weak, conv_id % 5 = 0 AS ab, CASE WHEN conv_id % 7 = 0 THEN 'repeated_phrase' WHEN conv_id % 7 = 1 THEN 'low_prompt_retention' END AS reason FROM conversations)
SELECT run, count(*) FILTER ((weak OR reason IS NOT NULL) AND NOT ab) AS bad_outputs, count(*) FILTER (ab) AS abstentions, count(*) FILTER (hits > 0) AS sources_surfaced, count(*) FILTER (weak OR reason IS NOT NULL) AS weak_outputs, count(*) FILTER (hits > 0 OR ab) AS grounded,
  round(1 - count(*) FILTER (weak OR reason IS NOT NULL) / count(*), 6) AS fluency, round(1 - count(*) FILTER (reason = 'low_prompt_retention') / count(*), 6) AS prompt_retention, round(count(*) FILTER (hits > 0 OR ab) / count(*), 6) AS grounding_support,
  round(coalesce(count(*) FILTER (hits = 0 AND ab) / nullif(count(*) FILTER (hits = 0), 0), 0), 6) AS abstention_honesty, round(1 - count(*) FILTER (reason = 'repeated_phrase') / count(*), 6) AS repetition_control,
  round(coalesce(count(*) FILTER (hits > 0) / nullif(count(*) FILTER (hits > 0), 0), 0), 6) AS source_surfacing FROM r GROUP BY run""")
def before_and_after(spark, sf_dir):
    n = F.col("conv_id")
    reason = F.when(n % 7 == 0, F.array(F.lit("repeated_phrase"))).when(n % 7 == 1, F.array(F.lit("low_prompt_retention")))
    rows = table(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 2 == 0, "before").otherwise("after").alias("run"), F.lit("some answer").alias("text"), (n % 3).alias("retrieved_hit_count"), (n % 4 == 0).alias("output_degenerate"), (n % 5 == 0).alias("abstained"), reason.alias("quality_reasons")
    )
    out = evals.run_metrics(rows, "run")
    return out.select("run", *[F.col(c) if c in ("bad_outputs", "abstentions", "sources_surfaced", "weak_outputs", "grounded") else F.round(c, 6).alias(c) for c in out.columns if c != "run"])


_RESPONSE = "coalesce(text, '') || CASE conv_id % 3 WHEN 0 THEN ' MATH 101 [source: x]' WHEN 1 THEN ' It is not listed.' ELSE '' END"


@query(f"""WITH a AS (SELECT conv_id, turn, {_RESPONSE} AS r, lower({_RESPONSE}) AS low FROM conversations WHERE role = 'assistant'), b AS (SELECT *, {" OR ".join(f"contains(low, {quoted(m)})" for m in rawlm.CATALOG_ABSTENTIONS)} AS ca, {" OR ".join(f"contains(low, {quoted(m)})" for m in rawlm.DOMAIN_ABSTENTIONS)} AS da FROM a)
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ca WHEN turn % 2 = 0 THEN trim(r) <> '' ELSE contains(low, 'math 101') END AS catalog_exact, ca AS catalog_abstained, CASE WHEN turn % 4 = 3 THEN da WHEN turn % 2 = 0 THEN contains(low, 'the') AND (contains(low, 'and') OR contains(low, 'zzz')) ELSE contains(low, 'math 101') END AS domain_exact, da AS domain_abstained,
  contains(low, '[source:') OR contains(low, '<|citation|>') AS cited FROM b""")
def catalog_and_domain_scores(spark, sf_dir):
    t, some = F.col("turn"), lambda cond, *x: F.when(cond, F.array(*map(F.lit, x)))
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.expr(_RESPONSE).alias("r"), some(t % 2 == 1, "MATH 101").alias("codes"), some(t % 2 == 0, "The").alias("all"), some(t % 2 == 0, "And", "zzz").alias("any"), F.when(t % 4 == 3, True).alias("abstain")
    )
    none = F.lit(None).cast("array<string>")
    c = rawlm.expectation_score(F.col("r"), F.col("codes"), none, none, F.col("abstain"), rawlm.CATALOG_ABSTENTIONS)
    d = rawlm.expectation_score(F.col("r"), F.col("codes"), F.col("all"), F.col("any"), F.col("abstain"), rawlm.DOMAIN_ABSTENTIONS)
    return a.select("conv_id", "turn", c["exact"].alias("catalog_exact"), c["abstained"].alias("catalog_abstained"), d["exact"].alias("domain_exact"), d["abstained"].alias("domain_abstained"), d["cited"].alias("cited"))
