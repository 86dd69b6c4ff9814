"""Driver queries of chat and preference examples, tokens, mixing and packing, prepared outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import audit, chat, mixing, reports, tokenize
from textloom.queries import _buckets, _chunks, _conversations, _counted, BUCKETS_SQL, CHUNKS_SQL, PREPARED, SQUEEZE, SQUEEZED, WORDS, prepared, query, squeezed, table
from textloom.queries_rules import quoted
from textloom.sources import sinks

RENDERED = "string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || chr(10) || '</s>', chr(10) ORDER BY turn, role, text)"
_SPECIAL = "|".join(T.literal_pattern(s) for s in sorted(tokenize.SPECIAL, key=lambda s: (-len(s), s)))


# --- messages --------------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT conv_id, {RENDERED} AS r FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, arg_min(coalesce(text, ''), struct_pack(t := turn, r := role, x := text)) AS prompt, arg_max(coalesce(text, ''), struct_pack(t := turn, r := role, x := text)) AS response FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN r ELSE '<|user|>' || chr(10) || prompt || chr(10) || '</s>' || chr(10) || '<|assistant|>' || chr(10) || response || chr(10) || '</s>' END AS rendered FROM m JOIN p USING (conv_id)""")
def coalesced_messages(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    given = F.when(F.col("conv_id") % 2 == 0, F.col("messages"))
    text = lambda k: F.coalesce(F.element_at("messages", k)["content"], F.lit(""))
    return c.select("conv_id", chat.render(chat.coalesce_messages(given, text(1), text(-1))).alias("rendered"))


@query(f"""WITH m AS (SELECT conv_id, {RENDERED} AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'given-' || conv_id WHEN 1 THEN 'example-' || conv_id WHEN 2 THEN CAST(conv_id AS VARCHAR) ELSE sha256(r) END AS example_id,
  CASE conv_id % 3 WHEN 0 THEN 'group-' || conv_id % 5 WHEN 1 THEN 'talk-' || conv_id ELSE sha256(r) END AS group_id FROM m""")
def example_and_group_ids(spark, sf_dir):
    c, n = _conversations(spark, sf_dir), F.col("conv_id")
    given, example, row = F.when(n % 4 == 0, F.concat(F.lit(" given-"), n)), F.when(n % 4 == 1, F.concat(F.lit("example-"), n)), F.when(n % 4 == 2, n)
    group, talk = F.when(n % 3 == 0, F.concat(F.lit("group-"), n % 5)), F.when(n % 3 == 1, F.concat(F.lit("talk-"), n)).otherwise("  ")
    content = chat.render(F.col("messages"))
    return c.select("conv_id", chat.example_id(given, example, row, content=content).alias("example_id"), chat.example_id(F.lit(None).cast("string"), group, talk, content=content).alias("group_id"))


TOKENS_OF = f"CASE WHEN {SQUEEZE} = '' THEN [] ELSE string_split({SQUEEZE}, ' ') END"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, list_concat(list_concat(['<|' || role || '|>'], {TOKENS_OF}), ['</s>']) AS ids FROM conversations),
l AS (SELECT *, CASE WHEN role = 'assistant' THEN list_concat(['-100'], ids[2:]) ELSE list_transform(ids, lambda x: '-100') END AS labels FROM t),
g AS (SELECT conv_id, flatten(list(ids ORDER BY turn, role, text)) AS ids, flatten(list(labels ORDER BY turn, role, text)) AS labels FROM l GROUP BY conv_id)
SELECT conv_id, md5(array_to_string(ids[1:64], ' ')) AS ids, md5(array_to_string(labels[1:64], ' ')) AS labels FROM g""")
def sft_labels(spark, sf_dir):
    out = _conversations(spark, sf_dir).select("conv_id", chat.encode_labels(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))), 64).alias("e"))
    return out.select("conv_id", F.md5(F.array_join("e.ids", " ")).alias("ids"), F.md5(F.array_join("e.labels", " ")).alias("labels"))


@query(rf"""WITH m AS (SELECT conv_id, {RENDERED} FILTER (role <> 'assistant') AS r, arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, regexp_extract_all(regexp_replace(coalesce(r, '') || chr(10) || '<|assistant|>' || chr(10) || trim(regexp_replace(coalesce(a, ''), '^[\s]+|[\s]+$', '', 'g')) || chr(10) || '</s>', '({_SPECIAL})', ' \1 ', 'g'), '\S+') AS p FROM m)
SELECT conv_id, md5(array_to_string(list_resize(list_concat(['<s>'], p), 96, '<pad>'), ' ')) AS ids FROM t""")
def preference_tokens(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    prompt = F.filter("messages", lambda m: m["role"] != "assistant")
    answer = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    return c.select("conv_id", F.md5(F.array_join(tokenize.encode_preference(prompt, answer, 96), " ")).alias("ids"))


@query(rf"""WITH x AS (SELECT doc_id, '<|user|>' || coalesce(text, '') || '</s><|assistant|>tail' AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(regexp_replace(t, '({_SPECIAL})', ' \1 ', 'g'), '\S+') AS p FROM x)
SELECT doc_id, len(p) + 2 AS n_tokens, md5(array_to_string(p, ' ')) AS digest FROM p""")
def encoded_tokens(spark, sf_dir):
    t = F.concat(F.lit("<|user|>"), F.coalesce("text", F.lit("")), F.lit("</s><|assistant|>tail"))
    e = table(spark, sf_dir, "documents").select("doc_id", tokenize.encode(t, begin="<s>", end="</s>").alias("e"))
    return e.select("doc_id", F.size("e").alias("n_tokens"), F.md5(F.array_join(F.slice("e", 2, F.size("e") - 2), " ")).alias("digest"))


LABELS = f"(SELECT conv_id, coalesce(sum(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END) FILTER (role = 'assistant'), 0) AS labels FROM (SELECT conv_id, role, {SQUEEZE} AS t FROM conversations) GROUP BY conv_id)"


def _label_tokens():
    words = lambda m: T.count_split_words(T.squeeze(F.coalesce(m["content"], F.lit("")))).cast("long")
    return F.aggregate(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), words), F.lit(0).cast("long"), lambda a, x: a + x)


@query(f"""{BUCKETS_SQL}, l AS {LABELS} SELECT conv_id, CASE WHEN a IN ('i can''t help with that.', 'i cannot help with that.', 'i''m sorry, i can''t help with that.') THEN 'generic_refusal'
  WHEN bucket = 'informative_abstention' AND labels < 24 THEN 'short_abstention' END AS reason FROM b JOIN a USING (conv_id) JOIN l USING (conv_id)""".replace(", l AS (SELECT conv_id, coalesce", ", lt AS (SELECT conv_id, coalesce").replace("JOIN l USING", "JOIN lt USING"))
def chat_keep_reasons(spark, sf_dir):
    answer = chat.last_answer(F.col("messages"))
    return _conversations(spark, sf_dir).select("conv_id", chat.keep_reason(answer, chat.bucket_of(answer), _label_tokens()).alias("reason"))


_TARGETS = ", ".join(f"('{b}', {s}, {m})" for b, (s, _, m) in __import__("textloom.plans.lists", fromlist=["x"]).BUCKET_TARGETS.items())


@query(f"""{BUCKETS_SQL}, n AS (SELECT bucket, count(*) AS available FROM b GROUP BY bucket), w AS (SELECT n.*, share, least FROM n JOIN (VALUES {_TARGETS}) AS s(bucket, share, least) USING (bucket)),
t AS (SELECT sum(available) AS total, sum(least(available, least)) AS floor, min(CASE WHEN available >= least THEN floor(available / CAST(share AS DOUBLE)) END) AS carried FROM w)
SELECT CAST(CASE WHEN total <= 40 THEN total WHEN carried IS NULL THEN total ELSE least(total, greatest(floor, carried)) END AS BIGINT) AS planned, CAST(total AS BIGINT) AS available FROM t""")
def planned_total(spark, sf_dir):
    available = {r["bucket"]: r["n"] for r in _buckets(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bucket
    return spark.createDataFrame([(chat.plan_total(available), sum(available.values()))], "planned long, available long")


_PREFERENCES = """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'approved_template' WHEN 1 THEN 'human_reviewed' WHEN 2 THEN 'model_reviewed' WHEN 3 THEN 'unknown' END AS tier,
  CASE turn % 3 WHEN 0 THEN 'unsupported_claim' WHEN 1 THEN 'over_refusal' ELSE 'odd' END AS negative, text FROM conversations"""
_TIERS, _NEGATIVES = ("approved_template", "human_reviewed", "model_reviewed"), ("unsupported_claim", "over_refusal")


def _preferences(spark, sf_dir):
    tier = F.when(F.col("conv_id") % 5 == 0, "approved_template").when(F.col("conv_id") % 5 == 1, "human_reviewed").when(F.col("conv_id") % 5 == 2, "model_reviewed").when(F.col("conv_id") % 5 == 3, "unknown")
    negative = F.when(F.col("turn") % 3 == 0, "unsupported_claim").when(F.col("turn") % 3 == 1, "over_refusal").otherwise("odd")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tier.alias("chosen_quality_tier"), negative.alias("negative_type"), "text")


@query(f"""WITH p AS ({_PREFERENCES}), a AS (SELECT count(*) AS rows, count(*) FILTER (coalesce(tier, '') NOT IN {_TIERS}) AS bad_tier, count(*) FILTER (negative NOT IN {_NEGATIVES}) AS bad_negative, count(*) FILTER (tier = 'approved_template') AS templates FROM p)
SELECT *, round(templates / greatest(rows, 1), 6) AS template_share, bad_tier + bad_negative = 0 AND templates / greatest(rows, 1) <= 0.25 AS passes FROM a""")
def preference_problems(spark, sf_dir):
    out = chat.preference_problems(_preferences(spark, sf_dir), _TIERS, _NEGATIVES)
    return out.withColumn("template_share", F.round("template_share", 6))


@query(f"""WITH p AS ({_PREFERENCES}), w AS (SELECT negative AS negative_type, conv_id, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS n FROM (SELECT negative, conv_id, {SQUEEZE} AS t FROM p)),
g AS (SELECT negative_type, conv_id, count(*) AS n, sum(n) AS l, count(*) FILTER (n > 60) AS c FROM w GROUP BY ALL),
o AS (SELECT negative_type, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(l) AS BIGINT) AS label_tokens, CAST(sum(c) AS BIGINT) AS truncated, CAST(sum(n - 1) AS BIGINT) AS duplicate_prompts FROM g GROUP BY ALL)
SELECT *, round(rows / sum(rows) OVER (), 6) AS row_share, round(label_tokens / greatest(sum(label_tokens) OVER (), 1), 6) AS label_token_share FROM o""")
def preference_diagnostics(spark, sf_dir):
    p = _preferences(spark, sf_dir).withColumn("n", T.count_split_words(T.squeeze(F.coalesce("text", F.lit("")))).cast("long"))
    return reports.example_diagnostics(p, ["negative_type"], "conv_id", "n", "n", 60)


_QUESTIONS = "[" + ", ".join(map(quoted, reports.QUESTIONS)) + "]"
_MISSING = "[" + ", ".join(map(quoted, reports.MISSING_QUESTIONS)) + "]"
EXAMPLES_SQL = rf"""{CHUNKS_SQL}, ok AS (SELECT chunk_id, CAST(doc_id AS VARCHAR) AS source_file, chunk, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR), chunk_id) - 1 AS i FROM c),
sp AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM ok), ix AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i) - 1 AS ix FROM sp),
ak AS (SELECT *, unnest(CASE WHEN ix % 3 = 0 THEN [{{'k': 0, 'tp': 0}}, {{'k': 1, 'tp': 1}}, {{'k': 2, 'tp': -1}}] ELSE [{{'k': 0, 'tp': 0}}, {{'k': 1, 'tp': 1}}] END) AS a FROM ix),
nn AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ix, a.k) - 1 AS number FROM ak), kp AS (SELECT * FROM nn WHERE number < CASE WHEN split = 'train' THEN 200 ELSE 50 END),
ls AS (SELECT *, list_filter(string_split(regexp_replace(chunk, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(string_split(s, ' '), lambda y: y <> '')) >= 8) AS lg FROM kp),
f1 AS (SELECT *, CASE WHEN len(lg) > 0 THEN lg[a.tp % len(lg) + 1] ELSE array_to_string(string_split(chunk, ' ')[1:35], ' ') END AS first FROM ls),
f2 AS (SELECT *, CASE WHEN len(string_split(first, ' ')) > 48 THEN rtrim(array_to_string(string_split(first, ' ')[1:48], ' '), ',;:') ELSE first END AS cut FROM f1),
f3 AS (SELECT *, CASE WHEN regexp_matches(cut, '[.!?]$') THEN cut ELSE cut || '.' END AS st FROM f2), f4 AS (SELECT *, lower(left(st, 1)) || substr(st, 2) AS lw FROM f3),
f5 AS (SELECT *, CASE a.tp % 3 WHEN 1 THEN 'Using only the context, the supported point is that ' || lw WHEN 2 THEN 'The answer should stay limited to this context: ' || st ELSE 'The context says that ' || lw END AS an FROM f4)
SELECT 'grounded-' || split || '-' || lpad(CAST(number AS VARCHAR), 4, '0') AS row_id, split, chunk_id, source_file, CASE WHEN a.tp < 0 THEN 'missing_context_abstention' ELSE 'grounded_context_answer' END AS mix,
  CASE WHEN a.tp < 0 THEN {_MISSING}[ix % 4 + 1] ELSE {_QUESTIONS}[(ix + a.tp) % 5 + 1] END AS question,
  CASE WHEN a.tp < 0 THEN {quoted(reports.MISSING_ANSWER)} WHEN len(string_split(an, ' ')) < 15 THEN an || ' This answer stays limited to the provided context.' ELSE an END AS answer FROM f5"""


@query(EXAMPLES_SQL)
def examples_from_chunks(spark, sf_dir):
    c = _chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").cast("string").alias("source_file"), F.lit("low").alias("risk_level"), F.lit("rag").alias("allowed_use"), F.col("chunk").alias("text"))
    return reports.examples_from_chunks(c, 200, 50)


# --- mixing, packing, prepared outputs -------------------------------------------------------------------------------


@query(f"{SQUEEZED} SELECT doc_id, source, row_number() OVER (ORDER BY CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END, doc_id) - 1 AS place FROM d WHERE source IN ('src0', 'src1', 'src2')")
def concatenated_sources(spark, sf_dir):
    return mixing.concatenated(_counted(spark, sf_dir), ["src2", "src0", "src1"], "doc_id").select("doc_id", "source", "place")


def _next_fit(size: int, shards: int) -> str:
    shard = "0" if shards == 1 else f"('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8))::BIGINT % {shards}"
    return f"""{SQUEEZED.replace("WITH d", "WITH RECURSIVE d")}, q AS (SELECT doc_id, source, n, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS k FROM (SELECT doc_id, source, {WORDS} + 1 AS n, {shard} AS shard FROM d)),
st AS (SELECT DISTINCT shard, 0::BIGINT AS k, 0::BIGINT AS w, 0::BIGINT AS f, 0::BIGINT AS p, 0::BIGINT AS g, NULL::BIGINT AS begun, NULL::BIGINT AS shut, NULL::BIGINT AS shut_at FROM q
  UNION ALL SELECT st.shard, q.k, CASE WHEN q.n > {size} THEN w + (q.n - 1) // {size} + 1 WHEN f + q.n > {size} AND p > 0 THEN w + 1 ELSE w END, CASE WHEN q.n > {size} THEN f WHEN f + q.n > {size} AND p > 0 THEN q.n ELSE f + q.n END,
    CASE WHEN q.n > {size} THEN p WHEN f + q.n > {size} AND p > 0 THEN 1 ELSE p + 1 END, CASE WHEN q.n <= {size} AND f + q.n > {size} AND p > 0 THEN g + 1 ELSE g END, CASE WHEN q.n > {size} THEN w END,
    CASE WHEN q.n <= {size} AND f + q.n > {size} AND p > 0 THEN g END, CASE WHEN q.n <= {size} AND f + q.n > {size} AND p > 0 THEN w END
  FROM st JOIN q ON q.shard = st.shard AND q.k = st.k + 1),
sh AS (SELECT shard, shut AS g, shut_at AS "window" FROM st WHERE shut IS NOT NULL UNION ALL SELECT shard, arg_max(g, k), arg_max(w, k) FROM st GROUP BY shard),
pt AS (SELECT st.shard, "window", st.p - 1 AS part, doc_id AS record, 0::BIGINT AS token_start, CAST(q.n AS BIGINT) AS token_end FROM st JOIN q ON q.shard = st.shard AND q.k = st.k JOIN sh ON sh.shard = st.shard AND sh.g = st.g WHERE st.k > 0 AND q.n <= {size}
  UNION ALL SELECT shard, begun + i, 0, doc_id, i * {size}, least(n, (i + 1) * {size}) FROM (SELECT st.shard, begun, doc_id, n, unnest(range(0, (n - 1) // {size} + 1)) AS i FROM st JOIN q ON q.shard = st.shard AND q.k = st.k WHERE st.k > 0 AND q.n > {size})),
pw AS (SELECT * FROM pt QUALIFY sum(token_end - token_start) OVER (PARTITION BY shard, "window") >= 3)"""


@query(f"{_next_fit(512, 1)} SELECT * FROM pw")
def pack_windows(spark, sf_dir):
    return mixing.pack_windows(_counted(spark, sf_dir), "doc_id", "n_tokens", 512)


@query(f"{_next_fit(512, 8)} SELECT source, record AS document_id, count(*) AS appearances FROM pw JOIN (SELECT doc_id AS record, source FROM d) USING (record) GROUP BY ALL")
def contributor_counts(spark, sf_dir):
    d = squeezed(spark, sf_dir).withColumn("w", T.split_words(F.col("text"))).withColumn("n", F.size("w"))
    windows = mixing.window_rows(mixing.pack_windows(d, "doc_id", "n", 512, shards=8), d, "doc_id", F.col("w"), "</s>", "<pad>", 512, "source")
    return reports.contributor_counts(windows)


HOLDOUT_SQL = f"""{SQUEEZED}, w AS (SELECT doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''), x AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 256 + 1)) AS k FROM w),
y AS (SELECT doc_id, k, w[k * 256 + 1 : k * 256 + 256] AS p FROM x)"""


def _fixed(spark, sf_dir):
    return mixing.fixed_windows(squeezed(spark, sf_dir).select("doc_id", T.split_words(F.col("text")).alias("w")), "doc_id", "w", 256, "<pad>")


@query(f"""{HOLDOUT_SQL} SELECT doc_id, k AS "window", md5(array_to_string(list_concat(p, list_resize(CAST([] AS VARCHAR[]), 256 - len(p), '-100')), ' ')) AS labels, md5(repeat('1', len(p)) || repeat('0', 256 - len(p))) AS mask FROM y""")
def window_labels(spark, sf_dir):
    ids = F.col("ids")
    return _fixed(spark, sf_dir).select("doc_id", "window", F.md5(F.array_join(mixing.labels_of(ids, "<pad>", "-100"), " ")).alias("labels"), F.md5(F.array_join(mixing.mask_of(ids, "<pad>"), "")).alias("mask"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard_index, (row_number() OVER (ORDER BY doc_id) - 1) % 64 AS row_index FROM documents")
def shard_rows(spark, sf_dir):
    d = sinks.with_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64)
    # A global row number leads back to the same place.
    at = mixing.locate(F.col("shard_index") * 64 + F.col("row_index"), 64)
    return d.select("doc_id", at[0].alias("shard_index"), at[1].alias("row_index"))


@query(f"""{HOLDOUT_SQL}, r AS (SELECT doc_id, k, len(p) AS n, row_number() OVER (ORDER BY doc_id, k) - 1 AS row FROM y) SELECT row // 100 AS shard_index, row % 100 AS row_index, doc_id, k AS "window", n AS n_tokens FROM r""")
def prepared_shards(spark, sf_dir):
    """Windows written as shards with a manifest, validated and read back."""
    from textloom.sources.sinks import read_prepared, shared_folder, write_prepared

    folder = f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}"
    rows = sinks.with_shards(_fixed(spark, sf_dir).drop("ids"), ["doc_id", "window"], 100)
    write_prepared(rows, folder, "packed_lm", {"size": 256}, 100, "n_tokens")
    return read_prepared(spark, folder, "packed_lm").select(F.col("shard_index").cast("long").alias("shard_index"), "row_index", "doc_id", "window", "n_tokens")


@query(f"""{PREPARED}, s AS (SELECT source, count(*) FILTER (drop_reason IS NULL) AS documents, CAST(sum(n) FILTER (drop_reason IS NULL) AS BIGINT) AS tokens FROM p GROUP BY source),
c AS (SELECT *, 1.0::DOUBLE / count(*) OVER () AS share, documents / (1 - 0.35::DOUBLE) * round(tokens / greatest(documents, 1), 2) AS capacity FROM s)
SELECT source, round(capacity, 4) AS capacity FROM c""")
def source_capacity(spark, sf_dir):
    r = audit.source_report(prepared(spark, sf_dir))
    return r.select("source", F.round(F.col("documents") / (1 - 0.35) * F.col("average_tokens"), 4).alias("capacity"))
