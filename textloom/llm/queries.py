"""Driver queries of this package, one per operator, and the SQL that expresses them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import read
from textloom.llm.decontamination import decontaminate
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.html_extraction import extract_main_text
from textloom.llm.packing import pack
from textloom.llm.pii import find_personal_data
from textloom.llm.quality import quality
from textloom.llm.secret_scan import scan_secrets
from textloom.llm.simhash import simhash_components
from textloom.llm.toxicity import toxicity
from textloom.llm.warc import archive_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The result is narrow: rebalancing it writes a few files of a sensible size in place of one from every sort task.
    return exact_dedup(read(spark, sf_dir, "documents")).hint("rebalance")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents", by_row=True))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages", by_row=True))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents", by_row=True), read(spark, sf_dir, "labels")).hint("rebalance")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents", by_row=True), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents", by_row=True))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents", by_row=True), read(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents", by_row=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_secret_scan, op3_html_extraction, op4_packing, op5_toxicity, op6_decontamination, op7_warc, op8_pii, op9_quality, op10_simhash)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op4_packing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
), e AS (SELECT doc_id, h, n, unnest(range(0, (n - 1) // 2048 + 1)) AS s FROM d WHERE n > 0),
q AS (
  SELECT doc_id, s AS sequence_no, s * 2048 AS token_start, least(n, (s + 1) * 2048) AS token_end, least(n, (s + 1) * 2048) - s * 2048 AS n_tokens,
         ('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s || ':' || h), 15))::BIGINT AS place
  FROM e
), l AS (
  SELECT n_tokens AS size, row_number() OVER (ORDER BY n_tokens) AS j, CAST(sum(c) OVER (ORDER BY n_tokens) AS BIGINT) AS n
  FROM (SELECT n_tokens, count(*) AS c FROM q GROUP BY n_tokens)
), dp AS (
  SELECT 1 AS b, j, size, n, n * size AS cost, 0::BIGINT AS cut FROM l
  UNION ALL
  SELECT b + 1, j, size, n, CASE WHEN least_cost < cost THEN least_cost ELSE cost END, CASE WHEN least_cost < cost THEN i ELSE 0 END
  FROM (
    SELECT x.b, x.j, x.size, x.n, x.cost, min(p.cost + (x.n - p.n) * x.size) AS least_cost,
           arg_min(p.j, struct_pack(c := p.cost + (x.n - p.n) * x.size, j := p.j)) AS i
    FROM dp x LEFT JOIN dp p ON p.j < x.j WHERE x.b < 8 GROUP BY ALL
  )
), back AS (
  SELECT 8 AS b, (SELECT max(j) FROM l) AS j, NULL::BIGINT AS e
  UNION ALL
  SELECT back.b - 1, CASE WHEN dp.cut > 0 THEN dp.cut ELSE back.j END, CASE WHEN dp.cut > 0 THEN back.j END FROM back JOIN dp ON dp.b = back.b AND dp.j = back.j
), ends AS (SELECT size AS e FROM l WHERE j IN (SELECT e FROM back WHERE e IS NOT NULL UNION SELECT j FROM back WHERE b = 0)),
placed AS (SELECT q.*, (SELECT min(e) FROM ends WHERE e >= n_tokens) AS bucket_tokens FROM q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket_tokens ORDER BY place, doc_id, sequence_no, token_end) - 1 AS k, greatest(1, 65536 // bucket_tokens) AS room FROM placed)
SELECT doc_id, sequence_no, token_start, token_end, n_tokens, bucket_tokens, k // room AS batch_no, k % room AS slot FROM ranked
""",
    "op6_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, item_id, i, size FROM grams JOIN windows USING (size, g)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
d AS (
  SELECT page_id, html, first_id,
         array_to_string(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> s) & 31) + 1]), 'string_agg', '')), '') AS digest
  FROM f
)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
""",
}
