"""Driver queries of chunking, retrieval and page ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import retrieve, typed, web
from textloom.plans import lists as L
from textloom.queries import _LINE, _TAGLESS, _UNESCAPE, _chunks, RETRIEVE_SQL, SQUEEZED, TERMS_SQL, _hits, query, squeezed, table
from textloom.queries_rules import URLS, hits_of, number_of

# --- chunks ----------------------------------------------------------------------------------------------------------

SENTENCES_SQL = rf"""{SQUEEZED.replace("WITH d", "WITH RECURSIVE d")}, sp AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM d),
sn AS (SELECT doc_id, k, l[k] AS s, len(regexp_split_to_array(trim(l[k]), '\s+')) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM sp))"""
#: Overlapping runs of sentences: ch(doc_id, chunk_no, chunk, word_count).
WINDOWS_SQL = rf"""{SENTENCES_SQL}, ps AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS p, lead(n) OVER (PARTITION BY doc_id ORDER BY k) AS next_n FROM sn),
tm AS (SELECT a.doc_id, a.k, a.p, a.n, a.next_n, min(b.k) AS m FROM ps a LEFT JOIN ps b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 45 AND a.k AND a.p - (b.p - b.n) <= 45 GROUP BY ALL),
tl AS (SELECT doc_id, k, p, n, next_n, coalesce(m, k) AS tail FROM tm),
tz AS (SELECT tl.*, o.p - o.n AS tail_p FROM tl JOIN ps o ON o.doc_id = tl.doc_id AND o.k = tl.tail),
rec AS (SELECT doc_id, 1::BIGINT AS k, 1::BIGINT AS a, 0::BIGINT AS ap, NULL::BIGINT AS ca, NULL::BIGINT AS cb FROM ps WHERE k = 1
  UNION ALL SELECT r.doc_id, r.k + 1, CASE WHEN z.p - r.ap + z.next_n > 220 AND z.p - r.ap >= 120 THEN greatest(r.a, z.tail) ELSE r.a END,
    CASE WHEN z.p - r.ap + z.next_n > 220 AND z.p - r.ap >= 120 THEN greatest(r.ap, z.tail_p) ELSE r.ap END,
    CASE WHEN z.p - r.ap + z.next_n > 220 AND z.p - r.ap >= 120 THEN r.a END, CASE WHEN z.p - r.ap + z.next_n > 220 AND z.p - r.ap >= 120 THEN r.k END
  FROM rec r JOIN tz z ON z.doc_id = r.doc_id AND z.k = r.k WHERE z.next_n IS NOT NULL),
ends AS (SELECT doc_id, ca, cb FROM rec WHERE ca IS NOT NULL UNION ALL SELECT r.doc_id, r.a, r.k FROM rec r JOIN tz z ON z.doc_id = r.doc_id AND z.k = r.k WHERE z.next_n IS NULL AND z.p - r.ap >= 80),
ch AS (SELECT e.doc_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.cb) - 1 AS chunk_no, string_agg(s, ' ' ORDER BY k) AS chunk, CAST(sum(n) AS BIGINT) AS word_count FROM ends e JOIN sn ON sn.doc_id = e.doc_id AND k BETWEEN ca AND cb GROUP BY e.doc_id, ca, cb)"""
REASONS_SQL = rf"""{WINDOWS_SQL}, cw AS (SELECT doc_id, chunk_no, chunk, string_split(trim(regexp_replace(lower(chunk), '[\x00\s\p{{Z}}]+', ' ', 'g')), ' ') AS w FROM ch),
cg AS (SELECT doc_id, chunk_no, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, chunk_no, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cw, (VALUES (8), (12), (20)) AS s(k) WHERE len(w) >= k)),
cm AS (SELECT doc_id, chunk_no, max(c) FILTER (k = 8) AS m8, max(c) FILTER (k = 12) AS m12, max(c) FILTER (k = 20) AS m20 FROM (SELECT doc_id, chunk_no, k, g, count(*) AS c FROM cg GROUP BY ALL) GROUP BY ALL),
cr AS (SELECT doc_id, chunk_no, chunk, CASE WHEN len(w) < 80 THEN 'too_short' WHEN len(w) > 420 THEN 'too_long' WHEN len(regexp_extract_all(chunk, {URLS})) / len(w) > 0.015 THEN 'url_heavy'
  WHEN {hits_of("chunk", L.SEPARATORS)} / len(w) > 0.08 THEN 'separator_heavy' WHEN len(list_distinct(w)) / len(w) < 0.28 THEN 'low_unique_ratio' WHEN m8 > 2 OR m12 > 2 OR m20 > 1 THEN 'repeated_ngrams'
  WHEN {number_of("lower(chunk)", L.BOILERPLATE_PHRASES)} >= 3 THEN 'boilerplate' END AS reason FROM cw LEFT JOIN cm USING (doc_id, chunk_no))"""


@query(f"{SENTENCES_SQL} SELECT doc_id, CAST(k - 1 AS INT) AS sentence_no, md5(s) AS digest FROM sn")
def sentence_split(spark, sf_dir):
    d = squeezed(spark, sf_dir).select("doc_id", F.posexplode(retrieve.sentences(F.col("text"))).alias("sentence_no", "s"))
    return d.select("doc_id", "sentence_no", F.md5("s").alias("digest"))


def _windows(spark, sf_dir):
    return retrieve.sentence_windows(squeezed(spark, sf_dir), "doc_id")


@query(f"{WINDOWS_SQL} SELECT doc_id, chunk_no, word_count, md5(chunk) AS digest FROM ch")
def chunk_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "chunk_no", "word_count", F.md5("chunk").alias("digest"))


def _judged_chunks(spark, sf_dir):
    return retrieve.judged_chunks(_windows(spark, sf_dir))


@query(f"{REASONS_SQL} SELECT reason, count(*) AS n FROM cr GROUP BY ALL")
def chunk_reject_reasons(spark, sf_dir):
    return _judged_chunks(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{REASONS_SQL}, k AS (SELECT 'docs/' || doc_id || '.txt' AS source_file, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS INT) AS i, doc_id, chunk_no, chunk FROM cr WHERE reason IS NULL)
SELECT 'rag-' || left(sha256(source_file), 10) || '-' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, sha256(chunk) AS sha256, source_file FROM k QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY source_file, i) = 1""")
def rag_chunks(spark, sf_dir):
    c = _judged_chunks(spark, sf_dir).filter("reason IS NULL").select(F.format_string("docs/%d.txt", "doc_id").alias("source_file"), "chunk_no", F.col("chunk").alias("text"))
    return retrieve.numbered_chunks(c, "source_file", "chunk_no", "text").select("chunk_id", "sha256", "source_file")


@query(f"""{REASONS_SQL}, k AS (SELECT 'docs/' || doc_id % 20 AS source_file, reason, count(*) AS n FROM cr GROUP BY ALL)
SELECT source_file, CAST(coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS chunks_kept, CAST(coalesce(sum(n) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS chunks_skipped,
  coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS skip_reasons FROM k GROUP BY source_file""")
def chunk_manifest(spark, sf_dir):
    c = _judged_chunks(spark, sf_dir).withColumn("source_file", F.concat(F.lit("docs/"), F.col("doc_id") % 20))
    m = typed.chunk_manifest(c)
    return m.withColumn("skip_reasons", F.array_join(F.transform(F.map_entries("skip_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


_HEADED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'rag_candidates' WHEN 1 THEN 'continued_pretrain_candidates' WHEN 2 THEN 'needs_manual_review' WHEN 3 THEN 'rejected_template_heavy' ELSE 'other' END AS category,
  (CASE WHEN doc_id % 2 = 0 THEN 'Title:  On matters of ' || source || chr(10) ELSE '' END) || (CASE WHEN doc_id % 3 = 0 THEN 'Risk Level: low' || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 7 = 0 THEN 'allowed use: RAG only' || chr(10) ELSE '' END) || 'Provenance: made' || chr(10) || 'first line' || chr(10) || 'risk level high' AS text FROM documents"""


@query(f"""WITH f AS ({_HEADED})
SELECT category || '/some_file-' || doc_id || '.txt' AS source_file, category, CASE WHEN doc_id % 2 = 0 THEN 'On matters of ' || (SELECT source FROM documents d WHERE d.doc_id = f.doc_id) ELSE 'Some File ' || doc_id END AS title,
  CASE WHEN category IN ('rag_candidates', 'continued_pretrain_candidates') THEN CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'medium' END ELSE CASE WHEN category = 'other' THEN 'medium' ELSE 'high' END END AS risk_level,
  CASE WHEN category = 'rag_candidates' THEN CASE WHEN doc_id % 7 = 0 THEN 'RAG only' ELSE 'RAG' END WHEN category = 'continued_pretrain_candidates' THEN CASE WHEN doc_id % 7 = 0 THEN 'RAG only' ELSE 'continued pretraining / RAG after chunking' END
    WHEN category = 'rejected_template_heavy' THEN 'rejected' ELSE 'manual review only' END AS allowed_use, 'first line' || chr(10) || 'risk level high' AS text FROM f""")
def source_headers(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_of_headers")
    f = spark.sql(_HEADED.replace("chr(10)", r"'\n'").replace("FROM documents", "FROM documents_of_headers").replace("||", "||"))
    return typed.source_files(f.select(F.concat("category", F.lit("/some_file-"), "doc_id", F.lit(".txt")).alias("path"), "text"))


# --- retrieval -------------------------------------------------------------------------------------------------------

_NAMED_SQL = lambda t: rf"list_distinct(list_filter(list_transform(regexp_extract_all({t}, '\b[A-Z][A-Za-z0-9''-]{{2,}}'), lambda y: regexp_replace(lower(y), '^[''-]+|[''-]+$', '', 'g')), lambda y: y NOT IN {tuple(L.RETRIEVAL_STOPWORDS)}))"


@query(rf"""SELECT item_id, array_to_string(list_sort({TERMS_SQL("text")}), ' ') AS terms, array_to_string(list_sort({_NAMED_SQL("' ' || text")}), ' ') AS names FROM benchmark""".replace('"i\'m"', "'i''m'"))
def query_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.array_sort(retrieve.terms(F.col("text"))), " ").alias("terms"), F.array_join(F.array_sort(retrieve.named_terms(F.col("text"))), " ").alias("names"))


_CANDIDATES = RETRIEVE_SQL[: RETRIEVE_SQL.index("h AS (SELECT query_id")]


@query(f"""{_CANDIDATES} all_chunks AS (SELECT count(*) AS n FROM c), s AS (SELECT *, round((0.5 + matched / query_terms) * s, 6) AS score FROM m),
g AS (SELECT query_id, count(*) FILTER (score >= 0.02) AS scored, count(*) FILTER (score >= 0.02 AND matched < 3) AS few, count(*) FILTER (score >= 0.02 AND matched >= 3 AND matched / query_terms < 0.25) AS low,
  count(*) FILTER (score >= 0.02 AND matched >= 3 AND matched / query_terms >= 0.25) AS accepted FROM s GROUP BY query_id)
SELECT query_id, all_chunks.n AS candidates, all_chunks.n - scored AS below_min_score, few AS too_few_matched_terms, low AS low_lexical_overlap, 0::BIGINT AS missing_named_query_terms, accepted FROM g, all_chunks""")
def retrieval_gates(spark, sf_dir):
    index = retrieve.build_index(_chunks(spark, sf_dir), "chunk_id", "chunk")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.squeeze(F.col("text")).alias("query"))
    return retrieve.gate_counts(asked, index, min_score=0.02, min_matched=3, min_overlap=0.25)


@query(f"""{RETRIEVE_SQL}, qd AS (SELECT query_id, list_sort(list_distinct(t)) AS t FROM q), ht AS (SELECT r.query_id, r.chunk_id, r.rank, list_sort(list(po.term)) AS met FROM r JOIN qd USING (query_id) JOIN po ON po.chunk_id = r.chunk_id AND list_contains(qd.t, po.term) GROUP BY ALL)
SELECT r.query_id, r.chunk_id, r.rank, array_to_string(met, ' ') AS matched_terms, array_to_string(list_filter(qd.t, lambda x: NOT list_contains(met, x)), ' ') AS missing_terms, left(c.chunk, 420) AS text_preview
FROM r JOIN ht USING (query_id, chunk_id, rank) JOIN qd USING (query_id) JOIN c USING (chunk_id)""")
def retrieval_payload(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    index = retrieve.build_index(chunks, "chunk_id", "chunk")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.squeeze(F.col("text")).alias("query"))
    hits = retrieve.retrieve(asked, index, 5, min_matched=2)
    full = retrieve.payload(hits, asked, chunks.select("chunk_id", F.col("chunk").alias("text")))
    return full.select("query_id", "chunk_id", "rank", F.array_join("matched_terms", " ").alias("matched_terms"), F.array_join("missing_terms", " ").alias("missing_terms"), "text_preview")


@query(f"""{RETRIEVE_SQL}, cx AS (SELECT query_id, string_agg(c.chunk, chr(10) || chr(10) ORDER BY rank) AS t FROM r JOIN c USING (chunk_id) GROUP BY query_id)
SELECT query_id, CASE WHEN length(t) <= 900 THEN t WHEN contains(left(t, 900), ' ') THEN regexp_replace(left(t, 900), '\\s+\\S*$', '') ELSE left(t, 900) END AS context FROM cx""".replace("\\\\", "\\"))
def retrieval_context(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("chunk_id", F.col("chunk").alias("text"))
    return retrieve.context(_hits(spark, sf_dir).join(chunks, "chunk_id"), 900)


# --- pages -----------------------------------------------------------------------------------------------------------

_BLOCKS = lambda t: rf"regexp_replace(regexp_replace(regexp_replace({t}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?i)</(?:{web.BLOCK_ENDS})>|<br\s*/?>', chr(10), 'g')"
TEXT_OF = lambda t: f"array_to_string(list_filter(list_transform(string_split({_UNESCAPE(_TAGLESS(_BLOCKS(t)))}, chr(10)), lambda x: {_LINE('x')}), lambda x: x <> ''), chr(10))"
MAIN = "coalesce(" + ", ".join(f"nullif(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '')" for t in ("main", "article", "body")) + ", html)"
TITLE = rf"coalesce(nullif({_LINE(_UNESCAPE(_TAGLESS(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")))}, ''), 'Untitled')"
_FAMILY = "CASE page_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.FAMILIES.items()) + " ELSE 'general' END"
_LADDER = "CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{k}'" for p, k in web.URL_LADDER) + " ELSE 'page' END"
DOCUMENTS_SQL = f"""p AS (SELECT page_id, url, html, {MAIN} AS main, {_LADDER} AS page_type FROM pages),
dc AS (SELECT page_id, url AS source_url, page_type, {_FAMILY} AS family, {TITLE} AS title, {TEXT_OF("main")} AS text, 'doc-' || left(sha256('["s1","' || url || '"]'), 24) AS id FROM p)"""


@query(f"SELECT page_id, md5({MAIN}) AS digest FROM pages")
def main_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(web.main_content(F.col("html"))).alias("digest"))


@query(f"WITH {DOCUMENTS_SQL} SELECT id, source_url, page_type, family, title, sha256(text) AS content_hash, length(text) AS n_chars FROM dc")
def page_documents(spark, sf_dir):
    return web.documents_of(table(spark, sf_dir, "pages"), "s1").select("id", "source_url", "page_type", "family", "title", "content_hash", F.length("text").alias("n_chars"))


LINE_CHUNKS_SQL = f"""WITH RECURSIVE {DOCUMENTS_SQL}, ln AS (SELECT id, k, length(l[k]) AS n FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM dc))),
rc AS (SELECT id, 1::BIGINT AS k, 0 AS chunk_index, n AS size FROM ln WHERE k = 1
  UNION ALL SELECT rc.id, rc.k + 1, CASE WHEN rc.size + 1 + ln.n <= 500 THEN rc.chunk_index ELSE rc.chunk_index + 1 END, CASE WHEN rc.size + 1 + ln.n <= 500 THEN rc.size + 1 + ln.n ELSE ln.n END FROM rc JOIN ln ON ln.id = rc.id AND ln.k = rc.k + 1),
lc AS (SELECT id AS document_id, chunk_index, max(size) AS n_chars FROM rc GROUP BY ALL)"""


@query(f"""{LINE_CHUNKS_SQL} SELECT document_id, chunk_index, 'chunk-' || left(sha256('["' || document_id || '","' || chunk_index || '"]'), 24) AS id, n_chars FROM lc""")
def line_chunks_500(spark, sf_dir):
    return web.chunks_of(web.documents_of(table(spark, sf_dir, "pages"), "s1")).select("document_id", "chunk_index", "id", F.length("text").alias("n_chars"))


@query(f"""{LINE_CHUNKS_SQL} SELECT dc.source_url, lc.chunk_index, regexp_replace(regexp_replace(lower(dc.title || '-' || lc.chunk_index), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS fact_key, dc.title AS citation_label, n_chars + length(dc.title) + 1 AS n_chars
FROM lc JOIN dc ON dc.id = lc.document_id""")
def admissions_rows(spark, sf_dir):
    rows = typed.admissions_rows(web.documents_of(table(spark, sf_dir, "pages"), "s1"))
    return rows.select("source_url", "chunk_index", "fact_key", "citation_label", F.length("text").alias("n_chars"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT source_url, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS publication_key, title, md5(text) AS digest FROM dc WHERE trim(text) <> ''""")
def publication_rows(spark, sf_dir):
    rows = typed.publication_rows(web.documents_of(table(spark, sf_dir, "pages"), "s1"))
    return rows.select("source_url", "publication_key", "title", F.md5("text").alias("digest"))


_RULES = ((2, "/fr/", "french_page"), (1, "page=", "paged"), (3, "example.org", "organisation"))


@query("""WITH r AS (SELECT * FROM (VALUES (2, '/fr/', 'french_page'), (1, 'page=', 'paged'), (3, 'example.org', 'organisation')) AS s(rule_no, contains_text, page_type)),
m AS (SELECT page_id, r.page_type FROM pages JOIN r ON contains(lower(url), r.contains_text) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rule_no) = 1)
SELECT page_id, coalesce(m.page_type, 'none') AS page_type FROM pages LEFT JOIN m USING (page_id)""")
def policy_page_types(spark, sf_dir):
    rules = spark.createDataFrame(list(_RULES), "rule_no int, contains string, page_type string")
    return web.policy_types(table(spark, sf_dir, "pages").select("page_id", "url"), rules, "page_id").select("page_id", F.coalesce("page_type", F.lit("none")).alias("page_type"))


_PLANTED = """html || '<script type="application/ld+json">{"id": ' || page_id || ', "inner": {"deep": [{"x": ' || page_id || '}, {"y": "u"}]}}</script><script type="application/json">&quot;no object&quot;</script>'"""


@query("""SELECT page_id, o.object_no, o.object FROM (SELECT page_id, unnest([{'object_no': 0, 'object': '{"id": ' || page_id || ', "inner": {"deep": [{"x": ' || page_id || '}, {"y": "u"}]}}'},
  {'object_no': 1, 'object': '{"deep": [{"x": ' || page_id || '}, {"y": "u"}]}'}, {'object_no': 2, 'object': '{"x": ' || page_id || '}'}, {'object_no': 3, 'object': '{"y": "u"}'}]) AS o FROM pages)""")
def page_json_objects(spark, sf_dir):
    return web.page_objects(table(spark, sf_dir, "pages").withColumn("html", F.expr(_PLANTED)))


@query("""SELECT page_id, 2 AS n, '{"id": ' || page_id || ', "inner": {"deep": [{"x": ' || page_id || '}, {"y": "u"}]}}' AS first FROM pages""")
def script_payloads(spark, sf_dir):
    scripts = web.script_json(F.col("html"))
    return table(spark, sf_dir, "pages").withColumn("html", F.expr(_PLANTED)).select("page_id", F.size(scripts).alias("n"), F.get(scripts, F.lit(0)).alias("first"))


@query(r"""WITH y AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Handbook 20' || (10 + page_id % 15) || '-' || (11 + page_id % 15) WHEN 1 THEN 'for 20' || (10 + page_id % 15) || ' / 20' || (11 + page_id % 15) || ' only' ELSE 'none' END AS title,
  CASE WHEN page_id % 3 = 0 THEN 'text of 2021–22' ELSE '' END AS text FROM pages)
SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN '20' || (10 + page_id % 15) || '-' || (11 + page_id % 15) WHEN page_id % 3 = 0 THEN '2021-22' END AS school_year FROM y""")
def school_years(spark, sf_dir):
    n = F.col("page_id")
    a, b = (F.lit(10) + n % 15).cast("string"), (F.lit(11) + n % 15).cast("string")
    title = F.when(n % 4 == 0, F.concat(F.lit("Handbook 20"), a, F.lit("-"), b)).when(n % 4 == 1, F.concat(F.lit("for 20"), a, F.lit(" / 20"), b, F.lit(" only"))).otherwise("none")
    text = F.when(n % 3 == 0, "text of 2021–22").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", web.school_year(title, text).alias("school_year"))


# Families that a run may name, with their aliases.
@query("""WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN ' Handbook ' WHEN 1 THEN 'admissions' WHEN 2 THEN 'publication' WHEN 3 THEN 'athletics' WHEN 4 THEN 'unknown' END AS given FROM pages)
SELECT page_id, CASE trim(given) WHEN 'Handbook' THEN 'Handbook' WHEN 'admissions' THEN 'admissions_general' WHEN 'publication' THEN 'academic_publications' WHEN 'athletics' THEN 'athletics' ELSE trim(given) END AS family FROM f""")
def family_aliases(spark, sf_dir):
    n = F.col("page_id") % 6
    given = F.when(n == 0, " Handbook ").when(n == 1, "admissions").when(n == 2, "publication").when(n == 3, "athletics").when(n == 4, "unknown")
    return table(spark, sf_dir, "pages").select("page_id", web.family_alias(given).alias("family"))


_COURSES = """'{"title": "Course ' || item_id || '", "description": "' || (item_id % 3) || ' things", ' || CASE WHEN item_id % 4 = 0 THEN '"courseCode": " C ' || item_id || '"' WHEN item_id % 4 = 1 THEN '"departmentName": "D"' WHEN item_id % 4 = 2 THEN '"prereqs": "none"' ELSE '"code": ""' END || '}'"""


@query(f"""SELECT 'http://x/' || item_id AS source_url, 'Course ' || item_id AS title, CASE WHEN item_id % 4 = 0 THEN 'C ' || item_id END AS course_code, CASE WHEN item_id % 4 = 1 THEN 'D' END AS department,
  CASE WHEN item_id % 4 = 0 THEN 'c-' || item_id ELSE 'course-' || item_id END AS course_key, CASE WHEN item_id % 4 = 0 THEN 'C ' || item_id ELSE 'Course ' || item_id END AS citation_label FROM benchmark WHERE item_id % 4 < 2""")
def course_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    objects = b.select(F.concat(F.lit("http://x/"), "item_id").alias("source_url"), F.lit("2021-22").alias("school_year"), F.expr(_COURSES).alias("object"))
    return typed.course_rows(objects, "s1").select("source_url", "title", "course_code", "department", "course_key", "citation_label")


_FACULTY = """'{"fullName": "Name  ' || item_id || '", ' || CASE WHEN item_id % 3 = 0 THEN '"title": "Dean"' WHEN item_id % 3 = 1 THEN '"bio": "Long"' ELSE '"role": " "' END || '}'"""


@query("""SELECT 'http://x/' || item_id AS source_url, 'Name ' || item_id AS name, 'name-' || item_id AS faculty_key, CASE WHEN item_id % 3 = 0 THEN 'Dean' END AS role_title, CASE WHEN item_id % 3 = 1 THEN 'Long' END AS bio FROM benchmark WHERE item_id % 3 < 2""")
def faculty_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return typed.faculty_rows(b.select(F.concat(F.lit("http://x/"), "item_id").alias("source_url"), F.expr(_FACULTY).alias("object")), "s1").select("source_url", "name", "faculty_key", "role_title", "bio")


_TEAM = """'{"athletics": {"teams": [{"team": "T ' || item_id || '", "season": "S", "games": [{"opponent": "O1", "result": "W ' || (item_id % 7) || '"}, {"date": "d"}, {"opponent": "O2"}], "records": [{"event": "E", "mark": "' || item_id || '"}, {"name": "no value"}]}, {"coach": "without a name"}]}}'"""


@query("""SELECT 'team' AS kind, 't-' || item_id AS team_key, 'S' AS detail FROM benchmark UNION ALL SELECT 'game', 't-' || item_id, 'O1 W ' || (item_id % 7) FROM benchmark UNION ALL SELECT 'game', 't-' || item_id, 'O2 ' FROM benchmark
UNION ALL SELECT 'record', 't-' || item_id, 'E ' || item_id FROM benchmark""")
def athletics_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    teams, games, records = typed.athletics_rows(b.select(F.concat(F.lit("http://x/"), "item_id").alias("source_url"), F.lit("2021-22").alias("school_year"), F.expr(_TEAM).alias("payload")), "s1")
    out = teams.select(F.lit("team").alias("kind"), "team_key", F.col("season").alias("detail"))
    out = out.union(games.select(F.lit("game"), "team_key", F.concat(F.col("opponent"), F.lit(" "), F.coalesce("result", F.lit("")))))
    return out.union(records.select(F.lit("record"), "team_key", F.concat("label", F.lit(" "), "value")))


_CATALOG = """'intro line' || chr(10) || 'MATH ' || (100 + item_id % 800) || ' - Numbers' || chr(10) || 'About numbers.' || chr(10) || 'More of it.' || chr(10) || 'ART' || (100 + item_id % 800) || ': Colors' || chr(10) || 'All colors.' || chr(10) || 'BIO 7777 Empty'"""


@query("""SELECT 'http://x/' || item_id AS source_url, c.code AS course_code, c.title AS title, c.description AS description FROM (SELECT item_id, unnest([{'code': 'MATH ' || (100 + item_id % 800), 'title': 'Numbers', 'description': 'About numbers. More of it.'},
  {'code': 'ART' || (100 + item_id % 800), 'title': 'Colors', 'description': 'All colors.'}]) AS c FROM benchmark)""")
def course_rows_from_text(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return typed.course_rows_from_text(b.select(F.concat(F.lit("http://x/"), "item_id").alias("source_url"), F.expr(_CATALOG.replace("chr(10)", r"'\n'")).alias("text")))


_UNCODED = """'Science' || chr(10) || 'Field Biology ' || item_id || chr(10) || 'This course looks at fields.' || chr(10) || 'Prerequisite: none of ' || item_id || chr(10) || 'Geology' || chr(10) || '12 rocks are seen.' || chr(10) || 'Meet our faculty' || chr(10) || 'Lost Title' || chr(10) || 'Lost text.'"""


@query("""SELECT 'http://x/' || item_id AS source_url, c.title AS title, c.description AS description, c.prerequisites AS prerequisites FROM (SELECT item_id, unnest([{'title': 'Field Biology ' || item_id, 'description': 'This course looks at fields.', 'prerequisites': 'none of ' || item_id},
  {'title': 'Geology', 'description': '12 rocks are seen.', 'prerequisites': NULL}]) AS c FROM benchmark)""")
def course_rows_by_title(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return typed.course_rows_by_title(b.select(F.concat(F.lit("http://x/"), "item_id").alias("source_url"), F.lit("Science").alias("department"), F.lit("Page").alias("page_title"), F.expr(_UNCODED.replace("chr(10)", r"'\n'")).alias("text")))


@query("""SELECT 'http://x/' || item_id AS source_url, 'Ann Lee' AS name, 'Teacher of ' || item_id AS role_title, 'Knows much. And more.' AS bio FROM benchmark WHERE item_id % 2 = 0""")
def faculty_rows_from_text(spark, sf_dir):
    n = F.col("item_id")
    text = F.when(n % 2 == 0, F.concat(F.lit("Ann  Lee\nTeacher of "), n.cast("string"), F.lit("\nKnows much.\nAnd more."))).otherwise(F.concat(F.lit("Ann\nTeacher of "), n.cast("string")))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("http://x/"), n).alias("source_url"), text.alias("text"))
    return typed.faculty_rows_from_text(b).select("source_url", "name", "role_title", "bio")


_HANDBOOK = """CASE WHEN item_id % 2 = 0 THEN 'cover' || chr(10) || '=== Page 3 ===' || chr(10) || 'Rules of ' || item_id || chr(10) || 'Be kind.' || chr(10) || '=== Page 4 ===' || chr(10) || '  ' || chr(10) || '=== Page 9 ===' || chr(10) || 'Last' ELSE 'short text of ' || item_id END"""


@query("""SELECT 'http://x/' || item_id AS source_url, p.page_start AS page_start, p.heading AS heading, p.text AS text FROM (SELECT item_id, unnest(CASE WHEN item_id % 2 = 0 THEN [{'page_start': 3, 'heading': 'Rules of ' || item_id, 'text': 'Rules of ' || item_id || chr(10) || 'Be kind.'},
  {'page_start': 9, 'heading': 'Last', 'text': 'Last'}] ELSE [{'page_start': 1, 'heading': 'short text of ' || item_id, 'text': 'short text of ' || item_id}] END) AS p FROM benchmark)""")
def handbook_sections(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return typed.handbook_sections(b.select(F.concat(F.lit("http://x/"), "item_id").alias("source_url"), F.expr(_HANDBOOK.replace("chr(10)", r"'\n'")).alias("text")))


@query(r"""WITH q AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS r FROM documents) SELECT doc_id, round(r, 6) AS quality, CASE WHEN r < 0.6 THEN 'degraded' ELSE 'native' END AS extraction_mode FROM q""")
def native_text_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("q", web.native_quality(F.col("t")))
    return d.select("doc_id", F.round("q", 6).alias("quality"), web.extraction_mode(F.col("q")).alias("extraction_mode"))


@query(f"""{LINE_CHUNKS_SQL}, n AS (SELECT family, count(*) AS documents FROM dc GROUP BY family), k AS (SELECT family, count(*) AS chunks FROM lc JOIN dc ON dc.id = lc.document_id GROUP BY family)
SELECT family, true AS refreshed, documents, coalesce(chunks, 0) AS chunks FROM n LEFT JOIN k USING (family)""")
def family_metrics(spark, sf_dir):
    # A page without an address has no id, not that of the empty address: it is counted, its chunks belong to no document.
    documents = web.documents_of(table(spark, sf_dir, "pages"), "s1").withColumn("id", F.when(F.col("source_url").isNotNull(), F.col("id")))
    return web.family_metrics(documents, web.chunks_of(documents.filter("source_url IS NOT NULL")))
