"""Driver queries of snapshot tables: lookups, upserts, carry-forward, searches, comparison, routing, hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.operators import snapshots, typed, web
from textloom.queries import _TOKENS, query, table
from textloom.queries_rules import any_of
from textloom.queries_web import LINE_CHUNKS_SQL, TITLE
from textloom.sources import sinks

# --- tables ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%licensed under%' OR source ILIKE '%licensed under%' OR text ILIKE '%token =%' OR source ILIKE '%token =%' ORDER BY doc_id LIMIT 25")
def substring_search(spark, sf_dir):
    return snapshots.substring_search(table(spark, sf_dir, "documents"), ["licensed under", "token ="], ["text", "source"], "doc_id", 25).select("doc_id", "source")


@query("SELECT 'all' AS kind, o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'term', o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' UNION ALL SELECT 'key', o_orderkey FROM orders WHERE o_orderkey = 32")
def section_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda name, rows: rows.select(F.lit(name).alias("kind"), "o_orderkey")
    sections = lambda *term: snapshots.sections_of(o, 7, *term, course_col="o_custkey", term_col="o_orderstatus")
    return part("all", sections()).union(part("term", sections("F"))).union(part("key", snapshots.lookup(o, "o_orderkey", 32)))


_SNAPSHOTS = """SELECT 'snap' || n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS grp, lpad(CAST((n_nationkey * 7) % 25 AS VARCHAR), 2, '0') AS created_at, n_nationkey % 3 = 0 AS completed, n_nationkey = 6 AS current FROM nation"""


def _snapshot_rows(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("snap"), n).alias("id"), F.col("n_regionkey").cast("string").alias("grp"), F.lpad((n * 7 % 25).cast("string"), 2, "0").alias("created_at"), (n % 3 == 0).alias("completed"), (n == 6).alias("current")
    )


@query(f"""WITH s AS ({_SNAPSHOTS}), r AS (SELECT 'all' AS scope, * FROM s UNION ALL SELECT 'no_current', id, grp, created_at, completed, false FROM s UNION ALL SELECT 'open', id, grp, created_at, false, false FROM s)
SELECT scope, id FROM r QUALIFY row_number() OVER (PARTITION BY scope ORDER BY current AND completed DESC, completed DESC, created_at DESC, id DESC) = 1""")
def snapshot_resolution(spark, sf_dir):
    s = _snapshot_rows(spark, sf_dir)
    parts = {"all": s, "no_current": s.withColumn("current", F.lit(False)), "open": s.withColumn("current", F.lit(False)).withColumn("completed", F.lit(False))}
    out = None
    for name, rows in parts.items():
        one = snapshots.resolve(rows).select(F.lit(name).alias("scope"), "id")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH s AS ({_SNAPSHOTS}) SELECT id, completed OR id = 'snap4' AS completed, id = 'snap4' AS current FROM s")
def snapshot_completion(spark, sf_dir):
    return snapshots.complete(_snapshot_rows(spark, sf_dir), "snap4").select("id", "completed", "current")


@query("""SELECT 'snapshot-' || left(sha256('["weekly","pack.json"]'), 24) AS id, false AS completed, false AS current""")
def snapshot_creation(spark, sf_dir):
    return snapshots.create("weekly", "2024-01-01", seed_url_pack="pack.json")(spark).select("id", "completed", "current")


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0), u AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'U' AS o_orderstatus FROM n UNION ALL SELECT o_orderkey, o_totalprice + 2, 'U' FROM n WHERE o_orderkey % 2 = 0 UNION ALL SELECT -o_orderkey, 0.0, 'N' FROM n),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice DESC, o_orderstatus DESC) = 1)
SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS o_totalprice, o_orderstatus FROM l UNION ALL SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE), o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)""")
def upsert_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    n = o.filter("o_orderkey % 5 = 0")
    u = n.select("o_orderkey", F.col("o_totalprice") + 1, F.lit("U")).union(n.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice") + 2, F.lit("U"))).union(n.select(-F.col("o_orderkey"), F.lit(0.0), F.lit("N"))).toDF(*o.columns)
    return snapshots.upsert(o, u, ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


_MODES = "CASE page_id % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'ocr' WHEN 2 THEN 'native' ELSE CASE WHEN page_id % 8 = 3 THEN 'degraded' ELSE 'native' END END"


@query(f"""WITH d AS (SELECT page_id % 4 AS snap, {_MODES} AS m FROM pages), g AS (SELECT snap, bool_and(m NOT IN ('degraded', 'uncitable')) AS citable, array_to_string(list_sort(list(DISTINCT m)), ',') AS modes FROM d GROUP BY snap)
SELECT snap, citable, modes FROM g UNION ALL SELECT 9, false, ''""")
def snapshot_quality(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("snapshot_id"), F.expr(_MODES).alias("extraction_mode"))
    out = None
    for snap in (0, 1, 2, 3, 9):
        one = snapshots.citable(snapshots.scan(d, snap)).select(F.lit(snap).cast("long").alias("snap"), "citable", F.array_join("modes", ",").alias("modes"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT item_id, 'title ' || item_id || ' a b k v' AS text FROM benchmark")
def flattened_fields(spark, sf_dir):
    n = F.col("item_id").cast("string")
    values = {"title": F.concat(F.lit("title "), n), "list": F.array(F.lit("a"), F.lit("b")), "map": F.create_map(F.lit("k"), F.lit("v")), "none": F.lit(None).cast("string")}
    return table(spark, sf_dir, "benchmark").select("item_id", snapshots.flatten_values(values, {"list": "array", "map": "map"}).alias("text"))


@query(f"""{LINE_CHUNKS_SQL}, ks AS (SELECT family, count(*) AS documents FROM dc WHERE family <> 'general' GROUP BY family)
SELECT 's2' AS snapshot_id, 'doc-' || left(sha256('["s2","' || source_url || '"]'), 24) AS id, source_url, CAST((SELECT count(*) FROM lc WHERE lc.document_id = dc.id) AS BIGINT) AS chunks FROM dc WHERE family = 'general'""")
def carried_documents(spark, sf_dir):
    documents = web.documents_of(table(spark, sf_dir, "pages"), "s1")
    chunks = web.chunks_of(documents)
    moved, parts = snapshots.carry_forward(documents, chunks, "s1", "s2", ["general"])
    counted = parts.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    return moved.join(counted, "id", "left").select("snapshot_id", "id", "source_url", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"""{LINE_CHUNKS_SQL}, f AS (SELECT page_id, source_url, id, CASE page_id % 3 WHEN 0 THEN 'athletics' WHEN 1 THEN 'faculty' ELSE 'handbook' END AS family FROM dc)
SELECT family, count(*) AS documents, CAST(sum((SELECT count(*) FROM lc WHERE lc.document_id = f.id)) AS BIGINT) AS chunks FROM f WHERE family = 'athletics' OR page_id % 2 = 0 GROUP BY family""")
def snapshot_sync(spark, sf_dir):
    def ingest(pages, snapshot):
        kind = F.when(F.col("page_id") % 3 == 0, "athletics").when(F.col("page_id") % 3 == 1, "faculty").otherwise("handbook")
        documents = web.documents_of(pages, snapshot).withColumn("family", kind)
        return documents, web.chunks_of(documents)

    p = table(spark, sf_dir, "pages")
    # The old snapshot holds every other page, and the chunks of its addresses; one family is ingested anew.
    old, parts = ingest(p, "s1")
    documents, chunks = snapshots.sync(ingest(p, "s2"), (old.filter("page_id % 2 = 0"), parts), "s1", "s2", ["athletics"], ["athletics", "faculty", "handbook"])
    counted = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return documents.join(counted, "id", "left").groupBy("family").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))


# --- searches --------------------------------------------------------------------------------------------------------

_PAGES = f"(SELECT page_id, url, {TITLE} AS title, CASE WHEN page_id % 2 = 0 THEN '2021-22' ELSE '2022-23' END AS school_year FROM pages)"
_ASKED = f"(SELECT page_id AS query_id, lower({TITLE}) AS q FROM pages WHERE page_id % 100 = 0)"
_SCORE = f"round(CASE WHEN contains(h, q) AND q <> '' THEN 8.0 ELSE 0.0 END + 1.5 * len(list_intersect({_TOKENS('q')}, {_TOKENS('h')})), 6)::DOUBLE"


def _titles(spark, sf_dir):
    year = F.when(F.col("page_id") % 2 == 0, "2021-22").otherwise("2022-23")
    return table(spark, sf_dir, "pages").select("page_id", "url", web.title(F.col("html")).alias("title"), year.alias("school_year"))


def _asked(spark, sf_dir):
    return _titles(spark, sf_dir).filter("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), F.col("title").alias("query"))


@query(f"""WITH r AS (SELECT page_id, lower(concat_ws(' ', title, url)) AS h FROM {_PAGES} p WHERE page_id % 3 < 2), s AS (SELECT query_id, page_id, {_SCORE} AS score FROM r, {_ASKED} a)
SELECT query_id, page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def typed_search(spark, sf_dir):
    rows = _titles(spark, sf_dir).withColumn("source_url", F.col("url")).withColumn("family", (F.col("page_id") % 3).cast("string")).withColumn("snapshot_id", F.lit("s1"))
    return snapshots.typed_search("document", _asked(spark, sf_dir), rows, "s1", "page_id", fuzzy=False, family=["0", "1"])


COMPARE_SQL = f"""WITH v AS (SELECT page_id // 2 AS course_key, school_year, title || CASE WHEN page_id % 7 = 1 THEN '' ELSE '' END AS title, lower(CASE WHEN page_id % 10 IN (4, 5) THEN 'Fixed Course' ELSE title END) AS t FROM {_PAGES} p WHERE page_id % 11 <> 3),
s AS (SELECT query_id, school_year, course_key, t, {_SCORE.replace("h,", "t,").replace("lower(h)", "lower(t)")} AS score FROM v, {_ASKED} a),
h AS (SELECT query_id, school_year, course_key, t FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, school_year ORDER BY score DESC, course_key) <= 200),
b AS (SELECT query_id FROM h GROUP BY query_id HAVING count(DISTINCT school_year) = 2),
m AS (SELECT query_id, course_key, x.t AS ta, y.t AS tb FROM (SELECT * FROM h WHERE school_year = '2021-22') x FULL JOIN (SELECT * FROM h WHERE school_year = '2022-23') y USING (query_id, course_key) WHERE query_id IN (SELECT query_id FROM b)),
c AS (SELECT query_id, course_key, CASE WHEN ta IS NULL THEN 'added' WHEN tb IS NULL THEN 'removed' WHEN ta <> tb THEN 'changed' END AS status FROM m),
k AS (SELECT * FROM c WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, status ORDER BY course_key) <= 20)"""


def _versions(spark, sf_dir):
    title = F.when((F.col("page_id") % 10).isin(4, 5), "Fixed Course").otherwise(F.col("title"))
    return _titles(spark, sf_dir).filter("page_id % 11 <> 3").select(F.floor(F.col("page_id") / 2).alias("course_key"), "school_year", title.alias("title"))


@query(f"{COMPARE_SQL} SELECT query_id, course_key, status FROM k")
def course_changes(spark, sf_dir):
    return snapshots.compare_versions(_asked(spark, sf_dir), _versions(spark, sf_dir), "2021-22", "2022-23", ["title"], fuzzy=False)


@query(f"""{COMPARE_SQL}, l AS (SELECT course_key, min(CASE WHEN t = 'fixed course' THEN 'Fixed Course' ELSE title END) AS label FROM v GROUP BY course_key), n AS (SELECT k.*, label, CASE status WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END AS o, row_number() OVER (PARTITION BY query_id, status ORDER BY course_key) AS i FROM k JOIN l USING (course_key)),
g AS (SELECT query_id, o, upper(left(status, 1)) || substr(status, 2) || ': ' || string_agg(label, '; ' ORDER BY i) AS line, list(label ORDER BY i)[1:3] AS cited FROM n GROUP BY query_id, o, status)
SELECT query_id, string_agg(line, chr(10) ORDER BY o) AS content, array_to_string(flatten(list(cited ORDER BY o))[1:5], '|') AS citations FROM g GROUP BY query_id""")
def course_change_hits(spark, sf_dir):
    rows = _versions(spark, sf_dir)
    changes = snapshots.compare_versions(_asked(spark, sf_dir), rows, "2021-22", "2022-23", ["title"], fuzzy=False)
    return snapshots.change_hits(changes, rows, "course_key", "title", "title").withColumn("citations", F.array_join("citations", "|"))


# --- routing and hits ------------------------------------------------------------------------------------------------

_YEARS = "CASE item_id % 3 WHEN 0 THEN 'from 2020-21 to 2021/2022' WHEN 1 THEN 'in 2019 – 20 only' ELSE 'no year' END"


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN '2020-21,2021-22' WHEN 1 THEN '2019-20' ELSE '' END AS years FROM benchmark")
def asked_school_years(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(snapshots.school_years(F.expr(_YEARS)), ",").alias("years"))


@query(f"""SELECT conv_id, turn, {any_of("lower(coalesce(text, ''))", snapshots.DEPARTMENTS)} AND {any_of("lower(coalesce(text, ''))", snapshots.LISTINGS)} AND NOT regexp_matches(coalesce(text, ''), '\\b[A-Z]{{2,4}}\\s?\\d{{3}}\\b') AS overview FROM conversations""".replace("\\\\", "\\"))
def overview_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", snapshots.asks_overview(F.coalesce("text", F.lit(""))).alias("overview"))


_HITS = f"(SELECT page_id, page_id % 20 AS query_id, page_id // 20 + 1 AS rank, title, url FROM {_PAGES} p)"


def _hit_rows(spark, sf_dir):
    return _titles(spark, sf_dir).withColumn("query_id", F.col("page_id") % 20).withColumn("rank", F.floor(F.col("page_id") / 20) + 1)


@query(f"""WITH h AS (SELECT *, contains(lower(title), 'th') OR contains(lower(title), 'qu') AS p FROM {_HITS} x), m AS (SELECT *, bool_or(p) OVER (PARTITION BY query_id) AS any_p FROM h) SELECT query_id, page_id FROM m WHERE p = any_p""")
def preferred_hits(spark, sf_dir):
    return typed.preferred(_hit_rows(spark, sf_dir), "query_id", "title", ["th", "qu"]).select("query_id", "page_id")


@query(f"""WITH h AS (SELECT query_id, page_id, CASE WHEN query_id % 2 = 0 THEN page_id % 3 ELSE 1 + page_id % 2 END AS priority FROM {_HITS} x) SELECT query_id, page_id, priority FROM h QUALIFY priority = min(priority) OVER (PARTITION BY query_id)""")
def fallback_hits(spark, sf_dir):
    h = _hit_rows(spark, sf_dir).select("query_id", "page_id")
    kind = F.when(F.col("query_id") % 2 == 0, F.col("page_id") % 3).otherwise(1 + F.col("page_id") % 2)
    out = snapshots.first_nonempty([h.filter(kind == k) for k in range(3)], "query_id")
    return out.select("query_id", "page_id", F.col("priority").cast("long").alias("priority"))


@query(f"""WITH h AS (SELECT *, left(title, 4) AS k FROM {_HITS} x), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY rank, page_id) = 1)
SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, page_id) AS hit_no FROM o QUALIFY hit_no <= 4""")
def deduplicated_hits(spark, sf_dir):
    h = _hit_rows(spark, sf_dir).withColumn("k", F.left("title", F.lit(4)))
    return snapshots.distinct_hits(h, "query_id", ["k"], ["rank", "page_id"], 4).select("query_id", "page_id", F.col("hit_no").cast("long").alias("hit_no"))


@query(f"""WITH h AS (SELECT * FROM {_HITS} x), u AS (SELECT 0 AS n, query_id, page_id, rank FROM h WHERE rank <= 3 AND page_id % 2 = 0 UNION ALL SELECT 1, query_id, page_id, rank FROM h WHERE rank <= 3 UNION ALL SELECT 2, query_id, page_id, rank FROM h WHERE rank <= 3 AND query_id % 3 = 0),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY n, rank) = 1) SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY n, rank) AS hit_no FROM o QUALIFY hit_no <= 6""")
def planner_hits(spark, sf_dir):
    h = _hit_rows(spark, sf_dir).select("query_id", "page_id", "rank")
    queries = h.select("query_id").distinct()
    out = snapshots.union_hits([(h.filter("page_id % 2 = 0"), None), (h, None), (h, F.col("query_id") % 3 == 0)], queries, "query_id", ["page_id"], 6)
    return out.select("query_id", "page_id", F.col("hit_no").cast("long").alias("hit_no"))


@query("""SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'MATH ' || (100 + item_id % 800) || '|MATH' || (100 + item_id % 800) || '|math ' || (100 + item_id % 800) ELSE 'BIO ' || (100 + item_id % 800) || '|BIO' || (100 + item_id % 800) END AS terms FROM benchmark""")
def catalog_code_terms(spark, sf_dir):
    n = F.lit(100) + F.col("item_id") % 800
    code = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("math "), n)).otherwise(F.concat(F.lit("BIO"), n))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(snapshots.catalog_terms(code), "|").alias("terms"))


@query(f"""WITH h AS (SELECT * FROM {_HITS} x WHERE rank <= 3 AND query_id <> 5), q AS (SELECT DISTINCT query_id FROM {_HITS} x)
SELECT query_id, coalesce(string_agg(title || ': ' || url, chr(10) || chr(10) ORDER BY rank), 'No matching records were found.') AS context, max(left(url, 12)) AS snippet FROM q LEFT JOIN h USING (query_id) GROUP BY query_id""")
def hit_contexts(spark, sf_dir):
    h = _hit_rows(spark, sf_dir)
    found = typed.hits(h.filter("rank <= 3 AND query_id <> 5"), "title", "url", "url", 12).select("query_id", "rank", "hit")
    asked = h.select("query_id").distinct().join(found, "query_id", "left")
    shown = asked.groupBy("query_id").agg(F.max(F.get("hit.citations", F.lit(0))["snippet"]).alias("snippet"))
    return typed.hit_context(asked).join(shown, "query_id")


# --- sinks -----------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'run/' || ps % 40 AS path, value AS metric, event_id AS step FROM (SELECT *, event_id % 97 AS ps FROM events)), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY metric, step) = 1)
SELECT path, step, row_number() OVER (ORDER BY metric, step) <= 7 AS keep FROM o""")
def candidate_retention(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("run/"), F.col("event_id") % 97 % 40).alias("path"), F.col("value").alias("metric"), F.col("event_id").alias("step"))
    return sinks.retention(c, "path", "metric", "step", 7).select("path", "step", "keep")


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'blocked' WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN 'dev_only' ELSE 'promotable' END AS status FROM pages""")
def artifact_statuses(spark, sf_dir):
    n = F.col("page_id")
    unknown = lambda c: F.when(n % 2 == 0, c).when(c, c)
    return table(spark, sf_dir, "pages").select("page_id", sinks.artifact_status(unknown(n % 7 == 0), unknown(n % 3 == 0), unknown(n % 5 == 0)).alias("status"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def exported_examples(spark, sf_dir):
    return sinks.export_examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), f"{sinks.shared_folder(spark)}/export-{uuid.uuid4().hex}")


@query("SELECT 'k=' || r_regionkey AS folder, CAST(strlen(r_name) + 1 AS BIGINT) AS bytes, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_hashes(spark, sf_dir):
    folder = f"{sinks.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("value")).repartition("k").write.partitionBy("k").text(folder)
    return sinks.file_manifest(spark, folder, "part-*").select(F.substring_index("path", "/", 1).alias("folder"), "bytes", "sha256")


@query("SELECT conv_id, count(*) AS n FROM (SELECT conv_id FROM conversations UNION ALL SELECT conv_id FROM conversations WHERE conv_id % 2 = 0) GROUP BY conv_id")
def appended_history(spark, sf_dir):
    folder = f"{sinks.shared_folder(spark)}/history-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").select("conv_id")
    sinks.append_history(rows, folder)
    sinks.append_history(rows.filter("conv_id % 2 = 0"), folder)
    return spark.read.parquet(folder).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
