"""Driver queries of readers and writers: every format, windows, order over several files, packs, configuration."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.operators import typed
from textloom.queries import _conversations, SQUEEZE, SQUEEZED, query, squeezed, table
from textloom.sources import readers
from textloom.sources.readers import SourceSpec
from textloom.sources.sinks import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_DIGESTS = "SELECT count(*) AS n, CAST(sum(('0x' || left(md5(t), 8))::BIGINT) AS BIGINT) AS digest FROM"


def _digest(df, column="text"):
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.left(F.md5(column), F.lit(8)), 16, 10).cast("long")).alias("digest"))


@query(f"{SQUEEZED} {_DIGESTS} d")
def text_lines_scan(spark, sf_dir):
    folder = _folder(spark, "lines")
    squeezed(spark, sf_dir).select(F.col("text").alias("value")).write.text(folder)
    return _digest(readers.read(spark, SourceSpec("docs", [folder])))


@query("""SELECT 'docs' AS source, 'family' AS family, CAST(doc_id AS VARCHAR) AS document_id, lang, md5(coalesce(text, '')) AS digest FROM documents""")
def jsonl_scan(spark, sf_dir):
    folder = _folder(spark, "jsonl")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars").write.json(folder)
    spec = SourceSpec("docs", [folder], format="jsonl", family="family", id_field="doc_id", metadata_fields=["lang"])
    return readers.read(spark, spec).select("source", "family", "document_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT 'docs' AS source, CAST(doc_id AS VARCHAR) AS document_id, lang, n_chars FROM documents")
def parquet_scan(spark, sf_dir):
    spec = SourceSpec("docs", [f"{sf_dir}/documents.parquet"], format="parquet", id_field="doc_id", metadata_fields=["lang", "n_chars"])
    return readers.read(spark, spec).select("source", "document_id", "lang", "n_chars")


def _as_arrow(path: str):
    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for k, b in enumerate(batches):
            name = f"{base}/{uuid.uuid4().hex}-{k}.arrow"
            with store.open_output_stream(name) as sink, pa.ipc.new_file(sink, b.schema) as writer:
                writer.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return run


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, md5(coalesce(text, '')) AS digest FROM documents")
def arrow_scan(spark, sf_dir):
    from pyarrow import fs

    folder = _folder(spark, "arrow")
    store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    store.create_dir(base, recursive=True)
    table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_as_arrow(folder if "://" in folder else "file://" + folder), "n long").write.format("noop").mode("overwrite").save()
    spec = SourceSpec("docs", [folder], format="arrow", id_field="doc_id")
    return readers.read(spark, spec).select("document_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


# Three files, of which the last by name was written first: records stand in the order of file names.
@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3, doc_id) - 1 AS k FROM documents) SELECT doc_id FROM o WHERE k >= 100 AND k < 450""")
def window_over_files(spark, sf_dir):
    folder = _folder(spark, "parts")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("lang").alias("text"))
    for k in (2, 0, 1):
        d.filter(F.col("doc_id") % 3 == k).coalesce(1).sortWithinPartitions("doc_id").write.json(f"{folder}/part={k}")
    spec = SourceSpec("docs", [f"{folder}/part={k}" for k in range(3)], format="jsonl", id_field="doc_id", skip_records=100, max_records=350)
    return readers.read(spark, spec).select(F.col("document_id").cast("long").alias("doc_id"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id FROM o WHERE k >= 30 AND k < 50")
def resumed_window(spark, sf_dir):
    spec = readers.advanced(SourceSpec("docs", [], skip_records=10, max_records=40), 20)
    return readers.record_window(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], spec.skip_records, spec.max_records)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 25 AS record_index FROM documents QUALIFY record_index BETWEEN 1 AND 60")
def record_indexes(spark, sf_dir):
    return readers.with_record_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 25, 60)


@query("SELECT 'a' AS name, 'text' AS format, 0.25::DOUBLE AS weight, 7 AS skip_records, 512 AS sequence_length UNION ALL SELECT 'b', 'parquet', 1.0, 0, 512")
def configured_sources(spark, sf_dir):
    spec = readers.corpus_spec({"sources": [{"name": "a", "paths": ["x"], "weight": 0.25, "skip_records": 7, "unknown": 1}, {"name": "b", "paths": ["y"], "format": "parquet"}], "more": True})
    return spark.createDataFrame([(s.name, s.format, float(s.weight), s.skip_records, spec.sequence_length) for s in spec.sources], "name string, format string, weight double, skip_records int, sequence_length int")


@query("""WITH p AS (SELECT 0 AS pack, page_id, url, 'page' AS page_type FROM pages UNION ALL SELECT 1, page_id + 1000, url, 'page' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 2, page_id + 2000, url, 'page' FROM pages WHERE page_id % 3 = 0)
SELECT url, page_id FROM p QUALIFY row_number() OVER (PARTITION BY url, page_type ORDER BY pack DESC, page_id DESC) = 1""")
def seed_entries(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("page").alias("page_type"))
    packs = [p, p.filter("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 1000), p.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 2000)]
    return readers.seed_entries(packs, ["url", "page_type"], "page_id").select("url", "page_id")


@query("SELECT 'regions' AS part, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'nations', count(*) FROM nation")
def catalog_arrays(spark, sf_dir):
    folder = _folder(spark, "catalog")
    both = [table(spark, sf_dir, t).agg(F.collect_list(F.struct("*")).alias(n)) for t, n in (("region", "regions"), ("nation", "nations"))]  # 5 and 25 rows
    both[0].crossJoin(both[1]).coalesce(1).write.json(folder)
    parts = typed.catalog_tables(spark.read.json(folder), ["regions", "nations", "programs"])
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")).select("part", "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT 'k=' || lang AS folder, CAST(sum(length(t) + 1) AS BIGINT) AS n_chars FROM (SELECT lang, " + SQUEEZE + " AS t FROM documents) GROUP BY lang")
def text_folder_scan(spark, sf_dir):
    folder = _folder(spark, "texts")
    squeezed(spark, sf_dir).select(F.col("lang").alias("k"), F.col("text").alias("value")).write.partitionBy("k").text(folder)
    files = readers.text_files(spark, folder)
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.sum(F.length("text").cast("long")).alias("n_chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'naïve café ' || doc_id ELSE left(coalesce(text, ''), 50) END AS text FROM documents")
def decoded_bytes(spark, sf_dir):
    n = F.col("doc_id")
    plain = F.left(F.coalesce("text", F.lit("")), F.lit(50))
    latin = F.encode(F.concat(F.lit("naïve café "), n.cast("string")), "ISO-8859-1")
    content = F.when(n % 3 == 0, F.encode(F.concat(F.lit("﻿"), plain), "UTF-8")).when(n % 3 == 1, F.encode(plain, "UTF-8")).otherwise(latin)
    return table(spark, sf_dir, "documents").select("doc_id", readers.decoded(content).alias("text"))


_PREFIX = "Continue this passage in one coherent paragraph:\n"


@query("""WITH u AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) FILTER (role = 'user') AS said FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'asked ' || conv_id ELSE trim(regexp_replace(coalesce(said, ''), '^\\s+|\\s+$', '', 'g')) END AS prompt FROM u""".replace("\\\\", "\\"))
def raw_prompts(spark, sf_dir):
    n = F.col("conv_id")
    prefixed = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(n % 2 == 0, F.concat(F.lit(_PREFIX), F.coalesce(m["content"], F.lit("")))).otherwise(m["content"]).alias("content")))
    given = F.when(n % 3 == 0, F.concat(F.lit("  asked "), n, F.lit("\n")))
    return _conversations(spark, sf_dir).select("conv_id", readers.raw_prompt(given, prefixed).alias("prompt"))


@query(f"""WITH l AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'p ' || conv_id ELSE {SQUEEZE} END AS said FROM conversations WHERE turn = 0 AND role = 'user')
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'p ' || conv_id ELSE said END AS said, CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE '' END AS tags, conv_id % 4 = 0 AS requires_source FROM l""")
def regression_records(spark, sf_dir):
    n = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").filter("turn = 0 AND role = 'user'")
    rows = c.select(
        "conv_id", F.when(n % 2 == 1, F.array(F.struct("role", F.coalesce("text", F.lit("")).alias("content")))).alias("messages"), F.concat(F.lit("p "), n).alias("prompt"), F.when(n % 3 == 0, F.array(F.lit("x"))).alias("tags"),
        F.when(n % 2 == 0, n % 4 == 0).when(n % 4 == 0, True).alias("requires_source_label"),
    )
    out = readers.regression_records(rows, "conv_id")
    return out.select("conv_id", F.get_json_object("prompt_signature_text", "$[0].content").alias("said"), F.array_join("tags", ",").alias("tags"), "requires_source")


@query("SELECT doc_id % 4 = 1 AS broken, count(*) AS n, CAST(sum(CASE WHEN doc_id % 4 <> 1 THEN doc_id END) AS BIGINT) AS ids FROM documents WHERE doc_id % 4 <> 3 GROUP BY ALL")
def tolerant_json(spark, sf_dir):
    n = F.col("doc_id")
    line = F.when(n % 4 == 1, "{not json").when(n % 4 == 3, "  ").otherwise(F.concat(F.lit('{"id": '), n, F.lit(', "x": [1]}')))
    lines = table(spark, sf_dir, "documents").select(line.alias("value"))
    return readers.tolerant_json(lines, "id long").groupBy("broken").agg(F.count(F.lit(1)).alias("n"), F.sum("parsed.id").alias("ids"))
