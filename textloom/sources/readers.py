"""Reading: text lines, JSON, Parquet, Arrow files, whole files; record windows; configuration."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class SourceSpec:
    """One source of a corpus, as configuration names it."""

    name: str
    paths: list[str]
    format: str = "text"
    weight: float = 1.0
    family: str | None = None
    text_field: str = "text"
    id_field: str | None = None
    metadata_fields: list[str] = field(default_factory=list)
    quality_filter_mode: str = "basic"
    deduplicate: bool = True
    skip_records: int = 0
    max_records: int | None = None


@dataclass
class CorpusSpec:
    sources: list[SourceSpec]
    min_document_chars: int = 128
    max_document_chars: int = 200_000
    sequence_length: int = 512
    max_source_token_share: float = 1.0
    max_source_repeat_rate: float = 0.0
    token_budget: int | None = None


def load_config(path: str) -> dict:
    """A JSON or TOML file of the driver."""
    raw = Path(path).read_text(encoding="utf-8")
    return tomllib.loads(raw) if path.endswith(".toml") else json.loads(raw)


def corpus_spec(config: dict) -> CorpusSpec:
    """Known keys of a configuration; unknown ones are left out."""
    known = lambda kind, d: {k: v for k, v in d.items() if k in kind.__dataclass_fields__}
    return CorpusSpec(**known(CorpusSpec, config) | {"sources": [SourceSpec(**known(SourceSpec, s)) for s in config["sources"]]})


#: Columns that give records their place: the file, the start of the part of it that was read at once, and the row there.
ORDER = ("file_name", "block_start", "row_in_block")


def placed(df: DataFrame) -> DataFrame:
    """Rows of a file scan with ORDER: files in the order of their names, and rows as they stand in each. Spark may read
    several parts of files in one task and one file in several, so the row's number in its task is not its place in the
    file; within one part it is."""
    return df.select("*", F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_in_block"))


def read(spark: SparkSession, spec: SourceSpec, schema: StructType | str | None = None) -> DataFrame:
    """The records of a source as (source, family, text, document_id, metadata fields ...) with ORDER, in the order of file
    names and of rows in the files."""
    if spec.format == "text":
        raw = placed(spark.read.text(spec.paths).withColumnRenamed("value", spec.text_field))
    elif spec.format == "jsonl":
        kind = schema or StructType.fromDDL(", ".join(f"`{c}` string" for c in dict.fromkeys([spec.text_field, *([spec.id_field] if spec.id_field else []), *spec.metadata_fields])))
        raw = placed(spark.read.schema(kind).json(spec.paths))
    elif spec.format == "parquet":
        raw = placed(spark.read.parquet(*spec.paths))
    elif spec.format == "arrow":
        raw = arrow_files(spark, spec.paths)
    else:
        raise ValueError(f"unknown format: {spec.format}")
    wanted = [F.col(spec.text_field).alias("text"), (F.col(spec.id_field).cast("string") if spec.id_field else F.lit(None).cast("string")).alias("document_id")]
    out = raw.select(F.lit(spec.name).alias("source"), F.lit(spec.family or spec.name).alias("family"), *ORDER, *wanted, *[c for c in spec.metadata_fields if c in raw.columns])
    return record_window(out, list(ORDER), spec.skip_records, spec.max_records)


def arrow_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Arrow IPC files with ORDER, decoded on the executors, one record batch at a time of a file that its task reads. All
    files must have the schema of the first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def opened(b: bytes):
        return pa.ipc.open_file(pa.py_buffer(b)) if bytes(b[:6]) == b"ARROW1" else pa.ipc.open_stream(pa.py_buffer(b))

    first = opened(files.orderBy("path").limit(1).collect()[0]["content"]).schema
    found = from_arrow_schema(first)
    whole = StructType([*found.fields, *StructType.fromDDL("file_name string, block_start long, row_in_block long").fields])
    target = to_arrow_schema(whole)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                source, at = opened(content.as_py()), 0
                if source.schema.names != first.names:
                    raise ValueError(f"{path} does not have the schema of the first file")
                for b in (source.get_batch(i) for i in range(source.num_record_batches)) if hasattr(source, "num_record_batches") else source:
                    n = b.num_rows
                    place = [pa.array([path] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                    at += n
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, *place], target)], schema=target)

    return files.mapInArrow(run, whole)


def record_window(df: DataFrame, order: Sequence[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """Rows from skip on, most of them, in a total order."""
    if not skip and most is None:
        return df
    out = df.orderBy(*order).offset(skip) if skip else df.orderBy(*order)
    return out if most is None else out.limit(most)


def advanced(spec: SourceSpec, consumed: int) -> SourceSpec:
    """The source from where an earlier run stopped."""
    most = None if spec.max_records is None else max(spec.max_records - consumed, 0)
    return SourceSpec(**{**spec.__dict__, "skip_records": spec.skip_records + consumed, "max_records": most})


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole files below a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1; a byte order mark is dropped."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\\uFEFF", "")


def seed_entries(packs: Sequence[DataFrame], key: Sequence[str] = ("url", "page_type", "school_year", "department"), order: str | None = None) -> DataFrame:
    """Entries of all packs; of one key, that of the last pack stays, and in one pack the last by order (a column of the
    place of an entry; without one, the greatest entry as a tuple)."""
    union = None
    for k, p in enumerate(packs):
        p = p.withColumn("__pack", F.lit(k))
        union = p if union is None else union.unionByName(p, allowMissingColumns=True)
    rest = [F.desc(order)] if order else [F.desc(c) for c in union.columns if c not in (*key, "__pack")]
    w = Window.partitionBy(*key).orderBy(F.desc("__pack"), *rest)
    return union.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__pack", "__r")


def with_record_index(df: DataFrame, order: Sequence[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """Adds record_index, from one on inside the window of records from skip on, most of them. Places come from the sizes
    of ordered ranges."""
    from textloom.operators.ranges import ranked

    out = ranked(df, list(order), "record_index").withColumn("record_index", F.col("record_index") + 1 - skip).filter(F.col("record_index") >= 1)
    return out if most is None else out.filter(F.col("record_index") <= most)


def dual_cap(df: DataFrame, order: str, text: str, most_docs: int, most_chars: int) -> DataFrame:
    """Rows in order while the rows before are fewer than most_docs and their characters, a line end each, than
    most_chars; the row that crosses stays. Sums come from totals of ordered ranges."""
    from textloom.operators.mixing import budget_prefix

    narrow = df.select(order, (F.length(text) + 1).cast("long").alias("__c"), F.lit(1).cast("long").alias("__one"))
    by_chars = budget_prefix(narrow, [order], "__c", most_chars).select(order, "__one")
    kept = budget_prefix(by_chars, [order], "__one", most_docs).select(order)
    return df.join(kept, order, "left_semi")


def raw_prompt(prompt: Column, messages: Column, prefix: str = "Continue this passage in one coherent paragraph:\n") -> Column:
    """The prompt, stripped; without one, the last user message without a fixed prefix; else nothing."""
    said = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]
    said = F.coalesce(said, F.lit(""))
    plain = F.when(said.startswith(prefix), F.substr(said, F.lit(len(prefix) + 1))).otherwise(said)
    return F.regexp_replace(F.coalesce(prompt, plain), r"(?U)^\s+|\s+$", "")


def regression_records(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Held-out prompts (messages, else prompt; tags, expected_mode, allowed and forbidden sources, requires_source) with
    defaults and the signature of their prompt; up to limit in order."""
    from textloom.operators.chat import coalesce_messages, signature, signature_text

    have = set(rows.columns)
    get = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    none = F.array().cast("array<string>")
    message = "array<struct<role:string,content:string>>"
    messages = coalesce_messages(get("messages", message), get("prompt", "string"), F.lit(None).cast("string"))
    messages = F.filter(messages, lambda m: m["content"].isNotNull())
    out = rows.select(
        order, messages.alias("messages"), F.coalesce(get("tags", "array<string>"), none).alias("tags"), get("expected_mode", "string").alias("expected_mode"),
        F.coalesce(get("allowed_source_labels", "array<string>"), none).alias("allowed_sources"), F.coalesce(get("forbidden_source_labels", "array<string>"), none).alias("forbidden_sources"),
        F.coalesce(get("requires_source_label", "boolean"), F.lit(False)).alias("requires_source"),
    )
    out = out.withColumns({"prompt_signature_text": signature_text(F.col("messages")), "prompt_signature_hash": signature(F.col("messages"))})
    return out if limit is None else out.orderBy(order).limit(limit)


def tolerant_json(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Lines of JSON as parsed (null where a line is none) and broken; blank lines are left out."""
    given = lines.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    kind = schema + ", _broken string"
    parsed = F.from_json(F.col(text), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return given.select("*", parsed.alias("__p")).select(*lines.columns, F.when(F.col("__p._broken").isNull(), F.col("__p")).alias("parsed"), F.col("__p._broken").isNotNull().alias("broken"))
