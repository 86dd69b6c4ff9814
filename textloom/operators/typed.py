"""Typed rows of a snapshot from the JSON objects and texts of pages: courses, faculty, teams, games, records; source
files with headers. Missing fields are null; several spellings of a field are tried in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.web import stable_id

HEADERS = ("title", "risk level", "allowed use")
#: Risk and use of a source by its category; a header may change them unless the category is for review or rejected.
POLICIES = {
    "rag_candidates": ("medium", "RAG"),
    "continued_pretrain_candidates": ("medium", "continued pretraining / RAG after chunking"),
    "needs_manual_review": ("high", "manual review only"),
    "rejected_template_heavy": ("high", "rejected"),
}


def field(json: Column, *names: str) -> Column:
    """The first non-empty of some fields of a JSON object, as squeezed text."""
    return F.coalesce(*[T.nonempty(F.get_json_object(json, f"$.{n}")) for n in names])


def course_rows(objects: DataFrame, snapshot: str) -> DataFrame:
    """From (source_url, school_year, object): rows with a title, a description and a code or a department."""
    o = F.col("object")
    rows = objects.select(
        "source_url", "school_year", field(o, "title", "courseTitle", "name").alias("title"), field(o, "description", "courseDescription").alias("description"),
        field(o, "code", "courseCode").alias("course_code"), field(o, "department", "departmentName").alias("department"), field(o, "level", "levelMarker").alias("level_marker"),
        field(o, "grades", "gradeEligibility").alias("grade_eligibility"), field(o, "prerequisites", "prereqs").alias("prerequisites"), field(o, "teachers", "faculty", "instructors").alias("teacher_names"),
    )
    rows = rows.filter("title IS NOT NULL AND description IS NOT NULL AND coalesce(course_code, department) IS NOT NULL")
    rows = rows.withColumn("course_key", T.slug(F.coalesce("course_code", "title"))).withColumn("snapshot_id", F.lit(snapshot))
    return rows.withColumns(
        {
            "id": stable_id("course", F.col("source_url"), F.col("school_year"), F.col("course_key"), F.col("description")),
            "content_hash": stable_id("hash", F.col("title"), F.col("course_code"), F.col("description"), F.col("school_year")),
            "citation_label": F.coalesce("course_code", "title"),
        }
    )


def faculty_rows(objects: DataFrame, snapshot: str) -> DataFrame:
    """From (source_url, object): rows with a name and a role, a department or a biography."""
    o = F.col("object")
    rows = objects.select(
        "source_url", field(o, "name", "fullName").alias("name"), field(o, "role", "title").alias("role_title"), field(o, "department").alias("department"), field(o, "bio", "description").alias("bio")
    )
    rows = rows.filter("name IS NOT NULL AND coalesce(role_title, department, bio) IS NOT NULL").withColumn("faculty_key", T.slug(F.col("name"))).withColumn("snapshot_id", F.lit(snapshot))
    return rows.withColumns(
        {
            "id": stable_id("faculty", F.col("source_url"), F.col("faculty_key"), F.col("role_title"), F.col("bio")),
            "content_hash": stable_id("hash", F.col("name"), F.col("role_title"), F.col("department"), F.col("bio")),
        }
    )


def _array(json: Column, *paths: str) -> Column:
    """The JSON objects of the first array there is at some paths."""
    return F.coalesce(*[F.from_json(F.get_json_object(json, p), "array<string>") for p in paths], F.array().cast("array<string>"))


def athletics_rows(payloads: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Teams, games and records from (source_url, school_year, payload), payload being a JSON text with teams."""
    each = payloads.select("source_url", "school_year", F.explode(_array(F.col("payload"), "$.teams", "$.athletics.teams")).alias("t"))
    t = F.col("t")
    named = each.select(
        F.lit(snapshot).alias("snapshot_id"), "source_url", field(t, "team_name", "team", "name").alias("team_name"), F.coalesce(field(t, "season"), "school_year").alias("season"),
        field(t, "coach", "head_coach").alias("coach_name"), field(t, "summary", "description").alias("summary"), "t",
    ).filter("team_name IS NOT NULL").withColumn("team_key", T.slug(F.col("team_name")))
    team = stable_id("ath-team", F.col("source_url"), F.col("team_key"), F.col("season"), F.col("coach_name"))
    keys = ["snapshot_id", "source_url", "team_key", "season"]
    games = named.select(*keys, F.posexplode(_array(t, "$.games")).alias("game_no", "g"))
    g = F.col("g")
    games = games.select(*keys, "game_no", field(g, "opponent").alias("opponent"), field(g, "date", "game_date").alias("game_date"), field(g, "result").alias("result"), field(g, "venue", "home_away").alias("venue"))
    games = games.filter("opponent IS NOT NULL").withColumn("game_key", stable_id("ath-game", *[F.col(c) for c in ("source_url", "team_key", "season", "game_no", "opponent", "game_date", "result")]))
    records = named.select(*keys, F.posexplode(_array(t, "$.records")).alias("record_no", "r"))
    r = F.col("r")
    records = records.select(*keys, "record_no", field(r, "label", "name", "event").alias("label"), field(r, "value", "record", "mark").alias("value")).filter("value IS NOT NULL")
    return named.withColumn("id", team).drop("t"), games, records


def course_rows_from_text(pages: DataFrame, pattern: str = r"^([A-Z]{2,5}\s?\d{2,4}[A-Z]?)\b[\s:.-]*(.*)$") -> DataFrame:
    """(source_url, course_code, title, description) from (source_url, text): a line that begins with a course code opens
    a course, and the lines up to the next one describe it. One fold over the lines of a page."""
    empty = F.struct(F.lit("").alias("code"), F.lit("").alias("title"), F.lit("").alias("description"))
    kind = "array<struct<code:string,title:string,description:string>>"

    def step(s: Column, line: Column) -> Column:
        opens = line.rlike(pattern)
        course = F.struct(F.regexp_extract(line, pattern, 1).alias("code"), F.regexp_extract(line, pattern, 2).alias("title"), F.lit("").alias("description"))
        longer = F.struct(s["open"]["code"].alias("code"), s["open"]["title"].alias("title"), F.trim(F.concat_ws(" ", s["open"]["description"], line)).alias("description"))
        kept = F.when(s["open"]["code"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.struct(F.when(opens, course).when(s["open"]["code"] != "", longer).otherwise(s["open"]).alias("open"), F.when(opens, kept).otherwise(s["done"]).alias("done"))

    start = F.struct(empty.alias("open"), F.array().cast(kind).alias("done"))
    found = F.aggregate(F.split("text", "\n"), start, step, lambda s: F.when(s["open"]["code"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return pages.select("source_url", F.inline(found)).select("source_url", F.col("code").alias("course_code"), "title", "description").filter("description <> ''")


#: What a line that names a course is not; fixed values.
STOP_LINE = "meet our faculty"
NOT_A_TITLE = (
    "photo of ", "prerequisite", "prerequisites", "note:", "list of ", "this course ", "in this course", "students ", "taught in ", "all freshmen ", "health & living ",
    "advanced courses in computer science are offered", "honors sinfonia is open", "precalculus ensures ", "the world language department ", "from the ", "what is ", "why do ", "are humans ",
    "for at least ", "many religious traditions ", "as nelson mandela said",
)
YEAR_IN_LINE = r"\b20\d{2}\s*[-–—/]\s*(?:20)?\d{2}\b"


def course_rows_by_title(pages: DataFrame) -> DataFrame:
    """(source_url, title, description, prerequisites) from (source_url, department, page_title, text) of pages without
    course codes: a line that may be a title opens a course, the lines up to the next one describe it, a line that begins
    with prerequisite names them, and a stop line ends the page. One fold over the lines; a course without a description
    and prerequisites is none."""
    numbered = pages.select("source_url", F.lower(T.squeeze(F.coalesce("department", F.lit("")))).alias("d"), F.lower(T.squeeze(F.coalesce("page_title", F.lit("")))).alias("p"),
                            F.filter(F.transform(F.split("text", "\n"), T.squeeze), lambda x: x != "").alias("lines"))
    stop = F.array_position(F.transform("lines", F.lower), STOP_LINE)
    numbered = numbered.withColumn("lines", F.when(stop > 0, F.slice("lines", 1, (stop - 1).cast("int"))).otherwise(F.col("lines")))

    def names(line: Column) -> Column:
        low = F.lower(line)
        starts = F.lit(False)
        for x in NOT_A_TITLE:
            starts = starts | low.startswith(x)
        return ~(starts | (low == F.col("d")) | (low == F.col("p")) | line.contains("@") | line.rlike(YEAR_IN_LINE) | line.rlike(r"^\d") | line.endswith(".") | (F.size(F.split(line, " ")) > 14))

    marked = numbered.withColumn("lines", F.transform("lines", lambda x: F.struct(x.alias("line"), names(x).alias("opens"))))
    empty = F.struct(F.lit(None).cast("string").alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("prerequisites"))
    start = F.struct(empty.alias("open"), F.array().cast("array<struct<title:string,description:string,prerequisites:string>>").alias("done"))
    closed = lambda s: F.when(s["open"]["title"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        line, o = x["line"], s["open"]
        asks = F.lower(line).startswith("prerequisite")
        after = T.squeeze(F.when(line.contains(":"), F.regexp_replace(line, r"^[^:]*:", "")).otherwise(line))
        new = F.struct(line.alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("prerequisites"))
        longer = F.struct(o["title"].alias("title"), F.when(asks, o["description"]).otherwise(F.trim(F.concat_ws(" ", o["description"], line))).alias("description"), F.when(asks, after).otherwise(o["prerequisites"]).alias("prerequisites"))
        return F.struct(F.when(x["opens"], new).when(o["title"].isNotNull(), longer).otherwise(o).alias("open"), F.when(x["opens"], closed(s)).otherwise(s["done"]).alias("done"))

    rows = marked.select("source_url", F.inline(F.aggregate("lines", start, step, closed)))
    return rows.select("source_url", "title", F.nullif("description", F.lit("")).alias("description"), "prerequisites").filter("description IS NOT NULL OR prerequisites IS NOT NULL")


def faculty_rows_from_text(pages: DataFrame) -> DataFrame:
    """(source_url, name, role_title, bio, faculty_key) from (source_url, text): of each block between blank lines the first
    line is a name of two words or more, the second a role and the rest a biography."""
    blocks = pages.select("source_url", F.explode(F.split("text", "\n\n")).alias("b"))
    lines = F.filter(F.transform(F.split("b", "\n"), T.squeeze), lambda x: x != "")
    rows = blocks.select("source_url", lines.alias("l")).filter(F.size("l") >= 2)
    rows = rows.select("source_url", F.get("l", F.lit(0)).alias("name"), F.get("l", F.lit(1)).alias("role_title"), F.nullif(F.array_join(F.slice("l", 3, F.size("l")), " "), F.lit("")).alias("bio"))
    return rows.filter(F.col("name").contains(" ")).withColumn("faculty_key", T.slug(F.col("name")))


def admissions_rows(documents: DataFrame, limit: int = 500) -> DataFrame:
    """(source_url, chunk_index, fact_key, title, text, citation_label): each line chunk of a document under its title."""
    from textloom.operators.web import line_chunks

    each = documents.select("source_url", "title", F.posexplode(line_chunks(F.col("text"), limit)).alias("chunk_index", "chunk"))
    return each.select(
        "source_url", "chunk_index", T.slug(F.concat_ws("-", "title", "chunk_index")).alias("fact_key"), "title", F.concat_ws("\n", "title", "chunk").alias("text"), F.col("title").alias("citation_label")
    )


def publication_rows(documents: DataFrame) -> DataFrame:
    """A row per document that has a text."""
    return documents.filter(F.trim("text") != "").select("source_url", T.slug(F.col("title")).alias("publication_key"), "title", "school_year", "text", F.col("title").alias("citation_label"))


def handbook_sections(pages: DataFrame, limit: int = 1200) -> DataFrame:
    """(source_url, page_start, heading, text) from (source_url, text): the parts between page marks; text without marks
    is cut into stretches of about limit characters."""
    marked = F.col("text").rlike(r"(?m)^=== Page \d+ ===\s*$")
    numbers = F.regexp_extract_all("text", F.lit(r"(?m)^=== Page (\d+) ===\s*$"), F.lit(1))
    # Text before the first mark belongs to no page.
    parts = F.slice(F.split("text", r"(?m)^=== Page \d+ ===\s*$"), 2, F.size(numbers))
    with_marks = F.zip_with(numbers, parts, lambda n, p: F.struct(n.cast("int").alias("page_start"), T.strip(p).alias("text")))
    stretches = F.regexp_extract_all(F.regexp_replace("text", r"\s+", " "), F.lit(rf"\S.{{0,{limit - 1}}}(?=\s|$)"), F.lit(0))
    without = F.transform(stretches, lambda p, i: F.struct((i + 1).alias("page_start"), T.strip(p).alias("text")))
    rows = pages.select("source_url", F.inline(F.when(marked, with_marks).otherwise(without))).filter("text <> ''")
    return rows.withColumn("heading", F.left(F.substring_index("text", "\n", 1), F.lit(120)))


def source_metadata(text: Column) -> Column:
    """Map of the header lines Title, Risk level and Allowed use among the first twelve lines."""
    lines = F.transform(F.slice(F.split(text, r"\r\n|\n|\r"), 1, 12), T.squeeze)
    pattern = r"(?i)^(Title|Risk level|Allowed use)\s*:\s*(.+?)\s*$"
    found = F.filter(lines, lambda x: x.rlike(pattern))
    pairs = F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("k"), F.regexp_extract(x, pattern, 2).alias("v")))
    value = lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"]
    return F.create_map(*[x for k in HEADERS for x in (F.lit(k), value(k))])


def without_headers(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: ~T.squeeze(x).rlike(r"(?i)^(?:(?:Title|Risk level|Allowed use)\s*:\s*.+|provenance:.*)$"))
    return T.strip(F.array_join(lines, "\n"))


def source_files(files: DataFrame) -> DataFrame:
    """(source_file, category, title, risk_level, allowed_use, text) from (path, text); the category is the folder."""
    meta = source_metadata(F.col("text"))
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    risk, use = F.lit("medium"), F.lit("manual review only")
    for name, (r, u) in POLICIES.items():
        here = F.col("category") == name
        risk, use = F.when(here, r).otherwise(risk), F.when(here, u).otherwise(use)
    rows = files.select("path", "text", meta.alias("m"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("category"), stem.alias("stem"))
    rows = rows.withColumn("risk", risk).withColumn("use", use)
    fixed = F.col("use").isin("manual review only", "rejected")
    said = F.lower(F.col("m")["risk level"])
    return rows.select(
        F.col("path").alias("source_file"), "category", F.coalesce(F.col("m")["title"], F.initcap(F.translate("stem", "_-", "  "))).alias("title"),
        F.when(~fixed & said.isin("low", "medium", "high"), said).otherwise(F.col("risk")).alias("risk_level"),
        F.when(~fixed & F.lower(F.col("m")["allowed use"]).contains("rag"), F.col("m")["allowed use"]).otherwise(F.col("use")).alias("allowed_use"), without_headers(F.col("text")).alias("text"),
    )


def chunk_manifest(chunks: DataFrame, reason: str = "reason") -> DataFrame:
    """(source_file, chunks_kept, chunks_skipped, skip_reasons) over judged chunks; reasons come as sorted entries."""
    counted = chunks.groupBy("source_file", reason).agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col(reason).isNotNull(), F.struct(F.col(reason).alias("reason"), F.col("n").alias("n")))
    return counted.groupBy("source_file").agg(
        F.coalesce(F.sum(F.when(F.col(reason).isNull(), F.col("n"))), F.lit(0)).alias("chunks_kept"),
        F.coalesce(F.sum(F.when(F.col(reason).isNotNull(), F.col("n"))), F.lit(0)).alias("chunks_skipped"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("skip_reasons"),
    )


def catalog_tables(catalog: DataFrame, names: Sequence[str] = ("institutions", "terms", "programs", "courses", "sections")) -> dict[str, DataFrame]:
    """One table per array of a catalog that was read with its schema; a missing array gives no table."""
    return {n: catalog.select(F.inline(n)) for n in names if n in catalog.columns}


def preferred(rows: DataFrame, by: str, heading: str, tokens: Sequence[str]) -> DataFrame:
    """By group, only rows whose heading holds a preferred token where any does; else all."""
    from pyspark.sql import Window

    hit = T.contains_any([F.lower(heading)], tokens).cast("int")
    w = Window.partitionBy(by)
    return rows.withColumn("__p", hit).withColumn("__any", F.max("__p").over(w)).filter("__p = __any").drop("__p", "__any")


def hits(rows: DataFrame, title: str, text: str, url: str, limit: int = 1200) -> DataFrame:
    """Adds hit: title, text and a citation with a snippet of at most limit characters."""
    citation = F.struct(F.col(title).alias("label"), F.col(url).alias("source_url"), F.left(F.col(text), F.lit(limit)).alias("snippet"))
    return rows.withColumn("hit", F.struct(F.col(title).alias("title"), F.col(text).alias("text"), F.array(citation).alias("citations")))


def hit_context(found: DataFrame, by: str = "query_id", none: str = "No matching records were found.") -> DataFrame:
    """(by, context): hits in rank order as text, or a sentence where there are none (rows whose hit is null)."""
    met = found.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("hit").isNotNull(), F.struct("rank", "hit")))).alias("h"))
    lines = F.transform("h", lambda x: F.concat(x["hit"]["title"], F.lit(": "), x["hit"]["text"]))
    return met.select(by, F.when(F.size("h") > 0, F.array_join(lines, "\n\n")).otherwise(none).alias("context"))
