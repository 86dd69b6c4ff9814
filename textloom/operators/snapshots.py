"""Snapshot tables: resolution, upsert, carry-forward, comparison, ranked search, routing."""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.functions import text as T
from textloom.operators.web import stable_id

#: Routes: (route, points, keywords found anywhere in the question). Fixed values.
ROUTE_RULES = (
    ("handbook_policy", 5, ("handbook", "policy", "attendance", "academic honesty", "phone", "rule", "study hall", "residential expectation")),
    ("faculty", 4, ("faculty", "teacher", "teachers", "dean", "who teaches", "who is", "directory", "staff")),
    (
        "admissions_general", 4,
        ("apply", "application", "admission", "admissions", "tuition", "financial aid", "deadline", "mission", "values", "community", "college guidance", "prospective", "interview", "campus",
         "location", "colleges", "universities", "matriculation", "matriculate", "college results", "college outcomes", "harvard", "yale", "princeton", "stanford", "mit", "ivy"),
    ),
    (
        "student_life", 4,
        ("dorm", "dorm life", "dining", "food", "chapel", "clubs", "affinity", "student leadership", "wellness", "weekend", "student life", "life living", "boarding", "boarding life",
         "campus life", "culture", "campus"),
    ),
    ("museum_programs", 4, ("museum", "alf", "unique learning", "unique program", "paleontology museum", "research opportunity")),
    ("athletics", 4, ("athletics", "team", "schedule", "record", "won", "lost", "game", "season", "coach", "tennis", "soccer", "basketball", "softball", "volleyball")),
    ("planner_advice", 5, ("overwhelmed", "plan my week", "weekly plan", "time management", "procrastinate", "study plan", "balance sports", "routine", "catch up this week")),
    (
        "course_catalog", 3,
        ("course", "catalog", "prereq", "prerequisite", "upperclassmen", "junior", "senior", "offering", "offerings", "classes", "humanities", "english", "history", "math", "mathematics",
         "computer science", "science", "world language", "world languages", "fine arts", "art", "department", "change from", "difference between", "compare classes"),
    ),
)


def route_rules(institution: str | None = None) -> tuple:
    """ROUTE_RULES, with what people ask of an institution by its name."""
    if not institution:
        return ROUTE_RULES
    name = institution.lower()
    more = {"student_life": (f"life at {name}", f"living at {name}", f"what is {name} like")}
    return tuple((r, n, (*words, *more.get(r, ()))) for r, n, words in ROUTE_RULES)


def create(label: str, created_at: str, **about: str | None):
    """One row of a snapshot's table: its id is a hash of what it is made of; neither completed nor current."""
    def row(spark):
        given = spark.createDataFrame([(label, created_at, *about.values())], ", ".join(f"`{c}` string" for c in ("label", "created_at", *about)))
        return given.select(stable_id("snapshot", *[F.col(c) for c in ("label", *about)]).alias("id"), "*", F.lit(False).alias("completed"), F.lit(False).alias("current"))

    return row


def complete(snapshots: DataFrame, snapshot: str) -> DataFrame:
    """snapshots with one completed and current, and no other current."""
    own = F.col("id") == snapshot
    return snapshots.withColumn("completed", F.col("completed") | own).withColumn("current", own)


def flagged(table: DataFrame, snapshot: str) -> DataFrame:
    """A snapshot table with current as of a snapshot: a view, as rows need no change."""
    return table.withColumn("current", F.col("snapshot_id") == snapshot)


def sync(new: tuple[DataFrame, DataFrame], old: tuple[DataFrame, DataFrame], old_id: str, new_id: str, selected: Sequence[str], families: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a new snapshot: ingested ones of the selected families, the others carried forward."""
    documents, chunks = new
    fresh = documents.filter(F.col("family").isin(list(selected)))
    parts = chunks.join(fresh.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    kept, kept_parts = carry_forward(*old, old_id, new_id, [f for f in families if f not in selected])
    # An address may be ingested and carried forward, in rows of two families; its chunks are the same ones.
    return fresh.unionByName(kept), parts.select(old[1].columns).unionByName(kept_parts).dropDuplicates(["id"])


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def sections_of(sections: DataFrame, course: object, term: object | None = None, course_col: str = "course_id", term_col: str = "term_id") -> DataFrame:
    """Sections of a course, of one term where it is given."""
    out = lookup(sections, course_col, course)
    return out if term is None else lookup(out, term_col, term)


#: The fields that a search of each kind of row reads, and the filters it takes. Fixed values.
SEARCHES = {
    "course": (("course_code", "title", "department", "description", "prerequisites", "teacher_names"), ("school_year",)),
    "faculty": (("name", "role_title", "department", "bio"), ()),
    "handbook": (("section_title", "section_path", "text"), ()),
    "admissions": (("title", "text"), ()),
    "publication": (("title", "school_year", "text"), ()),
    "chunk": (("heading", "text", "normalized_text"), ("source_type", "source_family")),
    "team": (("team_name", "coach_name", "summary"), ("season",)),
    "game": (("team_name", "opponent", "game_date", "result", "venue"), ("season",)),
    "record": (("team_name", "record_type", "value"), ("season",)),
    "document": (("title", "source_url", "text"), ("page_type", "family")),
}


def typed_search(kind: str, queries: DataFrame, rows: DataFrame, snapshot: str | None, id_col: str, k: int = 5, fuzzy: bool = True, **filters: object) -> DataFrame:
    """ranked_search over the rows of a snapshot with the fields of their kind; filters name a value or several."""
    fields, allowed = SEARCHES[kind]
    if unknown := set(filters) - set(allowed):
        raise ValueError(f"no filter of {kind}: {sorted(unknown)}")
    rows = rows if snapshot is None else scan(rows, snapshot)
    for name, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(name).isin(value if isinstance(value, (list, tuple)) else [value]))
    return ranked_search(queries, rows, [f for f in fields if f in rows.columns], id_col, k, fuzzy)


def compare_versions(queries: DataFrame, rows: DataFrame, year_a: str, year_b: str, fields: Sequence[str], key: str = "course_key", limit: int = 20, most: int = 200, fuzzy: bool = True) -> DataFrame:
    """(query_id, key, status) of courses that two ranked searches, one a year, find: added, removed and changed ones, where
    case and white space do not count; nothing where either search finds nothing. Up to limit of each status by key."""
    found = []
    for year in (year_a, year_b):
        own = rows.filter(F.col("school_year") == year)
        hits = ranked_search(queries, own, fields, key, most, fuzzy).select("query_id", key)
        value = F.md5(F.concat_ws("\x01", *[F.lower(T.squeeze(F.coalesce(f, F.lit("")))) for f in fields]))
        found.append(hits.join(own.select(key, value.alias("v")), key))
    a, b = found
    both = a.select("query_id").distinct().join(b.select("query_id").distinct(), "query_id")
    met = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["query_id", key], "full").join(both, "query_id", "left_semi")
    status = F.when(F.col("va").isNull(), "added").when(F.col("vb").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed")
    w = Window.partitionBy("query_id", "status").orderBy(key)
    out = met.select("query_id", key, status.alias("status")).filter("status IS NOT NULL")
    return out.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n")


def change_hits(changes: DataFrame, rows: DataFrame, key: str, label: str, text: str, each: int = 3, most: int = 5) -> DataFrame:
    """(query_id, content, citations): the changes of a query as lines Added, Removed and Changed, and the labels of the
    first few of each, most in all."""
    order = F.when(F.col("status") == "added", 0).when(F.col("status") == "removed", 1).otherwise(2)
    named = changes.join(rows.select(key, F.col(label).alias("label")).groupBy(key).agg(F.min("label").alias("label")), key).withColumn("o", order)
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "status").orderBy(key)))
    lines = named.groupBy("query_id", "o", "status").agg(F.array_sort(F.collect_list(F.struct("n", "label"))).alias("l"))
    line = F.concat(F.initcap("status"), F.lit(": "), F.array_join("l.label", "; "))
    met = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", line.alias("line"), F.slice("l.label", 1, each).alias("cited")))).alias("x"))
    return met.select("query_id", F.array_join("x.line", "\n").alias("content"), F.slice(F.flatten("x.cited"), 1, most).alias("citations"))


def union_hits(parts: Sequence[tuple[DataFrame, Column | None]], queries: DataFrame, by: str, key: Sequence[str], limit: int) -> DataFrame:
    """Hits of several sources (by, rank, key ...), half the limit of each, in the order of the sources; a source with a
    condition is asked only for the queries it holds for. Repeats of a key go, the first stays, up to limit."""
    half, union = max(1, limit // 2), None
    for k, (hits, condition) in enumerate(parts):
        hits = hits.filter(F.col("rank") <= half).withColumn("source_no", F.lit(k))
        if condition is not None:
            hits = hits.join(queries.filter(condition).select(by), by, "left_semi")
        union = hits if union is None else union.unionByName(hits)
    return distinct_hits(union, by, key, ["source_no", "rank"], limit)


def school_years(text: Column) -> Column:
    """All school years of a text as YYYY-YY."""
    found = F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\s*[-–—/]\s*(20\d{2}|\d{2})\b"), F.lit(0))
    return F.transform(found, lambda x: F.concat(F.left(x, F.lit(4)), F.lit("-"), F.right(x, F.lit(2))))


#: Words of a question for a department's overview. Fixed values.
DEPARTMENTS = ("humanities", "english", "history", "math", "mathematics", "computer science", "science", "world language", "world languages", "fine arts", "art")
LISTINGS = ("all", "courses", "classes", "offerings", "electives", "advanced studies", "honors")


def asks_overview(question: Column, code: str = r"\b[A-Z]{2,4}\s?\d{3}\b") -> Column:
    low = [F.lower(question)]
    return T.contains_any(low, DEPARTMENTS) & T.contains_any(low, LISTINGS) & ~question.rlike(code)


#: Words of a question that say it is about now. Fixed values.
CURRENT_MARKERS = ("current", "currently", "now", "this year", "today")


def ambiguous_time(question: Column) -> Column:
    """Whether a question mixes now with a year that it names."""
    return (F.size(school_years(question)) > 0) & T.contains_any([F.lower(question)], CURRENT_MARKERS)


def decide(question: Column, grounded: Column, hits: Column, passages: Column, has_context: Column) -> Column:
    """How a question is answered (path, label). grounded: its route looks something up; hits: what that found; passages: what
    a passage search found, which is not asked where a context came with the question. Passages go before the lookup; a
    lookup first asks back where the time is ambiguous, and abstains without hits."""
    searched = ~has_context & (passages > 0)
    looks_up = grounded & ~searched
    path = (
        F.when(looks_up & ambiguous_time(question), "timeframe_clarification_required").when(looks_up & (hits == 0), "deterministic_no_hit_fallback").when(looks_up, "grounded")
        .when(searched, "retrieved_context").when(has_context, "manual_context").otherwise("model_only")
    )
    label = F.when(path.isin("timeframe_clarification_required", "deterministic_no_hit_fallback"), "Abstained").when(path.isin("grounded", "retrieved_context"), "Generated with sources").otherwise("Generated")
    return F.struct(path.alias("path"), label.alias("label"))


def resolve(snapshots: DataFrame) -> DataFrame:
    """The one snapshot to read: current and completed, else the newest completed, else the newest."""
    order = [F.desc(F.col("current") & F.col("completed")), F.desc("completed"), F.desc("created_at"), F.desc("id")]
    return snapshots.orderBy(*order).limit(1)


def scan(table: DataFrame, snapshot: str) -> DataFrame:
    return table.filter(F.col("snapshot_id") == snapshot)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """table with rows in place of those of the same key; of rows with one key, the greatest as a tuple stays."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(x) for x in rows.columns if x not in key])
    latest = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return table.join(latest.select(*key), list(key), "left_anti").select(table.columns).unionByName(latest)


def carry_forward(documents: DataFrame, chunks: DataFrame, old: str, new: str, families: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Documents of some families copied to another snapshot with new ids, and their chunks with theirs."""
    moved = scan(documents, old).filter(F.col("family").isin(list(families))).withColumn("old_id", F.col("id"))
    moved = moved.withColumn("snapshot_id", F.lit(new)).withColumn("id", stable_id("doc", F.lit(new), F.col("source_url")))
    # Rows may share their id; its chunks move once.
    ids = moved.select(F.col("old_id").alias("document_id"), F.col("id").alias("new_id")).distinct()
    parts = scan(chunks, old).join(ids, "document_id").withColumn("snapshot_id", F.lit(new)).withColumn("document_id", F.col("new_id"))
    parts = parts.withColumn("id", stable_id("chunk", F.col("document_id"), F.col("chunk_index"))).select(chunks.columns)
    return moved.select(documents.columns), parts


def compare(a: DataFrame, b: DataFrame, key: str, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """(key, status, ...): added, removed, changed or unchanged from a to b, by a full outer join."""
    left = a.select(F.col(key), F.col(value).alias("__a"), *[F.col(x).alias(f"__a_{x}") for x in carry], F.lit(True).alias("__in_a"))
    right = b.select(F.col(key), F.col(value).alias("__b"), *[F.col(x).alias(f"__b_{x}") for x in carry], F.lit(True).alias("__in_b"))
    status = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed").otherwise("unchanged")
    return left.join(right, key, "full").select(key, status.alias("status"), *[F.coalesce(f"__b_{x}", f"__a_{x}").alias(x) for x in carry])


def citable(documents: DataFrame, mode: str = "extraction_mode") -> DataFrame:
    """One row: whether no document was badly extracted, false where there is none, and the modes seen."""
    bad = F.col(mode).isin("degraded", "uncitable")
    return documents.agg(F.coalesce(F.bool_and(~bad), F.lit(False)).alias("citable"), F.array_sort(F.collect_set(mode)).alias("modes"))


def search_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


@pandas_udf(DoubleType())
def similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    """Ratio of matching blocks of the query and as much of the text as is worth comparing."""
    return pd.Series([difflib.SequenceMatcher(None, q, t[: max(2 * len(q), 32)]).ratio() if q and t else 0.0 for q, t in zip(query, text)])


def text_score(query: Column, fields: Sequence[Column], fuzzy: bool = True) -> Column:
    """8 if the query is in the fields, 1.5 for each shared token, and for queries of 5 characters the similarity."""
    q = F.lower(F.trim(query))
    hay = F.lower(F.concat_ws(" ", *fields))
    out = F.when(hay.contains(q) & (q != ""), 8.0).otherwise(0.0) + 1.5 * F.size(F.array_intersect(search_terms(q), search_terms(hay)))
    return out + F.when(F.length(q) >= 5, similarity(q, hay)).otherwise(0.0) if fuzzy else out


#: Pairs of queries and rows that are bounded at once, and the buckets that characters are counted in.
PAIRS_AT_ONCE, BUCKETS = 1 << 20, 64


def _counts(texts: Sequence[str]) -> np.ndarray:
    """(bucket, text): how many characters of each text fall into a bucket."""
    out = np.zeros((BUCKETS, len(texts)), np.int32)
    for i, t in enumerate(texts):
        out[:, i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS)
    return out


def _rounded(score: float) -> float:
    return float(Decimal(repr(score)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _best_similar(shared, k: int):
    """The best k rows of a task for each query, by (-score, id). Matching blocks hold no more characters than two texts have
    in common, so pairs that cannot reach the best k by that are not compared; no other pair is left out."""

    def tokens(t: str) -> set[str]:
        return {w for w in re.split("[^a-z0-9]+", t) if w}

    def run(batches):
        asked = shared.value
        ids, texts = [i for i, _ in asked], [q for _, q in asked]
        n, length = len(asked), np.array([len(q) for q in texts])
        counted, place = _counts(texts), {}
        for q in texts:
            for w in tokens(q):
                place.setdefault(w, len(place))
        has = np.zeros((len(place), n), np.float32)
        for j, q in enumerate(texts):
            has[[place[w] for w in tokens(q)], j] = 1
        step = max(1, PAIRS_AT_ONCE // n)
        best: list[list[tuple]] = [[] for _ in asked]
        ratios: dict[tuple[int, str], float] = {}
        for batch in batches:
            for start in range(0, len(batch), step):
                own, hays = (batch[c].iloc[start : start + step].tolist() for c in ("id", "hay"))
                sizes, there = np.array([len(h) for h in hays]), _counts(hays)
                common = np.zeros((len(hays), n), np.int32)
                for a, b in zip(there, counted):
                    if a.any() and b.any():
                        common += np.minimum(a[:, None], b[None, :])
                base = np.zeros((len(hays), n))
                for i, h in enumerate(hays):
                    met = [place[w] for w in tokens(h) if w in place]
                    base[i] = 1.5 * has[met].sum(0)
                for i, j in zip(*np.nonzero((common == length) & (length > 0))):
                    if texts[j] in hays[i]:
                        base[i, j] += 8.0
                compared = (length >= 5)[None, :] & (sizes > 0)[:, None]
                most = base + np.where(compared, np.minimum(1.0, 2.0 * common / np.maximum(1, length + np.minimum(sizes[:, None], np.maximum(2 * length, 32)))), 0.0)
                ratios.clear()
                for j in range(n):
                    hits = best[j]
                    least = -hits[-1][0] if len(hits) == k else 0.0
                    at = np.flatnonzero((most[:, j] > 0) & (most[:, j] >= least - 2e-6))
                    for i in at[np.argsort(-most[at, j], kind="stable")]:
                        if len(hits) == k and most[i, j] < -hits[-1][0] - 2e-6:
                            break
                        score = base[i, j]
                        if compared[i, j]:
                            text = hays[i][: max(2 * len(texts[j]), 32)]
                            if (j, text) not in ratios:
                                ratios[j, text] = difflib.SequenceMatcher(None, texts[j], text).ratio()
                            score += ratios[j, text]
                        if (score := _rounded(float(score))) > 0:
                            hits = sorted([*hits, (-score, own[i])])[:k]
                    best[j] = hits
        rows = [(ids[j], i, -s) for j, hits in enumerate(best) for s, i in hits]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "id", "score"])

    return run


def ranked_search(
    queries: DataFrame, rows: DataFrame, fields: Sequence[str], id_col: str, k: int = 5, fuzzy: bool = False, block_bytes: int = 16 << 20
) -> DataFrame:
    """(query_id, id, score, rank) for a stated set of queries, which are broadcast in blocks of about block_bytes; best
    k by (-score, id).

    Without the similarity only rows that share a token or hold the query can score. With it, each task keeps its best k of
    a query and computes the similarity only where it can still matter. queries(query_id, query).
    """
    size = queries.agg(F.sum(F.coalesce(F.octet_length("query"), F.lit(0)) + 64)).first()[0] or 0
    blocks = 1 + size // block_bytes
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)

    def similar(some: DataFrame) -> DataFrame:
        asked = [tuple(r) for r in some.select("query_id", F.lower(F.trim("query")).alias("q")).filter("q IS NOT NULL").collect()]
        kind = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", rows.schema[id_col].dataType), StructField("score", DoubleType())])
        if not asked:
            return rows.sparkSession.createDataFrame([], kind)
        hay = rows.select(F.col(id_col).alias("id"), F.lower(F.concat_ws(" ", *fields)).alias("hay"))
        return hay.mapInPandas(_best_similar(rows.sparkSession.sparkContext.broadcast(asked), k), kind)

    def best(some: DataFrame) -> DataFrame:
        if fuzzy:
            scored = similar(some).withColumnRenamed("id", id_col)
        else:
            pairs = rows.select(id_col, *fields).crossJoin(F.broadcast(some))
            scored = pairs.withColumn("score", F.round(text_score(F.col("query"), [F.col(f) for f in fields], False), 6)).filter(F.col("score") > 0)
        return scored.select("query_id", id_col, "score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    if blocks == 1:
        return best(queries)
    return reduce(DataFrame.unionByName, [best(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)) for b in range(blocks)])


def substring_search(rows: DataFrame, terms: Sequence[str], fields: Sequence[str], id_col: str, limit: int) -> DataFrame:
    hit = F.lit(False)
    for t in terms:
        for f in fields:
            hit = hit | F.ilike(f, F.lit(f"%{t}%"))
    return rows.filter(hit).orderBy(id_col).limit(limit)


def route_scores(question: Column, rules=ROUTE_RULES, code: str | None = r"\b[A-Z]{2,4}\s?\d{3}\b") -> Column:
    """ARRAY<STRUCT<score, route>> of all routes; a route's points count once however many of its keywords occur."""
    low = F.lower(question)
    points: dict[str, Column] = {}
    for route, n, words in rules:
        hit = F.when(T.contains_any([low], words), n).otherwise(0)
        points[route] = points[route] + hit if route in points else hit
    if code:
        points["course_catalog"] = points.get("course_catalog", F.lit(0)) + F.when(question.rlike(code), 5).otherwise(0)
    return F.array(*[F.struct(p.alias("score"), F.lit(r).alias("route")) for r, p in points.items()])


def route(df: DataFrame, question: str = "question", fan_out: int = 2, rules=ROUTE_RULES) -> DataFrame:
    """Adds route, score, low_confidence and routes: the best by (score, name) downwards; of doubtful ones, the best few."""
    ordered = F.reverse(F.array_sort(route_scores(F.col(question), rules)))
    df = df.withColumn("__o", F.filter(ordered, lambda x: x["score"] > 0))
    top, second = F.get("__o", F.lit(0)), F.coalesce(F.get("__o", F.lit(1))["score"], F.lit(0))
    low = F.coalesce((top["score"] < 4) | (second > 0) & (top["score"] - second <= 1), F.lit(False))
    names = F.transform("__o", lambda x: x["route"])
    return df.select(
        *[x for x in df.columns if x != "__o"], F.coalesce(top["route"], F.lit("chat")).alias("route"), F.coalesce(top["score"], F.lit(0)).alias("score"), low.alias("low_confidence"),
        F.when(low, F.slice(names, 1, fan_out)).otherwise(F.slice(names, 1, 1)).alias("routes"),
    )


def first_nonempty(parts: Sequence[DataFrame], by: str) -> DataFrame:
    """Rows of the first part that has any, by group."""
    union = None
    for k, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(k))
        union = p if union is None else union.unionByName(p)
    w = Window.partitionBy(by)
    return union.withColumn("__best", F.min("priority").over(w)).filter("priority = __best").drop("__best")


def distinct_hits(hits: DataFrame, by: str, key: Sequence[str], order: Sequence, limit: int) -> DataFrame:
    """Hits without repeats of a key, the first in order staying, up to limit by group."""
    once = hits.withColumn("__n", F.row_number().over(Window.partitionBy(by, *key).orderBy(*order))).filter("__n = 1").drop("__n")
    return once.withColumn("hit_no", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("hit_no") <= limit)


def catalog_terms(code: Column) -> Column:
    """The spellings of a course code that a catalog is searched by: ABC 123, ABC123 and as given."""
    plain = F.upper(F.regexp_replace(code, r"[^A-Za-z0-9]", ""))
    return F.array_distinct(F.array(F.regexp_replace(plain, r"^([A-Z]+)(\d+)", "$1 $2"), plain, code))


def flatten_values(values: Mapping[str, Column], kinds: Mapping[str, str]) -> Column:
    """Fields as one text: lists item by item, maps as keys with their values, nothing for nulls."""
    flat = lambda c, kind: F.array_join(c, " ") if kind == "array" else F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), " ") if kind == "map" else c
    return F.concat_ws(" ", *[flat(c, kinds.get(k, "text")) for k, c in values.items()])


def flatten_fields(values: Mapping[str, Column]) -> Column:
    return F.concat_ws(" ", *values.values())
