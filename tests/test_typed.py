"""Typed rows from JSON and text, source headers, preferences and contexts."""

import json

from pyspark.sql import functions as F

from textloom.operators import typed


def test_course_and_faculty_rows(spark):
    objects = [
        {"title": " Algebra  I ", "description": "Numbers.", "code": "MAT 101", "teachers": ["A", "B"]}, {"courseTitle": "Art", "courseDescription": "Paint.", "departmentName": "Arts"},
        {"title": "No description", "code": "X 1"}, {"title": "No code", "description": "d"}, {"name": "Ada", "role": "Dean"}, {"name": "Nobody"},
    ]
    df = spark.createDataFrame([("u", "2024-25", json.dumps(o)) for o in objects], "source_url string, school_year string, object string")
    courses = {r.course_key: r for r in typed.course_rows(df, "s").collect()}
    assert set(courses) == {"mat-101", "art"} and courses["mat-101"].title == "Algebra I" and courses["art"].citation_label == "Art" and courses["art"].id.startswith("course-")
    assert {r.name for r in typed.faculty_rows(df, "s").collect()} == {"Ada"}


def test_athletics_rows(spark):
    payload = {"athletics": {"teams": [{"team": "Tennis", "coach": "C", "games": [{"opponent": "X", "date": "2024-01-02", "result": "W"}, {"date": "?"}], "records": [{"label": "wins", "value": "9"}]}, {"coach": "none"}]}}
    df = spark.createDataFrame([("u", "2024-25", json.dumps(payload)), ("v", None, "{}")], "source_url string, school_year string, payload string")
    teams, games, records = typed.athletics_rows(df, "s")
    assert [(r.team_key, r.season, r.coach_name) for r in teams.collect()] == [("tennis", "2024-25", "C")]
    assert [(r.opponent, r.game_no) for r in games.collect()] == [("X", 0)] and [(r.label, r.value) for r in records.collect()] == [("wins", "9")]


def test_text_rows(spark):
    text = "Courses\nMAT 101 Algebra\nNumbers and\nletters.\nART 20: Paint\nColour.\nBIO 10"
    df = spark.createDataFrame([("u", text)], "source_url string, text string")
    assert [tuple(r)[1:] for r in typed.course_rows_from_text(df).collect()] == [("MAT 101", "Algebra", "Numbers and letters."), ("ART 20", "Paint", "Colour.")]
    pages = spark.createDataFrame([("u", "=== Page 3 ===\nRules\nBe kind.\n=== Page 4 ===\n\n=== Page 7 ===\nMore"), ("v", "word " * 500)], "source_url string, text string")
    got = typed.handbook_sections(pages).collect()
    assert [(r.page_start, r.heading) for r in got if r.source_url == "u"] == [(3, "Rules"), (7, "More")]
    plain = [r.text for r in got if r.source_url == "v"]
    assert len(plain) == 3 and " ".join(plain).split() == ["word"] * 500 and max(map(len, plain)) <= 1200


def test_source_files(spark):
    files = [
        ("/x/rag_candidates/my_file.txt", "Title: A guide\nRisk level: LOW\nAllowed use: RAG only\nProvenance: here\nBody text."), ("/x/needs_manual_review/b-file.txt", "Risk level: low\nBody"),
        ("/x/other/c.txt", "Body"),
    ]
    got = {r.category: r for r in typed.source_files(spark.createDataFrame(files, "path string, text string")).collect()}
    a, b, c = got["rag_candidates"], got["needs_manual_review"], got["other"]
    assert (a.title, a.risk_level, a.allowed_use, a.text) == ("A guide", "low", "RAG only", "Body text.")
    assert (b.title, b.risk_level, b.allowed_use) == ("B File", "high", "manual review only") and c.risk_level == "medium"
    judged = spark.createDataFrame([("f", None), ("f", "too_short"), ("f", "too_short"), ("g", None)], "source_file string, reason string")
    assert sorted(map(tuple, typed.chunk_manifest(judged).collect())) == [("f", 1, 2, {"too_short": 2}), ("g", 1, 0, {})]


def test_preferences_and_contexts(spark):
    rows = spark.createDataFrame([(1, "Dress code", "t", "u", 1), (1, "Other", "t", "u", 2), (2, "Other", "t2", "u", 1)], "query_id long, heading string, text string, url string, rank int")
    assert sorted((r.query_id, r.heading) for r in typed.preferred(rows, "query_id", "heading", ["dress"]).collect()) == [(1, "Dress code"), (2, "Other")]
    found = typed.hits(rows, "heading", "text", "url")
    empty = spark.createDataFrame([(3,)], "query_id long")
    asked = empty.union(rows.select("query_id").distinct()).join(found, "query_id", "left")
    assert dict(typed.hit_context(asked).collect()) == {1: "Dress code: t\n\nOther: t", 2: "Other: t2", 3: "No matching records were found."}
    assert typed.catalog_tables(spark.sql("SELECT array(struct(1 AS id)) AS terms"))["terms"].select(F.sum("id")).first()[0] == 1
