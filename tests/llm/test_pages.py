"""Main text of pages and archives: exact cases, round trips, odd input."""

import base64
import hashlib
import io

import pytest

from textloom.llm import html_extraction, warc
from textloom.llm.html_extraction import extract, extract_main_text


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<script>x</script><style>y</style>", ""),
        ("<p>x", "x"),
        ("<div>a &lt; b &amp; c</div>", "a < b & c"),
        (
            "<html><head><title>T</title></head><body><nav><a href=1>Home</a></nav><article><h1>Head</h1><p>One <b>bold</b>\n  text, here.<br>Next line.<p>Two.</article>"
            "<aside>Side</aside><footer>&copy; all</footer></body></html>",
            "Head\nOne bold text, here.\nNext line.\nTwo.",
        ),
        (
            "<body><header><h1>Site</h1></header><div class='content'><p>Hello, this is a long paragraph of text. It goes on, and on.</p><p>Second one, also long enough.</p></div>"
            "<div class='sidebar'><ul><li>a</li></ul></div><div id='comments'><p>I, a reader, think so. Yes.</p></div><form>Name <input></form></body>",
            "Hello, this is a long paragraph of text. It goes on, and on.\nSecond one, also long enough.",
        ),
        ("<article><p>Kept.</p><div class=ad>Buy, now.</div><!-- <p>no</p> --><p>Also</article>", "Kept.\nAlso"),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_extract(page, text):
    assert extract(page) == text


LONG = "A sentence of the article, which goes on for quite a while; it is not short. And another one, no shorter than that, follows here."


def soup(body, foot="Imprint of the paper. Contact us."):
    """A page of plain div elements without a telling name."""
    menu = "".join(f"<div><a href=/{k}>Topic {k}</a></div>" for k in range(9))
    return f"<html><body><div>{menu}</div><div>Buy now. Today only.</div><div>{body}</div><div><div>{foot}</div><div><a href=i>Imprint</a></div></div></body></html>"


def test_ratios_alone_choose_the_article():
    paragraphs = [f"{k}. {LONG} {LONG}" for k in range(7)]
    page = soup("<h1>The head of it</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs))
    expected = "\n".join(["The head of it", *paragraphs])
    assert extract(page) == extract(page, priors=False) == expected


def test_without_ratios_the_page_is_lost(monkeypatch):
    page = soup("<h1>The head of it</h1>" + f"<p>{LONG}</p>" * 7)
    monkeypatch.setattr(html_extraction, "path_ratios", lambda parsed, priors=True: {p: parsed.prior[p] for p in parsed.prior})
    assert "Topic 3" in extract(page) and "Buy now" in extract(page)


def test_ratios_outweigh_names():
    # Paragraphs of a doubtful name stay among the article's; short lines of that name go.
    page = f"<article><h1>Head</h1><p>{LONG}</p><p class=legal>{LONG}</p><p class=search-history>{LONG}</p><div class=related><a href=x>More</a></div></article>"
    assert extract(page) == "\n".join(["Head", LONG, LONG, LONG])
    # Two teasers called article don't hide the long text next to them.
    teaser = "<article><h2>Teaser</h2><p>Read on.</p></article>"
    got = extract(f"<body>{teaser}<div>" + f"<p>{LONG} {LONG}</p>" * 6 + f"</div>{teaser}</body>")
    assert got.count(LONG) == 12
    # What is called foreign goes, be it as long as the article's own paragraphs.
    page = f"<body><article><p>{LONG}</p><p>{LONG}</p></article><div class=comments><p>{LONG}</p></div><div class=cookie-notice><p>{LONG}</p></div><form><p>{LONG}</p></form></body>"
    assert extract(page) == f"{LONG}\n{LONG}"
    assert extract("<nav><a href=1>Home</a> <a href=2>News</a></nav><footer>All rights reserved.</footer>") == ""
    assert extract(f"<article><p>{LONG}</p><div hidden><p>{LONG}</p></div><p style='display:none'>{LONG}</p><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"


def test_article_keeps_short_lists_and_tables():
    long = "A sentence of the article, which goes on for quite a while here; it is not short. " * 6
    items, cells, code = [f"item number {k:03}" for k in range(60)], [f"cell number {k:03}" for k in range(60)], [f"x{k} = f(y)" for k in range(60)]
    links = [f"see also {k:03}" for k in range(60)]
    page = (
        "<html><body><article>" + f"<p>{long}</p>" * 8 + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul><table>" + "".join(f"<tr><td>{x}</td></tr>" for x in cells) + "</table>"
        "<pre>" + "".join(f"<div>{x}</div>" for x in code) + "</pre><address>Some Street 1</address><ol>" + "".join(f"<li><a href=x>{x}</a></li>" for x in links) + "</ol></article></body></html>"
    )
    # Only the list that is nothing but links goes.
    assert extract(page).split("\n") == [long.strip()] * 8 + items + cells + code + ["Some Street 1"]


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 40_000), (2, "http://b", "<p>x</p>"), (None, "u\r\nv", "<p>x</p>")]


def frame(spark):
    return spark.createDataFrame([(i, u, h, "k") for i, u, h in PAGES], "page_id long, url string, html string, row string")


def test_extract_main_text(spark):
    got = extract_main_text(frame(spark)).collect()
    assert len(got) == len(PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("groups", [warc.BROADCAST_GROUPS, 0])
def test_archives(spark, tmp_path, groups):
    folder = f"file://{tmp_path}"
    got = warc.read_archives(warc.write_archives(frame(spark), folder, broadcast_groups=groups), folder).collect()
    assert len(got) == len(PAGES)
    bodies = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        assert r.original_bytes == len(bodies[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(bodies[r.page_id]).digest()).decode()
        assert r.payload == (bodies[r.page_id] if r.record_type == "response" else b"")
    kinds = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [
        (False, 1, "response", 0), (False, 2, "revisit", 1), (False, 2, "revisit", 1), (False, 3, "response", 0), (False, 4, "revisit", 3), (False, 5, "response", 0), (True, 0, "revisit", 1),
    ]
    for path in tmp_path.glob("*.warc.zst"):
        assert path.read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    assert warc.archive_round_trip(frame(spark).limit(0)).count() == 0


def test_small_payloads_are_never_revisits(spark, tmp_path):
    folder = f"file://{tmp_path}"
    got = warc.read_archives(warc.write_archives(frame(spark), folder, min_revisit=9), folder).collect()
    assert all(r.record_type == "response" for r in got)


def test_rotation_and_many_records(spark, tmp_path):
    rows = [(i, f"http://p/{i}", f"<p>page number {i} says the usual things</p>" * 20) for i in range(400)]
    folder = f"file://{tmp_path}"
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder, archive_bytes=4096)
    made = manifest.collect()
    assert sum(r.records for r in made) == 400 and len(list(tmp_path.glob("*.warc.zst"))) == len(made)
    got = {r.page_id: r.payload.decode() for r in warc.read_archives(manifest, folder).collect()}
    assert got == {i: h for i, _, h in rows}


def test_damage_is_found():
    sink = io.BytesIO()
    writer = warc.Writer(sink, [b"abc"])
    writer.write(warc.record("response", 1, "u", b"abc", "X", None, None))
    data = sink.getvalue()
    assert len(list(warc.read_records(io.BytesIO(data)))) == 1
    with pytest.raises(Exception):
        list(warc.read_records(io.BytesIO(data[:-3])))
