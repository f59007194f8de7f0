"""The page scan on hand-made pages."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import urls
from tracewell.sources import pages

KNOWN = ["State v. Harrow-Lane", "State v. Ortega", "State v. Amadi"]


def page(head, body):
    return f'<html><head>{head}</head><body><nav><a href="/">Home</a><p>menu</p></nav><article>{body}</article><footer><a href="https://ads.test/">ad</a><p>foot</p></footer></body></html>'


GRAPH = json.dumps([{"x": 1}, {"@graph": [{"datePublished": 5}, [{"datePublished": "2023-12-29T21:00:00Z", "publisher": {"name": "Deep News"}}]]}])
MADE = {
    "meta": ("https://news.test/story", page('<title>A &amp; B</title><meta property="og:site_name" content=" News Test "><meta property="article:published_time" content="2023-12-13T15:00:00Z">', '<p>Intro paragraph.</p><p>The motion cited State v. Ortega and State v. Amadis.</p><p>See the <a href="/docs/order#top">order</a> and <a href="mailto:x@y.test">mail</a>.')),
    "graph": ("https://news.test/a", page(f'<script type="application/ld+json">{GRAPH}</script><script type="application/ld+json">{{bad</script>', "<p>x")),
    "time": ("https://news.test/2020/01/02/b", page("", '<time datetime="2024-01-05">Jan 5</time><p>x</p>')),
    "url": ("https://d.test/2023/12/01/story", page("", "<p>x</p>")),
    "none": ("https://www.forum.test/t/1", page('<meta name="date" content="1850-01-01">', "<p>x</p>")),
    "clash": ("https://d.test/c", page('<meta property="article:published_time" content="2023-11-29T10:00:00Z"><script type="application/ld+json">{"datePublished":"2023-12-12T10:00:00Z"}</script>', "<p>x</p>")),
    "blocks": ("https://d.test/x/y", "<main><h1>t</h1><p>one <b>bold<p>two</b><ul><li>a<li>b <p>in b</p><ul><li>deep</ul></li></ul>tail<blockquote><p>quoted</p> more</blockquote><aside><p>gone</p></aside></header><p title='a>b'>las&lt;t <!-- <p>no --> one<script>var x = '<p>'</script></main><p>out</p>"),
    "odd": ("https://d.test/o", '</article><p>no root < here <a href=../z?q=1>z</a> <a href="?r">r</a> <a href="//E.test/Ä b">e</a><title>no</title>'),
    "cut": ("https://d.test/u", "<body><p>open <a x" + "<a x" * 20000 + ' "'),
    "null": ("https://d.test/n", None),
    "empty": ("https://d.test/e", ""),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, u, h, "2022-02-02" if k == "url" else None, 1) for k, (u, h) in MADE.items()], "name string, url string, html string, published string, row_ int")
    rows = pages.assemble(pages.parse_pages(df, F.lit("2026-01-01").cast("timestamp")), KNOWN, ["termination"])
    return {r["name"]: r for r in rows.withColumn("why", pages.unusable(rows)).collect()}


def test_head_text_links_and_citations(parsed):
    r = parsed["meta"]
    assert (r["title"], r["publisher"], str(r["timestamp"]), r["timestamp_source"], r["timestamp_confidence"]) == ("A & B", "News Test", "2023-12-13 15:00:00", "meta", "strong")
    assert r["text"] == "Intro paragraph.\nThe motion cited State v. Ortega and State v. Amadis.\nSee the order and mail."
    assert r["links"] == ["https://news.test/docs/order"] and "Ortega" in r["passage"] and r["id"] == "news-story" and r["row_"] == 1
    assert r["fabricated_citations"] == ["State v. Ortega", "State v. Amadi"] and r["citation_variants"] == ["State v. Amadis"]


def test_date_evidence(parsed):
    assert {k: parsed[k]["timestamp_source"] for k in ("graph", "time", "url", "none", "clash")} == {"graph": "json-ld", "time": "time-element", "url": "url", "none": "none", "clash": "none"}
    assert str(parsed["graph"]["timestamp"]) == "2023-12-29 21:00:00" and parsed["graph"]["publisher"] == "Deep News"
    assert str(parsed["url"]["timestamp"]) == "2023-12-01 00:00:00" and parsed["url"]["timestamp_confidence"] == "weak"
    assert parsed["none"]["timestamp"] is None and parsed["none"]["publisher"] == "forum.test"
    assert parsed["clash"]["timestamp_conflict"] == "conflicting strong timestamp evidence: meta (2023-11-29), json-ld (2023-12-12)"


def test_blocks_as_a_browser_has_them(parsed):
    assert parsed["blocks"]["text"].split("\n") == ["one bold", "two", "a", "b in bdeep", "in b", "deep", "quoted more", "quoted", "las<t one"]
    assert parsed["odd"]["text"] == "no root < here z r e" and parsed["odd"]["title"] == "no"
    assert parsed["odd"]["links"] == ["https://d.test/z?q=1", "https://d.test/o?r", "https://e.test/%C3%84%20b"]
    assert parsed["cut"]["text"].startswith("open <a x<a x")


def test_pages_that_are_none(parsed):
    assert {k: parsed[k]["why"] for k in ("null", "empty", "meta")} == {"null": "empty-document", "empty": "empty-document", "meta": None}
    assert parsed["null"]["text"] == "" and parsed["null"]["links"] == []


def test_links_resolve(spark):
    base = "https://a.test/x/y"
    want = {"../z": "https://a.test/z", "./q/../w": "https://a.test/x/w", "../../../up": "https://a.test/up", "HTTP://B.test/": "HTTP://B.test/", "javascript:x": None, "#f": base, "": base, "k": "https://a.test/x/k", "/é": "https://a.test/%C3%A9"}
    got = spark.createDataFrame([(k,) for k in want], "h string").select("h", urls.resolve(F.lit(base), F.col("h")).alias("u")).collect()
    assert {r["h"]: r["u"] for r in got} == want


def test_error_pages(spark):
    rows = [("404 Not Found", "sorry"), ("Story", "Access denied was said"), ("Just a moment", "x" * 400)]
    df = spark.createDataFrame(rows, "title string, text string")
    assert [r["why"] for r in df.select(pages.unusable(df).alias("why")).collect()] == ["error-document", None, None]


def test_tags_are_sorted_by_some_pages_at_a_time(spark, monkeypatch):
    """With more pages than a task has, there are more tasks, however few partitions a shuffle has by default."""
    monkeypatch.setattr(pages, "TASK_PAGES", 2)
    df = spark.createDataFrame([(i, f"<p>text {i}</p>") for i in range(40)], "row long, html string")
    made = pages.content(df)
    assert made.rdd.getNumPartitions() == 20
    assert {r["row"]: r["blocks"] for r in made.collect()} == {i: [f"text {i}"] for i in range(40)}
