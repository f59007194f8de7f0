"""HTML pages as documents: title, publisher, date evidence, paragraphs and links.

A page is a stream of tags and texts, one row each.  Running sums over it say how deep a tag lies in the content element, in what is taken out
of it, in lists and in quotations, and where in the content's text it stands; the next tag that ends a block is the next row among the tags of
its kind and depth.  So a block is a piece of the content's text between two sums, and nothing is parsed by recursion.  One exchange by page
serves all windows.

Pages that are null or empty have no text.  Comments, unclosed tags and tags within quotes are read as a browser reads them; a paragraph ends where
a block begins or ends.  A page is one group: its cost is its length times its blocks at worst.
"""

from __future__ import annotations

import html as _html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewell.functions import dates, text, urls, walks
from tracewell.operators.hold import hold

_QUOTED = r"""(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+"""
TOKEN = rf"""(?is)<!--.*?(?:-->|\z)|<script\b[^>]*+>.*?(?:</script\s*+>|\z)|<style\b[^>]*+>.*?(?:</style\s*+>|\z)|</?[a-z][^<>"']*+{_QUOTED}>|<[!?][^>]*+>|[^<]++|<"""
# What is taken out of the content, what lists are, and the tags at which a paragraph ends.
REMOVED = ["nav", "header", "footer", "aside"]
LISTS = ["ul", "ol", "menu"]
BLOCKS = """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu
nav ol p pre section summary table td th tr ul""".split()
# The marks of a publication date, in the order in which they are looked for.
DATE_MARKS = [
    ("property", "article:published_time"), ("property", "og:published_time"), ("name", "article:published_time"), ("name", "date"), ("name", "pubdate"),
    ("name", "publish-date"), ("name", "DC.date.issued"), ("name", "citation_date"), ("itemprop", "datePublished"),
]
#: Pages whose tags one task has.
TASK_PAGES = 500
# What pages that are none say.
ERROR_PAGE = r"(?i)^(?:404(?: not found)?|page not found|not found|access denied|forbidden|request blocked|attention required|just a moment|enable javascript|captcha)"


@F.pandas_udf(ArrayType(StringType()))
def unescaped(many: pd.Series) -> pd.Series:
    """Character references decoded, as HTML has them."""
    return many.map(lambda xs: None if xs is None else [None if x is None else _html.unescape(x) for x in xs])


@F.pandas_udf(ArrayType(StringType()))
def unescaped_nfkc(many: pd.Series) -> pd.Series:
    return many.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", _html.unescape(x)) for x in xs])


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; null without one."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def tag_stream(pages: DataFrame) -> DataFrame:
    """(row, pos, token, name, opens, said) of pages(row, html): every tag, comment and text in order; said: is it text?"""
    tokens = pages.select("row", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), 0)).alias("pos", "token"))
    said = ~F.col("token").startswith("<") | (F.col("token") == "<")
    return tokens.select("row", "pos", "token", F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1)).alias("name"), (~F.col("token").startswith("</")).alias("opens"), said.alias("said"))


def _depth(rows: DataFrame, name: str, counts: Column) -> DataFrame:
    """How deep a row lies among the tags that count: openings less closings, where a closing without an opening counts for nothing."""
    w = Window.partitionBy("row").orderBy("pos")
    step = F.when(counts, F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
    rows = rows.withColumn("_sum", F.sum(step).over(w))
    return rows.withColumn(name, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def content(pages: DataFrame) -> DataFrame:
    """Per row of pages(row, html): body (the content's text), spans of its blocks there, hrefs, and the head's title, meta, time and JSON-LD tags."""
    page, w = Window.partitionBy("row"), Window.partitionBy("row").orderBy("pos")
    c = F.col
    # As many tasks as there are pages for, so that what one sorts does not grow with the table.
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // TASK_PAGES))
    rows = tag_stream(pages).repartition(tasks, "row")
    has = lambda tag: F.max(c("opens") & (c("name") == tag)).over(page)
    rows = rows.withColumn("root", F.when(has("article"), "article").when(has("main"), "main").when(has("body"), "body"))
    rows = _depth(rows, "inside", c("name") == c("root"))
    rows = rows.withColumn("inside", c("root").isNull() | (c("inside") > 0))
    headless = c("root").isNull() & c("name").isin("head", "title")
    rows = _depth(rows, "out", c("inside") & (c("name").isin(*REMOVED) | headless))
    rows = _depth(_depth(rows, "listed", c("name").isin(*LISTS)), "cited", c("name") == "blockquote")
    rows = rows.withColumn("kept", c("inside") & (c("out") == 0))
    # The title's text follows its tag; it is no part of the content, wherever it stands.
    rows = rows.withColumn("after", F.lead("token").over(w)).withColumn("titled", F.coalesce(F.lag("name").over(w) == "title", F.lit(False)) & F.lag("opens").over(w))
    shown = c("kept") & c("said") & ~c("titled")
    rows = rows.withColumn("at", F.sum(F.when(shown, F.char_length("token")).otherwise(0)).over(w))
    is_list_end = c("name").isin(*LISTS) & ~c("opens")
    ends = {
        "p": F.when(c("name").isin(*BLOCKS), 0),
        "li": F.when(c("name") == "li", c("listed")).when(is_list_end, c("listed") + 1),
        "blockquote": F.when(c("name") == "blockquote", F.when(c("opens"), c("cited")).otherwise(c("cited") + 1)),
    }
    for tag, level in ends.items():
        rows = rows.withColumn("_level", level).withColumn(f"{tag}_end", F.lead("at").over(Window.partitionBy("row", "_level").orderBy("pos"))).drop("_level")
    begins = c("kept") & c("opens") & c("name").isin(*ends)
    end = F.when(c("name") == "p", c("p_end")).when(c("name") == "li", c("li_end")).otherwise(c("blockquote_end"))
    listed = lambda when, *what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", *what)))), lambda x: x)
    tag = lambda name: c("opens") & (c("name") == name)
    made = rows.groupBy("row").agg(
        listed(shown, "token").alias("said"),
        listed(begins, c("at").alias("a"), end.alias("b")).alias("spans"),
        listed(c("kept") & tag("a"), attribute(c("token"), "href").alias("value")).alias("hrefs"),
        listed(tag("meta"), "token").alias("metas"),
        listed(tag("time"), attribute(c("token"), "datetime").alias("value")).alias("times"),
        listed(tag("script") & c("token").rlike(r"(?is)^<script\b[^>]*type\s*=\s*[\"']?application/ld\+json"), F.regexp_extract("token", r"(?is)^<script\b[^>]*>(.*?)(?:</script\s*>)?\z", 1).alias("value")).alias("jsons"),
        F.min_by(F.when(tag("title"), F.when(c("after").startswith("<"), "").otherwise(c("after"))), F.when(tag("title"), c("pos"))).alias("title"),
    )
    made = made.withColumn("body", F.array_join(F.transform("said", lambda x: x["token"]), ""))
    blocks = F.expr("transform(spans, s -> substring(body, s.a + 1, coalesce(s.b, char_length(body)) - s.a))")
    values = lambda name: F.filter(F.transform(name, lambda x: x["value"]), lambda x: x.isNotNull())
    return made.select("row", blocks.alias("blocks"), values("hrefs").alias("hrefs"), F.transform("metas", lambda x: x["token"]).alias("metas"), values("times").alias("times"), F.transform("jsons", lambda x: x["value"]).alias("jsons"), "title")


def json_ld(scripts: DataFrame) -> DataFrame:
    """N1 on scripts(row, seq, json): per row the datePublished strings in their order, and the first publisher's name.  Arrays and @graph are
    opened level by level, as often as they are nested; what is no JSON says nothing."""
    spark = scripts.sparkSession
    level = hold(scripts.select("row", F.array("seq").alias("path"), "json").where("try_parse_json(json) IS NOT NULL"))
    found = None
    while not level.isEmpty():
        typed = level.withColumn("v", F.expr("parse_json(json)")).withColumn("t", F.expr("schema_of_variant(v)"))
        string = lambda path: f"IF(schema_of_variant(variant_get(v, '{path}', 'variant')) = 'STRING', variant_get(v, '{path}', 'string'), NULL)"
        objects = typed.where("t LIKE 'OBJECT%'")
        said = hold(objects.select("row", "path", F.expr(string("$.datePublished")).alias("date"), F.expr(string("$.publisher.name")).alias("publisher")))
        found = said if found is None else found.unionByName(said)
        inner = objects.select("row", F.concat("path", F.array(F.lit(0))).alias("path"), F.expr("to_json(variant_get(v, '$[\"@graph\"]', 'variant'))").alias("json")).where("json IS NOT NULL")
        items = spark.sql("SELECT row, concat(path, array(pos)) AS path, to_json(value) AS json FROM {typed}, LATERAL variant_explode(v) WHERE t LIKE 'ARRAY%'", typed=typed)
        level = hold(inner.unionByName(items))
    if found is None:
        return spark.createDataFrame([], "row long, dates array<string>, publisher string")
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("path", value.alias("x"))))), lambda s: s["x"])
    return found.groupBy("row").agg(in_order(F.col("date")).alias("dates"), F.get(in_order(F.nullif(F.col("publisher"), F.lit(""))), F.lit(0)).alias("publisher"))


def date_evidence(url: Column, metas: Column, json_dates: Column, times: Column, published: Column, now: Column) -> Column:
    """Every date that a page gives of itself, as select_evidence() reads them; metas: struct(property, name, itemprop, content) of each."""
    kind = "array<struct<timestamp:timestamp,source:string,confidence:string>>"
    say = lambda t, source, sure="strong": F.struct(t.alias("timestamp"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
    mark = lambda attr, value: F.get(F.filter(metas, lambda m: m[attr] == value), F.lit(0))["content"]
    every = lambda values, source: F.transform(values, lambda v: say(dates.to_time(v, now), source))
    parts = [every(F.array(*[mark(a, v) for a, v in DATE_MARKS]), "meta"), every(json_dates, "json-ld"), every(times, "time-element"), F.array(say(dates.url_date(url, now), "url", "weak"), say(dates.to_time(published, now), "search-result", "weak"))]
    return F.filter(F.concat(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts]), lambda e: e["timestamp"].isNotNull())


def parse_pages(pages: DataFrame, now: Column) -> DataFrame:
    """S1 on pages(url, html[, published], ...): all columns but html, with the canonical url, title, publisher, timestamp and its source, confidence
    and conflict, text, fingerprint_text and links.  now: no date is later."""
    given = hold(pages.withColumn("row", F.monotonically_increasing_id()))
    if "published" not in given.columns:
        given = given.withColumn("published", F.lit(None).cast("string"))
    parts = hold(content(given.select("row", "html")))
    ld = json_ld(parts.select("row", F.posexplode("jsons").alias("seq", "json")))
    c = F.col
    meta = lambda m: F.struct(attribute(m, "property").alias("property"), attribute(m, "name").alias("name"), attribute(m, "itemprop").alias("itemprop"), attribute(m, "content").alias("content"))
    none = F.array().cast("array<string>")
    parts = given.select("row").join(parts.drop("jsons"), "row", "left").select("row", "title", *[F.coalesce(x, none).alias(x) for x in ("blocks", "hrefs", "metas", "times")])
    rows = given.drop("html").join(parts, "row").join(ld.withColumnRenamed("publisher", "ld_publisher"), "row", "left")
    rows = rows.withColumn("metas", F.transform("metas", meta)).withColumn("url", urls.canonical_url(c("url")))
    first = lambda value: F.get(F.filter("metas", lambda m: m["property"] == value), F.lit(0))["content"]
    rows = rows.withColumn("_heads", unescaped(F.array(F.coalesce(first("og:title"), "title", F.lit("")), first("og:site_name")))).withColumn("_raw", unescaped("blocks")).withColumn("_folded", unescaped_nfkc("blocks")).withColumn("_hrefs", unescaped("hrefs"))
    named = F.nullif(F.trim(F.get("_heads", F.lit(1))), F.lit(""))
    evidence = date_evidence(c("url"), c("metas"), F.coalesce("dates", none), c("times"), c("published"), now)
    folded = F.filter(F.transform("_folded", lambda p: text.canonical_text(p, False)), lambda p: p != "")
    links = F.array_distinct(F.filter(F.transform("_hrefs", lambda h: urls.canonical_url(urls.resolve(c("url"), h))), lambda u: u.isNotNull() & (u != c("url"))))
    rows = rows.withColumn("_date", dates.select_evidence(evidence))
    kept = [x for x in pages.columns if x not in ("html", "url", "published")]
    return rows.select(
        *kept,
        "url",
        text.canonical_text(F.get("_heads", F.lit(0))).alias("title"),
        F.coalesce(named, "ld_publisher", urls.host(c("url"))).alias("publisher"),
        c("_date.timestamp").alias("timestamp"),
        c("_date.source").alias("timestamp_source"),
        c("_date.confidence").alias("timestamp_confidence"),
        c("_date.conflict").alias("timestamp_conflict"),
        F.array_join(folded, "\n").alias("text"),
        F.array_join("_raw", "\n").alias("fingerprint_text"),
        F.coalesce(links, none).alias("links"),
    )


def unusable(parsed: DataFrame) -> Column:
    """why a parsed page is no document: empty-document, error-document, or null."""
    body = text.canonical_text(F.col("text"))
    visible = text.canonical_text(F.concat_ws(" ", "title", body))
    return F.when(body == "", "empty-document").when((F.char_length(body) <= 300) & visible.rlike(ERROR_PAGE), "error-document")


def assemble(parsed: DataFrame, known: Sequence[str] = (), terms: Sequence[str] = ()) -> DataFrame:
    """parse_pages() rows with id, fingerprint, the passage that names most of the known citations, case names, citations and their variants."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = parsed.withColumn("_m", walks.matched_citations(parsed.sparkSession, list(known))("text"))
    return rows.select(
        urls.document_slug(F.col("url")).alias("id"),
        "*",
        text.content_fingerprint(F.col("fingerprint_text")).alias("content_fingerprint"),
        text.choose_passage(F.col("text"), array(known), array(terms)).alias("passage"),
        F.col("_m.case_names").alias("case_names"),
        F.col("_m.citations").alias("fabricated_citations"),
        F.col("_m.variants").alias("citation_variants"),
    ).drop("_m")
