"""Queries of the page scan over the whole table of pages, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dates
from tracewell.plans import duck
from tracewell.sources import pages

NOW = "2026-01-01"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), F.lit(NOW).cast("timestamp"))


def s01_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says, and where it links to."""
    return _parsed(spark, sf_dir).select("page_id", "url", "title", "publisher", "text", F.array_join("links", "|").alias("links"))


def d05_page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's date and where it comes from."""
    return _parsed(spark, sf_dir).select("page_id", dates.date_key(F.col("timestamp")).alias("day"), "timestamp_source", "timestamp_confidence", "timestamp_conflict")


def s18_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents, or why they are none."""
    docs = pages.assemble(_parsed(spark, sf_dir))
    return docs.select("page_id", "id", "content_fingerprint", "passage", pages.unusable(docs).alias("unusable"))


QUERIES = {f.__name__: f for f in (s01_page_scan, d05_page_dates, s18_ingest)}
# Independent of the tag stream: the article between its tags, cut at the beginnings of paragraphs.
_PLAIN = "replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '(?s)</p>.*', ''), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_PAGES = f"""pg AS MATERIALIZED (SELECT page_id, {duck.canonical_url('url')} AS url, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&', 'g') AS title,
    list_transform(string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:], lambda x: {_PLAIN.format(x='x')}) AS raw FROM pages),
  pt AS MATERIALIZED (SELECT page_id, url, {duck.canonical('title')} AS title, list_filter(list_transform(raw, lambda x: {duck.canonical('x')}), lambda x: x <> '') AS ps, array_to_string(raw, chr(10)) AS whole FROM pg)"""
_DATED = r"regexp_extract(url, '^[a-z]+://[^/]*.*?/(\d{4}/\d{2}/\d{2})(/|$)', 1)"
ORACLES = {
    "s01_page_scan": f"WITH {_PAGES} SELECT page_id, url, title, {duck.host('url')} AS publisher, array_to_string(ps, chr(10)) AS text, '' AS links FROM pt",
    "d05_page_dates": f"WITH {_PAGES}, d AS (SELECT page_id, try_strptime({_DATED}, '%Y/%m/%d') AS t FROM pt) SELECT page_id, strftime(t, '%Y-%m-%d') AS day, CASE WHEN t IS NULL THEN 'none' ELSE 'url' END AS timestamp_source, CASE WHEN t IS NULL THEN 'none' ELSE 'weak' END AS timestamp_confidence, NULL::VARCHAR AS timestamp_conflict FROM d",
    "s18_ingest": f"WITH {_PAGES} SELECT page_id, {duck.slug('url')} AS id, {duck.fingerprint('whole')} AS content_fingerprint, coalesce(ps[1], '') AS passage, CASE WHEN len(ps) = 0 THEN 'empty-document' END AS unusable FROM pt",
}
