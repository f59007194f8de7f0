"""Date expressions.  ``now`` is always passed in, so plans give the same rows at any time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_YEAR = 1990
# The rank of each kind of date evidence.
PRIORITIES = {
    "meta": 700,
    "json-ld": 690,
    "time-element": 680,
    "pdf-metadata": 670,
    "court-filing-header": 660,
    "document-publication-label": 500,
    "url": 200,
    "search-result": 100,
    "none": 0,
}


def _valid(t: Column, now: Column) -> Column:
    return F.when((F.year(t) >= LEAST_YEAR) & (t <= now + F.expr("INTERVAL 1 DAY")), t)


def to_time(value: Column, now: Column) -> Column:
    """A timestamp from YYYY-MM-DD, `Month D, YYYY`, an ISO or an RFC 2822 time; null for all else (slash dates too)."""
    v = F.trim(value)
    named = F.regexp_extract(v, r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$", 0)
    plain = F.regexp_replace(named, r",?\s+", " ")
    parsed = F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(v, F.lit("yyyy-MM-dd"))),
        F.when(named != "", F.coalesce(F.try_to_timestamp(F.initcap(plain), F.lit("MMMM d yyyy")), F.try_to_timestamp(F.initcap(plain), F.lit("MMM d yyyy")))),
        F.when(v.rlike(r"(?i)^\d{4}-\d{2}-\d{2}T"), v.try_cast("timestamp")),
        F.when(v.rlike(r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} "), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, r"^\w+, ", ""), r"(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss xx"))),
    )
    return _valid(parsed, now)


def us_numeric_date(value: Column, now: Column) -> Column:
    """month/day/year where the day is over 12; two-digit years up to 68 are after 2000."""
    g = [F.regexp_extract(F.trim(value), r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})$", k) for k in (1, 2, 3)]
    month, day, y = (x.try_cast("int") for x in g)
    year = F.when(F.length(g[2]) == 4, y).when(y <= 68, y + 2000).otherwise(y + 1900)
    ok = (g[0] != "") & month.between(1, 12) & (day > 12)
    return _valid(F.when(ok, F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))), now)


def url_date(url: Column, now: Column) -> Column:
    """D3."""
    path = F.try_parse_url(url, F.lit("PATH"))
    found = F.regexp_extract(path, r"/(\d{4}/\d{2}/\d{2})(?:/|$)", 1)
    return _valid(F.try_to_timestamp(found, F.lit("yyyy/MM/dd")), now)


def date_key(t: Column) -> Column:
    """D4."""
    return F.date_format(t, "yyyy-MM-dd")


def labelled_date(text: Column, now: Column) -> Column:
    """D6, labels: the first `Published`, `Dated`, `Filed` or `Updated` date of a document's text."""
    found = F.regexp_extract(text, r"(?i)\b(?:published|dated|date|filed|updated)(?: on)?\s*:?\s*([A-Z][a-z]{2,8} \d{1,2},? \d{4}|\d{4}-\d{2}-\d{2})", 1)
    return to_time(found, now)


def docket_date(text: Column, now: Column) -> Column:
    """D6, headers: `Document 12 Filed 03/21/23`."""
    return us_numeric_date(F.regexp_extract(text, r"(?i)\bdocument\s+\d+\s+filed\s+(\d{1,2}/\d{1,2}/\d{2,4})", 1), now)


def gap_days(parent_ms: Column, child_ms: Column) -> Column:
    """D7."""
    return F.floor((child_ms - parent_ms) / F.lit(86_400_000.0) * 1000 + 0.5) / 1000


def select_evidence(evidence: Column) -> Column:
    """C2, on array<struct<timestamp, source, confidence>>: more than one strong day is a conflict, else the highest
    rank wins; struct(timestamp, source, confidence, conflict)."""
    usable = F.filter(evidence, lambda e: e["source"] != "none")
    strong = F.filter(usable, lambda e: e["confidence"] == "strong")
    days = F.array_distinct(F.transform(strong, lambda e: date_key(e["timestamp"])))
    rank = F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])
    best = F.get(F.array_sort(F.transform(usable, lambda e: F.struct((-rank[e["source"]]).alias("r"), e["source"].alias("source"), e["timestamp"].alias("timestamp"), e["confidence"].alias("confidence")))), F.lit(0))
    listed = F.array_distinct(F.transform(strong, lambda e: F.concat(e["source"], F.lit(" ("), date_key(e["timestamp"]), F.lit(")"))))
    none = F.lit("none")
    clash = F.size(days) > 1
    return F.struct(
        F.when(~clash, best["timestamp"]).alias("timestamp"),
        F.when(clash | best.isNull(), none).otherwise(best["source"]).alias("source"),
        F.when(clash | best.isNull(), none).otherwise(best["confidence"]).alias("confidence"),
        F.when(clash, F.concat(F.lit("conflicting strong timestamp evidence: "), F.array_join(listed, ", "))).alias("conflict"),
    )
