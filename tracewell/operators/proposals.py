"""Proposals of sources: mined from a document, merged across channels, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text, urls


def native(docs: DataFrame, most: int = 40) -> DataFrame:
    """C24 on docs(id, text, links): id, key, url, citation, signal; the first of each key in the order links, DOIs, arXiv ids,
    raw URLs, docket numbers; at most 40 of a document, as the feature has it."""
    kind = urls.classify_link
    item = lambda key, url, citation, signal: F.struct(key.alias("key"), url.alias("url"), citation.alias("citation"), signal.alias("signal"))
    none = F.lit(None).cast("string")
    bare = text.strip_tail
    every = lambda pattern, group=0: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), group)
    linked = lambda u, signal: item(F.concat(F.lit("url:"), urls.canonical_url(u)), u, none, signal)
    found = F.concat(
        F.transform("links", lambda u: linked(u, kind(u))),
        F.transform(every(r"\b10\.\d{4,9}/[^\s\"'<>()\[\]]+"), lambda d: item(F.concat(F.lit("doi:"), F.lower(bare(d))), F.concat(F.lit("https://doi.org/"), bare(d)), bare(d), F.lit("doi"))),
        F.transform(every(r"(?i)\barxiv[:\s]+(\d{4}\.\d{4,5})(?:v\d+)?\b", 1), lambda a: item(F.concat(F.lit("arxiv:"), a), F.concat(F.lit("https://arxiv.org/abs/"), a), F.concat(F.lit("arXiv:"), a), F.lit("arxiv"))),
        F.transform(every(r"\bhttps?://[^\s\"'<>()\[\]]+"), lambda u: linked(bare(u), F.when(kind(bare(u)) == "outbound_link", "inline_citation").otherwise(kind(bare(u))))),
        F.transform(every(r"(?i)\b(?:No\.|Case No\.|Docket No\.)\s*[:.]?\s*(?:\d{1,2}:\d{2}-[a-z]{2}-\d{3,6}|\d{2,4}-\d{3,6})\b"), lambda n: item(F.concat(F.lit("docket:"), F.lower(F.trim(n))), none, F.trim(n), F.lit("named_source"))),
    )
    rows = docs.select("id", F.posexplode(found).alias("place", "p")).select("id", "place", "p.*").where("signal IS NOT NULL")
    first = rows.groupBy("id", "key").agg(F.min_by(F.struct("url", "citation", "signal"), "place").alias("p"), F.min("place").alias("place"))
    order = Window.partitionBy("id").orderBy("place")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("id", "n", "key", "p.url", "p.citation", "p.signal")


def identity(url, title, author, citation):
    """A15's identity: citation, else canonical URL, else title and author; null if a proposal has none of them."""
    key = lambda *c: F.nullif(F.trim(F.concat_ws("|", *[F.nullif(text.match_key(x), F.lit("")) for x in c])), F.lit(""))
    return F.coalesce(
        F.when(F.nullif(F.trim(citation), F.lit("")).isNotNull(), F.concat(F.lit("citation:"), text.match_key(citation))),
        F.when(url.isNotNull(), F.concat(F.lit("url:"), urls.canonical_url(url))),
        F.when(key(title, author).isNotNull(), F.concat(F.lit("title:"), key(title, author))),
    )


def merge(proposals: DataFrame) -> DataFrame:
    """A14, A15 on proposals(place, url, title, author, citation, channel): per identity the first row, its gaps filled from later
    ones, and all channels; rows without identity stay."""
    keyed = proposals.withColumn("identity", identity(F.col("url"), F.col("title"), F.col("author"), F.col("citation")))
    group = F.coalesce("identity", F.concat(F.lit("none:"), F.col("place").cast("string")))
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    return keyed.groupBy(group.alias("key")).agg(F.min("place").alias("place"), *[filled(c) for c in ("url", "title", "author", "citation")], F.array_sort(F.collect_set("channel")).alias("channels"))


def merge_hits(hits: DataFrame) -> DataFrame:
    """A13 on hits(url, query, rank): per canonical URL the best rank and how many queries found it."""
    return hits.groupBy(urls.canonical_url(F.col("url")).alias("url")).agg(F.min("rank").alias("best_rank"), F.countDistinct("query").alias("n_queries"))


def rank_hits(hits: DataFrame, most: int = 10) -> DataFrame:
    """C25 on hits(doc, url, title, snippet, best_rank, n_queries, phrases, anchors, passage): F7 and the score, best first."""
    hay = F.concat_ws(" ", "title", "snippet", "url")
    rows = hits.withColumn("w", text.unicode_words(hay)).withColumn("hay", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    phrases = F.size(F.filter("phrases", lambda p: F.contains("hay", F.concat(F.lit(" "), p, F.lit(" ")))))
    anchors = F.size(F.filter("anchors", lambda a: F.array_contains("w", a)))
    rows = rows.withColumn("phrase_hits", phrases).withColumn("anchor_hits", anchors).where("(size(phrases) = 0 AND size(anchors) = 0) OR phrase_hits > 0 OR anchor_hits > 0")
    near = text.jaccard(F.array_distinct(text.unicode_words(F.col("title"))), F.array_distinct(F.slice(text.unicode_words(F.col("passage")), 1, 80)))
    score = F.col("phrase_hits") * 3 + F.when(F.size("anchors") > 0, 2.0 * F.col("anchor_hits") / F.size("anchors")).otherwise(0.0) + near + 0.5 / (1 + F.col("best_rank")) + F.least(F.col("n_queries") - 1, F.lit(3)) * 0.4 + urls.host_bonus(F.col("url")) - urls.listing_penalty(F.col("url"))
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "url")
    return rows.withColumn("score", F.round(score, 6)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("doc", "n", "url", "score")
