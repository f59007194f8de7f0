"""The driver's tables as a corpus: documents with URL, date and links.

url: host from source, path from lang and doc_id; ts_ms: a day of 2024 fixed by doc_id (with ties); links: a document whose id divides by
three links to the one of half its id, where there is one, so links form deep trees and often contradict the dates; known errors: the
benchmark's texts, which some documents repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
START_MS = 1_704_067_200_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    # Links join narrow rows only; texts stay where they are read.
    linked = docs.where("doc_id > 0 AND doc_id % 3 = 0").select("doc_id", F.expr("doc_id div 2").alias("to")).join(docs.select(F.col("doc_id").alias("to"), url.alias("link")), "to").select("doc_id", "link")
    return docs.join(linked, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "text",
        "source",
        url.alias("url"),
        (F.lit(START_MS) + (F.col("doc_id") * 37 % 365) * DAY_MS).alias("ts_ms"),
        F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.array().cast("array<string>")).alias("links"),
    )


def known_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that a request names, of any length: id, text."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("id"), "text")


_URL = "'https://' || {x}.source || '.example.com/' || {x}.lang || '/' || {x}.doc_id"
#: The same corpus in DuckDB SQL.
CORPUS_SQL = f"""corpus AS MATERIALIZED (
  SELECT d.doc_id AS id, d.text, d.source, {_URL.format(x='d')} AS url, {START_MS} + (d.doc_id * 37 % 365) * {DAY_MS} AS ts_ms,
    CASE WHEN t.doc_id IS NOT NULL THEN [{_URL.format(x='t')}] ELSE []::VARCHAR[] END AS links
  FROM documents d LEFT JOIN documents t ON d.doc_id > 0 AND d.doc_id % 3 = 0 AND t.doc_id = d.doc_id // 2)"""
