"""The training-data pipeline: language ID, quality, near-duplicates, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, langid, neardup, packing, quality
from tracewell.llm._spark import Scratch, batch_rows, filter_rows, remove, shared_dir, ship, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.2) -> DataFrame:
    """Documents without a letter, or of whose n-grams the likeliest language knows under a fifth, go: null and empty texts too.  Rows are judged one
    by one: repeated rows, null ids, ties and columns of any name need no rule, texts are read whole, no documents give no rows."""
    ship(spark)
    batch_rows(spark, 1000)
    filters = langid.learn(docs)

    def keep(texts: list[str | None]) -> list[bool]:
        langs, scores = filters.predict(texts)
        return [lang != "und" and score >= least for lang, score in zip(langs, scores, strict=True)]

    return filter_rows(docs, keep)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Documents with a score under the threshold go; null and empty texts have one, too.  Rows are judged one by one, whole texts, a score at the
    threshold stays; ids and other columns, null, repeated or of any name, are not looked at.  No documents give no rows."""
    ship(spark)
    batch_rows(spark, 1000)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_rows(docs, lambda texts: model.scores(texts) >= least)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the least doc_id.  Rows whose doc_id
    is null or stands in several rows are documents of their own, under numbers above all doc_ids: different texts all stay, and of copies
    one does.  Null and empty texts are near nothing and stay; other columns are carried along, no documents give no rows."""
    ship(spark)
    scratch = Scratch(spark, "near-duplicates")
    repeated = scratch.keep(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    if repeated.isEmpty():
        gone = scratch.keep(neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct())
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    odd = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi")
    plain = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_anti")
    above = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
    odd = scratch.keep(odd.withColumn("_tracewell_row", F.monotonically_increasing_id() + F.lit(above)))
    marked = neardup.near_duplicates(plain.select("doc_id", "text").unionByName(odd.select(F.col("_tracewell_row").alias("doc_id"), "text")))
    gone = scratch.keep(marked.where("NOT kept").select("doc_id").distinct())
    own = odd.join(gone.withColumnRenamed("doc_id", "_tracewell_row"), "_tracewell_row", "left_anti")
    return plain.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(own.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item's words go.  Null and empty texts stay; rows are judged one by one, whole texts; ids and
    other columns, null, repeated or of any name, are not looked at.  No documents or no items change nothing."""
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left, each document's with an end mark, into sequences of several permitted lengths: one row
    per piece, with the crc32 of its ids.  Null and empty texts have only the end mark, long ones are cut into pieces, repeated rows are packed one by
    one, a null doc_id is carried along, other columns are not read, no documents give no rows."""
    ship(spark)
    return packing.pack_tokens(docs, tokenizer_file()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_documents),
]

#: Classifiers, connected components and packing can't be written as SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each stage's rows are written and read again before the next, and deleted when that is done."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
