"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import decontaminate, fingerprints, html_main, langid, neardup, packing, periodic, quality, repair_ids, sharding, spelling, token_counts, vector_packing
from tracewell.llm._spark import ship, table, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = shipped
    return shipped


@query
def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op3_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op4_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-grams at a similarity of 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents; the ids of each piece as their crc32."""
    packed = packing.pack_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


@query
def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


@query
def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of 2,048; the ids of each piece as their crc32."""
    packed = vector_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query
def op12_parity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with one letter left out of every 199th run of letters or so, as its hash has it."""
    return spelling.variants(table(spark, sf_dir, "documents"), gaps=199)


@query
def op13_bit_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.detect(table(spark, sf_dir, "documents"), alter=True))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
