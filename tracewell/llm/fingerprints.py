"""Order MinHash fingerprints in DataFrame functions alone.

A text's word 3-grams get occurrence numbers and are hashed; the hash's top five bits deal them to 32 buckets.  Each
bucket keeps its two least (one sort serves all buckets, as in one-permutation hashing), puts them back into the
order of the text, and hashes that tuple.  The likeness of two fingerprints is the share of equal buckets among those
that either fills, so it falls both when words change and when they change places.

The next document is found by one exchange: doc_ids are dealt to ranges, and the first document of each range is also
sent to the range before it, so no window spans the whole table.  Ranges come from 128 percentiles of the ids, cut
further in proportion to the session's shuffle partitions; only those bounds and one row per range are gathered.

Null texts count as empty; two empty fingerprints have likeness 1.  A text with fewer than three words is one gram,
one without words none.  Null doc_ids come first; equal doc_ids are ordered by their text.  A single document is its
own next one.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._spark import partitions

BUCKETS_LOG2, KEPT, GRAM = 5, 2, 3
POS = (1 << 20) - 1
HASH = ((1 << 64) - 1) ^ POS
_HASH = HASH - (1 << 64)  # as a signed long


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array of bucket hashes of a string column.  Every intermediate array is read at least twice by the
    next step, which keeps the optimizer from inlining it into a lambda."""
    w, s, r, t, k = (f"_{out}_{x}" for x in "wsrtk")
    grams = ", ".join(f"{w}[i + {j}]" for j in range(GRAM))
    shift = 64 - BUCKETS_LOG2
    return (
        df.withColumn(w, F.expr(rf"filter(split({text}, '\\s+'), x -> x <> '')"))
        .withColumn(
            s,
            F.expr(
                f"sort_array(CASE WHEN size({w}) >= {GRAM} THEN transform(sequence(0, size({w}) - {GRAM}), i -> "
                f"(xxhash64({grams}) & {_HASH}L) | CAST(i div (1 + size({w}) div {POS}) AS BIGINT)) "
                f"WHEN size({w}) > 0 THEN array(xxhash64(array_join({w}, ' ')) & {_HASH}L) ELSE CAST(array() AS ARRAY<BIGINT>) END)"
            ),
        )
        .drop(w)
        .withColumn(r, F.expr(f"CASE WHEN size({s}) > 0 THEN filter(sequence(0, size({s}) - 1), i -> i = 0 OR ({s}[i] & {_HASH}L) <> ({s}[i - 1] & {_HASH}L)) ELSE CAST(array() AS ARRAY<INT>) END"))
        .withColumn(
            t,
            F.expr(
                f"sort_array(CASE WHEN size({r}) = size({s}) THEN transform({s}, x -> (xxhash64(x & {_HASH}L, 0) & {_HASH}L) | (x & {POS}L)) "
                f"ELSE flatten(transform({r}, (b, j) -> transform(slice({s}, b + 1, coalesce(get({r}, j + 1), size({s})) - b), "
                f"(x, o) -> (xxhash64(x & {_HASH}L, o) & {_HASH}L) | (x & {POS}L)))) END)"
            ),
        )
        .drop(s, r)
        .withColumn(k, F.expr(f"filter({t}, (x, i) -> i < {KEPT} OR shiftright({t}[i - {KEPT}], {shift}) <> shiftright(x, {shift}))"))
        .drop(t)
        .withColumn(
            out,
            F.expr(
                f"transform(sequence(0, {(1 << BUCKETS_LOG2) - 1}), b -> CASE WHEN exists({k}, x -> shiftrightunsigned(x, {shift}) = b) THEN "
                f"xxhash64(transform(array_sort(transform(filter({k}, x -> shiftrightunsigned(x, {shift}) = b), "
                f"x -> shiftleft(x & {POS}L, 44) | shiftrightunsigned(x, 20))), y -> y & {(1 << 44) - 1}L)) END)"
            ),
        )
        .drop(k)
    )


def likeness(a: str, b: str) -> str:
    either = f"size(filter({a}, (x, i) -> x IS NOT NULL OR {b}[i] IS NOT NULL))"
    return f"CASE WHEN {either} = 0 THEN 1D ELSE size(filter({a}, (x, i) -> x = {b}[i])) / CAST({either} AS DOUBLE) END"


def as_text(sig: str) -> str:
    return f"array_join(transform({sig}, x -> CASE WHEN x IS NULL THEN '--------' ELSE lower(lpad(hex(x & 4294967295L), 8, '0')) END), '')"


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(doc_id, text) with rng, dealt by it, and helper: true for the copy of a range's first document that
    stands behind the range before it (behind the last: the first of all)."""
    bounds = docs.agg(F.percentile_approx("doc_id", [i / 128 for i in range(129)], 10000).alias("b")).collect()[0]["b"]
    bounds = sorted(set(bounds or [0]))
    cuts = max(1, -(-ranges // len(bounds)))
    b = f"array({', '.join(f'{int(v)}L' for v in bounds)})"
    at = f"size(filter({b}, v -> v <= doc_id))"
    span = f"greatest(1L, coalesce(get({b}, {at}), {int(bounds[-1]) + 1}L) - get({b}, {at} - 1))"
    rng = F.expr(f"CASE WHEN doc_id IS NULL OR doc_id < {int(bounds[0])}L THEN -1L ELSE {at} * {cuts}L + least({cuts - 1}L, CAST(floor((doc_id - get({b}, {at} - 1)) * CAST({cuts} AS DOUBLE) / {span}) AS BIGINT)) END")
    rows = docs.withColumn("rng", rng)
    # One row per range: its first id, and the range before it.  The number of ranges follows the partitions, not rows.
    order = Window.orderBy("rng")
    firsts = (
        docs.select("doc_id").withColumn("rng", rng).groupBy("rng").agg(F.min("doc_id").alias("first_id"))
        .select("first_id", F.coalesce(F.lag("rng").over(order), F.max("rng").over(Window.partitionBy())).alias("to_rng"), F.col("rng").alias("of_rng"))
    )
    first_text = Window.partitionBy("rng").orderBy("text")
    helpers = (
        rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("rng") == F.col("of_rng")))
        .withColumn("n", F.row_number().over(first_text))
        .where("n = 1")
        .select("doc_id", "text", F.col("to_rng").alias("rng"), F.lit(True).alias("helper"))
    )
    return rows.select("doc_id", "text", "rng", F.lit(False).alias("helper")).unionByName(helpers)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The digest of op8 for docs(doc_id, text): fingerprints of each text and of its edited text, and likenesses."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("rng").orderBy("helper", F.col("doc_id").asc_nulls_first(), "text")
    n = partitions(docs.sparkSession)
    rows = (
        in_ranges(docs, 4 * n)
        .repartition(n, "rng")
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.expr("concat(left(text, CAST(n_chars - n_chars div 4 AS INT)), left(next_text, CAST(n_chars div 4 AS INT)))"))
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    )
    rows = with_signature(rows, "text", "sig").drop("text", "next_text")
    rows = with_signature(rows, "edited", "edited_sig").drop("edited")
    keyed = Window.partitionBy("rng").orderBy("helper", F.col("doc_id").asc_nulls_first(), "edited_sha256")
    return (
        rows.withColumn("next_sig", F.lead("sig").over(keyed))
        .where("NOT helper")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.expr(as_text("sig")).alias("fingerprint"),
            F.expr(as_text("edited_sig")).alias("edited_fingerprint"),
            F.expr(likeness("sig", "edited_sig")).alias("near_edited"),
            F.expr(likeness("sig", "next_sig")).alias("near_next"),
        )
    )
