"""How the claims of a text differ from those of the text that it was taken from.

Sentences become rows.  Equal ones meet by an equi-join on their key and on how many times it has occurred (J13), alike ones by the words that
they share (J12); only the choice among alike ones, where each taken pair rules out others, is a fold over the sorted pairs of one text.
Null and empty texts have no sentences.  Of repeated rows with the same keys each sentence counts again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators.hold import hold

# How alike reframed sentences are at least, and how many changes are told.
ALIKE, MOST = 0.28, 6
_CHOOSE = """aggregate(pairs, named_struct('p', cast(array() AS array<int>), 'c', cast(array() AS array<int>)),
  (taken, x) -> IF(array_contains(taken.p, x.pi) OR array_contains(taken.c, x.ci), taken, named_struct('p', array_append(taken.p, x.pi), 'c', array_append(taken.c, x.ci))),
  taken -> arrays_zip(taken.p, taken.c))"""


def without_citations(sentence: Column, citations: Column) -> Column:
    """A space for each known citation, in any case."""
    return F.aggregate(citations, sentence, lambda s, name: F.regexp_replace(s, F.concat(F.lit(r"(?iu)\Q"), name, F.lit(r"\E")), F.lit(" ")))


def claim_units(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each sentence of parent and child: the keys, side (p or c), place, sentence, its key and its distinct words."""
    named = pairs if "citations" in pairs.columns else pairs.withColumn("citations", F.array().cast("array<string>"))
    sides = named.select(*keys, F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("parent").alias("body")), F.struct(F.lit("c").alias("side"), F.col("child").alias("body")))).alias("s")).select(*keys, "citations", "s.*")
    rows = sides.withColumn("body", text.canonical_text(F.col("body"))).select(*keys, "citations", "side", F.posexplode(text.sentences(F.col("body"), False)).alias("place", "sentence"))
    return rows.select(*keys, "side", "place", "sentence", text.unit_key(F.col("sentence"), False).alias("same"), F.array_distinct(text.words(without_citations(F.col("sentence"), F.col("citations")), False)).alias("words"))


def claim_changes(pairs: DataFrame, keys: Sequence[str], most: int = MOST) -> DataFrame:
    """pairs(<keys>, parent, child[, citations]): per pair the changes in their order: type (reframed, added, omitted), summary, before, after."""
    keys = list(keys)
    units = hold(claim_units(pairs, keys))
    nth = Window.partitionBy(*keys, "side", "same").orderBy("place")
    counted = units.where("same <> ''").withColumn("nth", F.row_number().over(nth))
    side = lambda df, s, *more: df.where(F.col("side") == s).select(*keys, F.col("place").alias(f"{s}i"), *more)
    kept = side(counted, "p", "same", "nth").join(side(counted, "c", "same", "nth"), [*keys, "same", "nth"]).select(*keys, F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("pi").alias("place")), F.struct(F.lit("c").alias("side"), F.col("ci").alias("place")))).alias("u")).select(*keys, "u.*")
    left = hold(units.join(kept, [*keys, "side", "place"], "left_anti"))
    said = left.select(*keys, "side", "place", F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = side(said, "p", "word", F.col("n").alias("pn")).join(side(said, "c", "word", F.col("n").alias("cn")), [*keys, "word"]).groupBy(*keys, "pi", "ci", "pn", "cn").agg(F.count(F.lit(1)).alias("k"))
    alike = shared.withColumn("s", F.col("k") / (F.col("pn") + F.col("cn") - F.col("k"))).where(F.col("s") >= ALIKE)
    best = alike.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "pi", "ci"))).alias("pairs"))
    reframed = hold(best.select(*keys, F.explode(F.expr(_CHOOSE)).alias("x")).select(*keys, F.col("x.p").alias("pi"), F.col("x.c").alias("ci")))
    none = F.lit(None).cast("string")
    before, after = side(left, "p", F.col("sentence").alias("before")), side(left, "c", F.col("sentence").alias("after"))
    told = lambda df, rank, kind, place: df.select(*keys, F.lit(rank).alias("rank"), F.col(place).alias("place"), F.lit(kind).alias("type"), "before", "after")
    rows = (
        told(reframed.join(before, [*keys, "pi"]).join(after, [*keys, "ci"]), 0, "reframed", "ci")
        .unionByName(told(after.join(reframed, [*keys, "ci"], "left_anti").withColumn("before", none), 1, "added", "ci"))
        .unionByName(told(before.join(reframed, [*keys, "pi"], "left_anti").withColumn("after", none), 2, "omitted", "pi"))
    )
    # The wording.
    summary = (
        F.when(F.col("type") == "reframed", F.concat(F.lit("Reframed "), text.quote(F.col("before")), F.lit(" as "), text.quote(F.col("after"))))
        .when(F.col("type") == "added", F.concat(F.lit("Added claim: "), text.quote(F.col("after"))))
        .otherwise(F.concat(F.lit("Omitted claim: "), text.quote(F.col("before"))))
    )
    order = Window.partitionBy(*keys).orderBy("rank", "place")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(*keys, "n", "type", summary.alias("summary"), "before", "after")
