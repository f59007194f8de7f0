"""Papers by title, any author's surname, and the year where both sides have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators.hold import hold


def surnames(authors: Column) -> Column:
    """The last word of each name's key, each once."""
    last = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.element_at(F.split(text.title_key(a), " "), -1))
    return F.array_sort(F.array_distinct(F.filter(last, lambda s: s != "")))


#: Pairs that one task compares at a time, about.
PIECE = 1_000_000


def same_papers(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, paper) for asked(id, title, authors, year) and papers(paper, title, authors, year): equal title keys, a surname in common, and
    no two different years.  Pairs are blocked by title and surname together, so a title that many papers have is split by its authors, and a
    block of many pairs is dealt out in pieces of about PIECE: each of its papers goes to one, what is asked for to all.  A pair with several surnames
    in common counts in the first.  Rows without a title or authors match nothing; repeated rows match each time."""

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        names = rows.select(*more, "year", text.title_key(F.col("title")).alias("key"), surnames(F.col("authors")).alias("names")).where("key <> ''")
        return names.withColumn("surname", F.explode("names"))

    block = ["key", "surname"]
    a, b = hold(keyed(asked, "id")), hold(keyed(papers, "paper"))
    counts = a.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(*block).agg(F.count(F.lit(1)).alias("m")), block)
    many = hold(counts.select(*block, F.ceil(F.col("n") * F.col("m") / PIECE).alias("pieces")).where("pieces > 1"))
    dealt = lambda rows, piece: rows.join(many, block, "left").select(*rows.columns, F.coalesce("pieces", F.lit(1).cast("long")).alias("pieces")).withColumn("piece", piece).drop("pieces")
    a, b = dealt(a, F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).alias("a"), dealt(b, F.pmod(F.xxhash64("paper"), F.col("pieces"))).alias("b")
    first = F.element_at(F.array_sort(F.array_intersect("a.names", "b.names")), 1)
    years = F.coalesce(F.col("a.year") == F.col("b.year"), F.lit(True))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.surname") == F.col("b.surname")) & (F.col("a.piece") == F.col("b.piece")) & (first == F.col("a.surname")) & years
    return a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.paper").alias("paper"))
