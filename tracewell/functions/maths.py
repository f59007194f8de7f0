"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noisy_or(*weights: Column) -> Column:
    """M1: one minus the product of complements, folded from the left."""
    product = F.lit(1.0)
    for w in weights:
        product = product * (F.lit(1.0) - w)
    return F.lit(1.0) - product


def noisy_or_of(weights: Column) -> Column:
    return F.lit(1.0) - F.aggregate(weights, F.lit(1.0), lambda p, w: p * (F.lit(1.0) - w))


def round3(x: Column) -> Column:
    """M2: halves go up, as in floor(1000 x + 1/2) / 1000; ROUND differs on binary midpoints."""
    return F.floor(x * 1000 + 0.5) / 1000


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """M3."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def rarity(weight: Column, carriers: Column) -> Column:
    """M4."""
    return weight / F.sqrt(F.greatest(F.lit(1), carriers))


def capped(cap: float, x: Column) -> Column:
    """M5."""
    return F.least(F.lit(cap), x)
