"""Scoring formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _set(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def popularity(average: Column, count: Column, want: Column, editions: Column) -> Column:
    """A factor from 1 to 2; nulls and zeros add nothing."""
    rating = F.when(_set(average) & F.coalesce(count >= 10, F.lit(False)), average / 5 * 0.3).otherwise(0)
    wanted = F.when(_set(want), F.least(F.lit(0.2), F.log10(F.greatest(F.lit(1), want)) / 20)).otherwise(0)
    edition = F.when(_set(editions), F.least(F.lit(0.1), editions / 100)).otherwise(0)
    return F.least(F.lit(2.0), 1.0 + rating + wanted + edition)
