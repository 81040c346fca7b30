"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.toDF("a", "b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(a, b): each node of ``pairs`` (two long columns) that is not the least of its component, with that least node."""
    x, y = pairs.columns
    edges = pairs.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a != b").distinct()
    before, last = None, None
    while True:
        edges = materialize(_small(_large(edges)), "stars")
        if last is not None:
            discard(last)
        last = edges
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now
