"""Tables of an import's state: creation, seed offsets, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import schemas
from papyra.operators.metadata import upsert

#: Tables of a library and their columns.
TABLES = {"books": schemas.BOOKS, "works": schemas.WORKS, "seed_offsets": schemas.SEED_OFFSETS}


def create_tables(spark: SparkSession) -> None:
    """The tables that are not there yet; a table that lacks columns gets them, null in old rows."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
        have = {c.lower() for c in spark.table(name).columns}
        want = spark.createDataFrame([], columns).schema
        new = [f"`{f.name}` {f.dataType.simpleString()}" for f in want if f.name.lower() not in have]
        if new:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def seed_offsets(offsets: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, position, last_book_id) of each of ``sources`` (source); -1 and null for one without offset."""
    found = sources.select("source").distinct().join(offsets, "source", "left")
    return found.select("source", F.coalesce("position", F.lit(-1)).cast("long").alias("position"), "last_book_id")


def set_offsets(offsets: DataFrame, new: DataFrame) -> DataFrame:
    """``offsets`` with the positions of ``new`` in place of theirs."""
    return upsert(offsets, new, ["source"])


def counts(**tables: DataFrame) -> dict[str, int]:
    return {name: df.count() for name, df in tables.items()}
