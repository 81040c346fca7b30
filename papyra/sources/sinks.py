"""Writing: chunk store, rejects, write-ahead log, tables that are replaced whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import schemas
from papyra.functions.text import shard_key


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by shard of the book id, compressed."""
    chunks.withColumn("shard", shard_key(F.col("book_id"))).write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_chunk(spark: SparkSession, path: str, book_id: str, seq: int) -> DataFrame:
    """One chunk of a book; no row for a place it does not have. Only its shard is read."""
    rows = spark.read.schema(f"{schemas.CHUNKS}, shard string").parquet(path)
    return rows.where((F.col("shard") == book_id[:2].rjust(2, "0")) & (F.col("book_id") == book_id) & (F.col("seq") == seq))


def write_rejects(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add (id, content, metadata, length) to a write-ahead log of JSON lines."""
    rows.select("id", "content", "metadata", "length").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a write-ahead log; blank and broken lines, and such without id, are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schemas.WAL).alias("r")).where("r.id is not null").select("r.*")


def clear_log(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], schemas.WAL).write.mode("overwrite").json(path)


def log_line(id_: int, content: str, metadata: dict) -> str:
    return json.dumps({"id": id_, "content": content, "metadata": json.dumps(metadata), "length": 0})


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
