"""Helpers that the operators share: shared-folder tables, key columns, fresh column names."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import tables
from papyra.memory import BATCH, holds, small_batches, trimmed  # noqa: F401
from papyra.tables import discard, new_path  # noqa: F401  the operators take them from here


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: lineage ends there, and a lost executor costs nothing of it."""
    written = tables.materialize(df, name)
    del df
    release(written.sparkSession)
    return written


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more: it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def content_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row's content; with the id it names a document. Null-safe: null and empty text differ."""
    return F.xxhash64(doc_id, text, text.isNull())


def id_order(doc_id: Column) -> Column:
    """Ids in order, null ids last."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def whole_groups(batches, key: int):
    """Record batches sorted by column ``key``, joined and cut anew so that no group is split."""
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column(key)[held[-1].num_rows - 1] != batch.column(key)[batch.num_rows - 1]:
            last = batch.column(key)[batch.num_rows - 1]
            cut = pc.index(batch.column(key), last).as_py()
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held:
            held.append(batch)
        else:
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)
