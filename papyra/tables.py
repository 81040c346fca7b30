"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="papyra-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/papyra/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later plans start there, and a lost executor costs nothing of it. ``compression``: of the files, where it is not the session's."""
    path = new_path(df.sparkSession, name)
    (df.write if compression is None else df.write.option("compression", compression)).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.papyra_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for t in tables:
        fs, path = file_system(t.sparkSession, t.papyra_path)
        fs.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its source has fewer: one small file would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """``df`` with its rows numbered from ``start`` on in an order: a distributed sort, and an offset for each of its partitions."""
    at = "__at"
    ordered = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    sizes = dict(ordered.groupBy(F.shiftright(at, 33)).count().collect())  # a row a partition
    offsets, before = [], start
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    own = df.sparkSession.createDataFrame(offsets, "__p long, __offset long")
    found = ordered.join(F.broadcast(own), F.shiftright(at, 33) == F.col("__p"))
    return found.withColumn(name, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__offset")).drop(at, "__p", "__offset")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
