"""Exact top-k search with vector-approximation files.

The file of approximations has, for each vector, one of 256 cells a dimension (a byte), cut at normal quantiles of that dimension's mean and deviation,
and the distance from the vector to the middle of its cells. Exact vectors lie in another table. A search has two phases:

* Queries, in blocks, meet the whole file, in parts; no exact vector but the query's is read. The distance to the middle of the cells, less and
  plus the stored one, bounds the distance from below and above; what is left by the kth smallest upper bound gets the distance to the
  cells' box as a second lower bound.
* The candidates that are left by the kth smallest upper bound of all parts are ordered by lower bound. Exact vectors are read in this order: the first
  ``STEP`` of each query, then those whose bound does not exceed the kth distance so far; after these the result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import discard, materialize

CELLS = 256
#: Vectors in one row of the file, and queries that meet the file together.
ROWS, QUERIES = 1024, 1024
#: Rows of the file in a part.
GROUP = 128
#: Exact vectors read for a query at first, in order of bounds.
STEP = 64
_CUTS = np.array([NormalDist().inv_cdf(i / CELLS) for i in range(1, CELLS)])
_MIDDLE = np.array([NormalDist().inv_cdf((i + 0.5) / CELLS) for i in range(CELLS)])
#: Rounding of sums and products in double precision, relative to what is added.
_SLACK = 1e-12
_FAR = np.iinfo(np.int64).max


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) for the rows whose vector is not null or empty and has finite elements only."""
    column = batch.column(2)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        x = values[starts[at][:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(axis=1)
        yield dim, at[fine], x[fine]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, at, x in _usable(batch):
            own = batch.take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(x), dim, dtype=np.int32)), lists], names=["vec_id", "asks", "dim", "v"])


def _by_dim(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row ids, vectors), up to ``rows`` at a time, from (rid, dim, v)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        dims, rids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
            held.setdefault(dim, []).append((rids[at], x))
            if sum(len(r) for r, _ in held[dim]) >= rows:
                r, x = (np.concatenate(c) for c in zip(*held.pop(dim)))
                whole = len(r) // rows * rows
                for a in range(0, whole, rows):
                    yield dim, r[a : a + rows], x[a : a + rows]
                if whole < len(r):
                    held[dim] = [(r[whole:], x[whole:])]
    for dim, parts in held.items():
        yield dim, *(np.concatenate(c) for c in zip(*parts))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for dim, _, x in _by_dim(batches, ROWS):
        x = x.astype(np.float64)
        found[dim] = found.get(dim, 0) + np.stack([np.full(dim, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
    rows = [(d, i, *m[:, i].tolist()) for d, m in found.items() for i in range(d)]
    columns = list(zip(*rows)) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=["dim", "i", "n", "s", "q"])


class Grid:
    """Cells of one dimension: ``edges`` (dimensions, CELLS - 1), ``middle`` (dimensions, CELLS)."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.edges = mean[:, None] + deviation[:, None] * _CUTS
        self.middle = mean[:, None] + deviation[:, None] * _MIDDLE
        self.below = np.concatenate([np.full((len(mean), 1), -np.inf), self.edges], axis=1)
        self.above = np.concatenate([self.edges, np.full((len(mean), 1), np.inf)], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each element."""
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.middle[np.arange(cells.shape[1]), cells]

    def gaps(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Squared distance of each query to the box of cells beside it."""
        d = np.arange(cells.shape[1])
        return (np.maximum(0, np.maximum(self.below[d, cells] - queries, queries - self.above[d, cells])) ** 2).sum(axis=1)


def _filed(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid]) -> Iterator[pa.RecordBatch]:
    for dim, rids, x in _by_dim(batches, ROWS):
        code = grids[dim].cells(x)
        with np.errstate(over="ignore"):
            off = np.nextafter((np.linalg.norm(x - grids[dim].middles(code), axis=1) * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rids)], pa.int32()), pa.array([rids.tobytes()]), pa.array([off.tobytes()]), pa.array([code.tobytes()])], names=["dim", "n", "rids", "off", "cells"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, rids, x in _by_dim(batches, QUERIES):
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rids)], pa.int32()), pa.array([rids.tobytes()]), pa.array([x.tobytes()])], names=["dim", "n", "rids", "vectors"])


class Scan:
    """A block of queries against approximations: the k smallest upper bounds of each, and the pairs that they leave."""

    def __init__(self, rids: np.ndarray, queries: np.ndarray, grid: Grid, k: int) -> None:
        self.rids, self.queries, self.grid, self.k = rids, queries.astype(np.float64), grid, k
        self.square = (self.queries**2).sum(axis=1)
        self.top = np.full((len(rids), k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rids: np.ndarray, off: np.ndarray, cells: np.ndarray) -> None:
        middle, off = self.grid.middles(cells), off.astype(np.float64)
        norm = (middle**2).sum(axis=1)
        slack = (self.square + norm.max()) * (_SLACK * cells.shape[1])
        square = self.queries @ middle.T
        square *= -2
        square += norm
        square += self.square[:, None]
        q, v = np.nonzero(square <= ((self.top.max(axis=1) + off.max()) ** 2 * (1 + _SLACK) + slack)[:, None])
        other = self.rids[q] != rids[v]
        q, v = q[other], v[other]
        near, slack = square[q, v], slack[q]
        del square
        high = np.sqrt(np.maximum(near, 0) + slack) * (1 + _SLACK) + off[v]
        low = np.sqrt(np.maximum(near - slack, 0)) * (1 - _SLACK) - off[v]
        self._keep(q, high)
        fine = low <= self.top.max(axis=1)[q]
        q, v, low = q[fine], v[fine], low[fine]
        self.found.append((q, rids[v], self._boxed(q, cells[v], low)))

    def _keep(self, q: np.ndarray, high: np.ndarray) -> None:
        """Upper bounds of pairs, sorted by query."""
        own, first, count = np.unique(q, return_index=True, return_counts=True)
        if len(own):
            wide = np.full((len(own), self.k + int(count.max())), np.inf)
            wide[:, : self.k] = self.top[own]
            wide[np.repeat(np.arange(len(own)), count), self.k + np.arange(len(q)) - np.repeat(first, count)] = high
            self.top[own] = np.partition(wide, self.k - 1, axis=1)[:, : self.k]

    def _boxed(self, q: np.ndarray, cells: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The larger of two lower bounds of each pair."""
        out = np.maximum(low, 0)
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            out[part] = np.maximum(out[part], np.sqrt(self.grid.gaps(self.queries[q[part]], cells[part])) * (1 - _SLACK * cells.shape[1]))
        return out

    def left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, row id, lower bound) of all pairs that the smallest upper bounds leave."""
        q, r, low = (np.concatenate(c) for c in zip(*self.found))
        fine = low <= self.top.max(axis=1)[q]
        return q[fine], r[fine], low[fine]


_FOUND = "qid long, rid long, low double, top array<double>"


def _search(batches: Iterator[pa.RecordBatch], k: int, grids: dict[int, Grid]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, q, part, role, n, rids, off, data) sorted so; role 0 is the block of queries, 1 a row of the file."""
    now, scan = None, None

    def out(scan: Scan) -> pa.RecordBatch:
        q, rid, low = scan.left()
        n = len(scan.rids)
        tops = pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(n + 1) * k, np.full(len(q), n * k)]).astype(np.int32)), pa.array(scan.top.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([scan.rids, scan.rids[q]])), pa.array(np.concatenate([np.full(n, -1), rid])), pa.array(np.concatenate([np.zeros(n), low])), tops], names=["qid", "rid", "low", "top"])

    for whole in batches:
        for r in range(whole.num_rows):
            dim, q, part, role, n, rids, off, data = (whole.column(c)[r].as_py() for c in range(8))
            rids = np.frombuffer(rids, dtype=np.int64)
            if (dim, q, part) != now:
                if scan and scan.found:
                    yield out(scan)
                now, scan = (dim, q, part), Scan(rids, np.frombuffer(data, dtype=np.float32).reshape(n, dim), grids[dim], k)
            if role:
                scan.add(rids, np.frombuffer(off, dtype=np.float32), np.frombuffer(data, dtype=np.uint8).reshape(n, dim))
    if scan and scan.found:
        yield out(scan)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, vec_id, neighbor_id, distance) from (qid, vec_id, q, neighbor_id, v)."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(2)).to_numpy()
        a, b = (batch.column(c).flatten().to_numpy().astype(np.float64) for c in (2, 4))
        d = np.sqrt(np.add.reduceat((a - b) ** 2, np.cumsum(sizes) - sizes)) if len(sizes) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.round(d, 9))], names=["qid", "vec_id", "neighbor_id", "distance"])


def top_k(vectors: DataFrame, k: int = 10, asks: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for each row of ``vectors`` (vec_id, embedding) that satisfies ``asks`` (all if None) its k nearest
    other rows, of all rows.

    Euclidean distance, rounded to 9 places, from exact vectors; rank from 1, equal distances by vec_id. A row's own self is left out; rows
    that repeat it are neighbours at distance 0. Only vectors of one length are compared. Null and empty vectors, and those with a null, NaN or
    infinite element, are left out; finite elements of any size are compared. Null ids come last among equals, and out as null; a null ``asks`` is false.
    Fewer than k others: all of them. Other columns are not read. An empty table gives an empty table.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    vec_id = vectors["vec_id"].cast("long")
    ask = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    some = vectors.select(F.coalesce(vec_id, F.lit(int(_FAR))).alias("vec_id"), ask.alias("asks"), vectors["embedding"].cast("array<float>").alias("embedding"))
    exact = some.mapInArrow(_exact, "vec_id long, asks boolean, dim int, v array<float>").withColumn("rid", F.monotonically_increasing_id())
    exact = materialize(exact, "exact")
    total = exact.select("rid", "dim", "v").mapInArrow(_moments, "dim int, i int, n double, s double, q double").groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in "nsq"])
    rows: dict[int, list[tuple[float, float]]] = {}
    for r in total.orderBy("dim", "i").toLocalIterator():  # a row a dimension
        mean = r.s / r.n
        rows.setdefault(r.dim, []).append((mean, max(r.q / r.n - mean * mean, 0) ** 0.5))
    grids = {d: Grid(*np.array(m).T) for d, m in rows.items()}
    cells = materialize(exact.select("rid", "dim", "v").mapInArrow(lambda it: _filed(it, grids), "dim int, n int, rids binary, off binary, cells binary"), "cells")
    queries = exact.where("asks").select("rid", "dim", "v").mapInArrow(_asked, "dim int, n int, rids binary, vectors binary")
    queries = materialize(queries.withColumn("at", F.monotonically_increasing_id()), "queries")
    number = F.row_number().over(W.partitionBy("dim").orderBy("at")) - 1
    queries_at = queries.join(queries.select("dim", "at").withColumn("q", number).drop("dim"), "at").drop("at")  # a row for 1,024 queries
    asked = queries.groupBy("dim").agg(F.count(F.lit(1)).alias("asked"))
    parts = cells.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    own = queries_at.join(F.broadcast(parts), "dim").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))  # a row a dimension
    file = cells.join(F.broadcast(asked.join(parts, "dim")), "dim").withColumn("part", F.pmod(F.xxhash64("rids"), F.col("parts"))).withColumn("q", F.explode(F.expr("sequence(0, asked - 1)")))
    names = ["dim", "q", "part", "role", "n", "rids", "off", "data"]
    kinds = ["int", "long", "long", "int", "int", "binary", "binary", "binary"]
    shape = lambda df: df.select(*[F.col(c).cast(t).alias(c) for c, t in zip(names, kinds)])
    both = shape(own.withColumns({"role": F.lit(0), "off": F.lit(None), "data": F.col("vectors")})).union(shape(file.withColumns({"role": F.lit(1), "data": F.col("cells")})))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (asked.join(parts, "dim").agg(F.sum(F.col("asked") * F.col("parts"))).first()[0] or 0) // 2)
    both = both.repartition(min(tasks, 100_000), "dim", "q", "part").sortWithinPartitions("dim", "q", "part", "role")
    found = materialize(both.mapInArrow(lambda it: _search(it, k, grids), _FOUND), "found")
    discard(cells, queries)

    limit = found.where("rid < 0").groupBy("qid").agg(F.element_at(F.sort_array(F.flatten(F.collect_list("top"))), k).alias("limit"))
    left = found.where("rid >= 0").select("qid", "rid", "low").join(limit, "qid").where("low <= limit")
    left = materialize(left.select("qid", "rid", "low", F.row_number().over(W.partitionBy("qid").orderBy("low", "rid")).alias("place")), "left")
    discard(found)

    def read(pairs: DataFrame) -> DataFrame:
        asking = exact.where("asks").select(F.col("rid").alias("qid"), "vec_id", F.col("v").alias("q"))
        with_v = pairs.select("qid", "rid").join(exact.select("rid", F.col("vec_id").alias("neighbor_id"), "v"), "rid")
        return with_v.join(asking, "qid").select("qid", "vec_id", "q", "neighbor_id", "v").mapInArrow(_distances, "qid long, vec_id long, neighbor_id long, distance double")

    nearest = materialize(read(left.where(F.col("place") <= max(STEP, k))), "nearest")
    kth = F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1))
    certain = nearest.groupBy("qid").agg(F.coalesce(kth, F.lit(float("inf"))).alias("kth"))
    more = left.where(F.col("place") > max(STEP, k)).join(certain, "qid").where(F.col("low") <= F.col("kth") * (1 + 1e-9) + 1e-9)
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "neighbor_id")).alias("rank")
    best = nearest.union(read(more)).select("vec_id", rank, "neighbor_id", "distance").where(F.col("rank") <= k)
    real = lambda c: F.when(F.col(c) != int(_FAR), F.col(c)).alias(c)
    return best.select(real("vec_id"), "rank", real("neighbor_id"), "distance")
