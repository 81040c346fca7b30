"""N-gram Jaccard join with rare-first prefix filtering.

Each text is its set of word n-grams, as 54-bit hashes. Document frequencies of all n-grams come from one shuffle of
packed hashes. An n-gram of frequency 1 matches nothing, so only the repeated ones go back to their documents, where
frequency, then hash, puts them in order, rarest first; those of frequency 1 come before and only move the positions.
Texts of one set are joined as one. The prefix of a set of s n-grams is its first s - ceil(t s) + 1; two sets of
similarity t share one of both prefixes. The join on those passes the length filter (t times the larger size at most the
smaller one), the positional filter (the n-grams after the shared one suffice for the needed overlap) and the suffix filter (what the two
suffixes after the shared n-gram have in common is at most the sum, over eight ranges of hashes, of the smaller counts); each
pair that is left is verified once by its exact overlap. Sets of one cluster are verified together, in cells of two blocks of members
each, so that no task holds a whole cluster. N-grams are equal if their 54-bit hashes are;
among 2**27 different ones about one pair is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import content_key, discard, fresh, id_order, materialize, small_batches, trimmed, whole_groups
from papyra.llm.components import components

_WORD = re.compile(r"\w+")
_DOC_BITS = 10
_LOW = np.uint64((1 << _DOC_BITS) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHARS = 4 << 20
#: Words whose hashes a task remembers: some 18 MB.
_KNOWN = 1 << 17
#: Cells of the matrix that overlaps are counted in: 4 bytes each.
_DENSE = 1 << 22
#: Members of a cluster in one block of the verification.
_BLOCK = 256
_PACKED = "bucket int, batch long, grams binary, df binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """Hashes of the n-grams of a text, with repeats; of fewer than n words, of all of them as one."""
    get = known.get
    h = [get(w) for w in words]
    if None in h:
        for i, w in enumerate(words):
            if h[i] is None:
                h[i] = known[w] = xxhash.xxh3_64_intdigest(w)
    a = np.array(h, dtype=np.uint64)
    size = max(1, len(a) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(min(n, len(a))):
        out = _mixed(out * _MULTIPLIER + a[i : i + size])
    return out


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "batch", "grams", "df"])


_DOC = np.dtype([("o", "<i8"), ("k", "<i8"), ("size", "<i8"), ("d1", "<u8"), ("d2", "<u8")])


def _grams(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For up to 1,024 documents at a time: a row with the documents (bucket -1), and one for each bucket of hashes, sorted."""
    known: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32
    find = _WORD.findall

    def flush(docs: list[tuple[int, int]], parts: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal number
        count = np.array([len(p) for p in parts])
        keys = np.concatenate(parts) & ~_LOW | np.repeat(np.arange(len(parts), dtype=np.uint64), count)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        who = (keys & _LOW).astype(np.int64)
        table = np.zeros(len(docs), dtype=_DOC)
        table["o"], table["k"] = zip(*docs)
        table["size"] = np.bincount(who, minlength=len(docs))
        value = keys >> np.uint64(_DOC_BITS)
        np.add.at(table["d1"], who, _mixed(value))
        np.add.at(table["d2"], who, _mixed(value * _MULTIPLIER + np.uint64(1)))
        edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edges = [*edges.tolist(), len(keys)]
        rows = [(-1, number, table.tobytes(), None)]
        rows += [(i, number, _planes(keys[a:b]), None) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        number += 1
        return _packed(rows)

    docs, parts, size = [], [], 0
    for batch in batches:
        for o, k, t in zip(*(c.to_pylist() for c in batch.columns)):
            words = find(t.lower())
            if not words:
                continue
            docs.append((o, k))
            parts.append(gram_hashes(words, n, known))
            size += len(t)
            if len(docs) == 1 << _DOC_BITS or size >= _CHARS:
                yield flush(docs, parts)
                docs, parts, size = [], [], 0
            if len(known) > _KNOWN:
                known.clear()
    if docs:
        yield flush(docs, parts)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's buckets the hashes that occur at least twice, by batch, with their frequency; documents as they come. Buckets wait packed and
    are unpacked one at a time: equal hashes are of one bucket."""
    held: dict[int, tuple[list[int], list[bytes]]] = {}
    for batch in batches:
        for bucket, number, grams, _ in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket < 0:
                yield _packed([(bucket, number, grams, None)])
            else:
                numbers, blobs = held.setdefault(bucket, ([], []))
                numbers.append(number)
                blobs.append(grams)
    for bucket in list(held):
        yield from _repeated_in(*held.pop(bucket))


def _repeated_in(numbers: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The hashes of one bucket that occur at least twice."""
    keys = np.concatenate([_unplanes(b, "<u8") for b in blobs])
    source = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b) // keys.itemsize for b in blobs])
    blobs.clear()
    value = keys >> np.uint64(_DOC_BITS)
    order = np.argsort(value)
    value = value[order]
    heads = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    del value
    df = np.diff(np.concatenate([heads, [len(order)]]))
    df = np.repeat(df, df)
    keep = df > 1
    order, df = order[keep], df[keep].astype("<u4")
    of = np.array(numbers, dtype=np.int64)[source[order]]
    by = np.argsort(of, kind="stable")
    keys, df, of = keys[order[by]], df[by], of[by]
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
    for i in range(0, len(cuts), 64):
        yield _packed([(0, int(of[a]), _planes(keys[a:b]), _planes(df[a:b])) for a, b in zip(cuts[i : i + 64], [*cuts[1:], len(of)][i : i + 64])])


_SETS = "o long, k long, size int, common int, grams binary"


def _sets(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Sets whose prefix has a repeated n-gram: the repeated n-grams, rarest first. Rows with bucket -2 name documents to leave out."""
    for table in whole_groups(batches, 1):
        bucket, number = table.column(0).to_numpy(), table.column(1).to_numpy()
        out: list[tuple] = []
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])).tolist()
        for a, b in zip(starts, [*starts[1:], len(number)]):
            grams, dfs = table.column(2)[a:b].to_pylist(), table.column(3)[a:b].to_pylist()
            kinds = bucket[a:b]
            docs = np.frombuffer(grams[int(np.flatnonzero(kinds == -1)[0])], dtype=_DOC)
            drop = np.zeros(len(docs), dtype=bool)
            for i in np.flatnonzero(kinds == -2):
                drop[np.frombuffer(grams[i], dtype="<i4")] = True
            at = np.flatnonzero(kinds == 0)
            if not len(at):
                continue
            keys = np.concatenate([_unplanes(grams[i], "<u8") for i in at])
            df = np.concatenate([_unplanes(dfs[i], "<u4") for i in at])
            who = (keys & _LOW).astype(np.int64)
            common = np.bincount(who, minlength=len(docs))
            least = np.ceil(t * docs["size"] - 1e-9).astype(np.int64)
            fine = ~drop & (common >= least)
            keep = fine[who]
            keys, df, who = keys[keep], df[keep], who[keep]
            order = np.lexsort((keys, df, who))
            keys, who = keys[order] >> np.uint64(_DOC_BITS), who[order]
            ends = np.searchsorted(who, np.arange(len(docs) + 1)).tolist()
            for d in np.flatnonzero(fine).tolist():
                s = docs[d]
                out.append((int(s["o"]), int(s["k"]), int(s["size"]), int(common[d]), keys[ends[d] : ends[d + 1]].astype("<u8").tobytes()))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["o", "k", "size", "common", "grams"])


def _suffixes(grams: np.ndarray, whole: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For the first n[i] of each set's whole[i] n-grams: how many of those after it lie in each of eight ranges, a byte each, at most 255."""
    begin = np.cumsum(whole) - whole
    ones = np.zeros((len(grams) + 1, 8), dtype=np.int32)
    ones[np.arange(1, len(grams) + 1), (grams >> (64 - _DOC_BITS - 3)).astype(np.int64)] = 1
    np.cumsum(ones, axis=0, out=ones)
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = np.minimum(ones[np.repeat(begin + whole, n)] - ones[at + 1], 255)
    return np.ascontiguousarray(left.astype(np.uint8)).view("<i8").reshape(-1)


def _prefixes(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """(gram, id, size, pos, suffix) for the repeated n-grams of each prefix; pos counts from 0 in the whole set."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            ids, sizes, common = (batch.column(i).to_numpy() for i in range(3))
            length = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
            once = sizes - common
            n = np.clip(length - once, 0, common).astype(np.int64)
            every = [np.frombuffer(g, dtype="<i8") for g in batch.column(3).to_pylist()]
            grams = [g[:m] for g, m in zip(every, n.tolist())]
            pos = np.repeat(once, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            suffix = _suffixes(np.concatenate(every), common.astype(np.int64), n) if every else np.zeros(0, "<i8")
            columns = (np.concatenate(grams) if grams else np.zeros(0, "<i8"), np.repeat(ids, n), np.repeat(sizes, n).astype(np.int32), pos.astype(np.int32), suffix)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "id", "size", "pos", "suffix"])


def _overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[i] and y[i]."""
    out = np.zeros(len(x), dtype=np.int64)
    block = 256
    where = (x // block) * (len(sets) // block + 1) + y // block
    for b in np.unique(where):
        at = np.flatnonzero(where == b)
        members, local = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        flat = np.concatenate([sets[m] for m in members])
        values, column = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
        lx, ly = local[: len(at)], local[len(at) :]
        step = max(1, _DENSE // len(members))
        for c in range(0, len(values), step):
            own = (column >= c) & (column < c + step)
            dense = np.zeros((len(members), min(step, len(values) - c)), dtype=np.float32)
            dense[row[own], column[own] - c] = 1
            out[at] += (dense @ dense.T)[lx, ly].astype(np.int64)
    return out


def _verified(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """(x, y, jaccard) of pairs at or above t; rows sorted by cell, its sets (y null) and its pairs."""
    for table in whole_groups(batches, 0):
        cell = table.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
        found = []
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            part = table.slice(a, b - a)
            is_set = pc.is_null(part.column(2))
            s, p = part.filter(is_set), part.filter(pc.invert(is_set))
            ids = s.column(1).to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            sizes = s.column(3).to_numpy().astype(np.int64)[order]
            blobs = s.column(4).to_pylist()
            sets = [np.frombuffer(blobs[i], dtype="<u8") for i in order]
            x, y = np.searchsorted(ids, p.column(1).to_numpy()), np.searchsorted(ids, p.column(2).to_numpy())
            over = _overlaps(sets, x, y)
            good = over >= np.ceil(t / (1 + t) * (sizes[x] + sizes[y]) - 1e-9)
            x, y, over = x[good], y[good], over[good]
            found.append((ids[x], ids[y], over / (sizes[x] + sizes[y] - over)))
        columns = [np.concatenate(c) for c in zip(*found)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "jaccard"])


def similar_sets(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, sets, same): pairs (x, y, jaccard) of sets, sets (id, o, k) with each set's first document, and same
    (o, k, first_o, first_k) for the further documents of one set."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1], n at least 1")
    with small_batches(docs.sparkSession):  # all steps in Python run in here
        return _similar_sets(docs, n, threshold)


def _similar_sets(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, math.ceil(math.log2(4 * parts)))
    text = docs["text"].cast("string")
    some = docs.select(id_order(docs["doc_id"]).alias("o"), content_key(docs["doc_id"], text).alias("k"), text.alias("text")).where(F.length("text") > 0)
    packed = some.mapInArrow(lambda it: trimmed(_grams(it, n, bits)), _PACKED).repartition(parts, "bucket", F.when(F.col("bucket") < 0, F.col("batch")))
    packed = materialize(packed.mapInArrow(lambda it: trimmed(_repeated(it)), _PACKED), "grams")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = np.frombuffer(blob, dtype=_DOC)
                columns = [np.full(len(d), number), np.arange(len(d), dtype=np.int32), *(np.ascontiguousarray(d[c]).view("<i8") for c in _DOC.names)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["batch", "doc", *_DOC.names])

    found = packed.where("bucket = -1").select("batch", "grams").mapInArrow(lambda it: trimmed(unpack(it)), "batch long, doc int, o long, k long, size long, d1 long, d2 long")
    alike = found.groupBy("d1", "d2", "size").agg(F.min(F.struct("o", "k", "batch", "doc")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = materialize(found.join(alike, ["d1", "d2", "size"]).where(F.struct("o", "k", "batch", "doc") != F.col("f")).select("batch", "doc", "o", "k", F.col("f.o").alias("first_o"), F.col("f.k").alias("first_k")), "same")
    leave = later.groupBy("batch").agg(F.collect_list("doc").alias("docs"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed([(-2, b, np.array(d, dtype="<i4").tobytes(), None) for b, d in zip(*(c.to_pylist() for c in batch.columns))])

    ordered = packed.unionByName(leave.mapInArrow(lambda it: trimmed(names(it)), _PACKED)).repartition("batch").sortWithinPartitions("batch", "bucket")
    sets = materialize(ordered.mapInArrow(lambda it: trimmed(_sets(it, t)), _SETS).withColumn("id", F.monotonically_increasing_id()), "sets")
    discard(packed)
    prefixes = sets.select("id", "size", "common", "grams").mapInArrow(lambda it: trimmed(_prefixes(it, t)), "gram long, id long, size int, pos int, suffix long")
    prefixes = materialize(prefixes, "prefixes")
    a, b = (prefixes.select("gram", *[F.col(c).alias(c + s) for c in ("id", "size", "pos", "suffix")]) for s in ("1", "2"))
    need = F.ceil(t / (1 + t) * (F.col("size1") + F.col("size2")) - 1e-9)
    left = F.least(F.col("size1") - F.col("pos1"), F.col("size2") - F.col("pos2"))
    byte = lambda c, i: F.shiftrightunsigned(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    after = F.lit(1)
    for i in range(8):  # a byte of 255 says 255 or more
        u, v = byte("suffix1", i), byte("suffix2", i)
        after = after + F.least(u, v) + F.when(F.least(u, v) == 255, F.least("size1", "size2")).otherwise(0)
    longer, shorter = F.greatest("size1", "size2"), F.least("size1", "size2")
    pairs = a.join(b, "gram").where((F.col("id1") < F.col("id2")) & (shorter >= longer * t - 1e-9) & (left >= need) & (after >= need))
    pairs = materialize(pairs.select(F.col("id1").alias("x"), F.col("id2").alias("y")).distinct(), "candidates")
    discard(prefixes)

    # A pair is verified with the least partner of its smaller set, so that sets of one cluster meet; blocks of its members keep cells small.
    lead = pairs.groupBy(F.col("y").alias("x")).agg(F.min("x").alias("g"))
    placed = materialize(pairs.join(lead, "x", "left").select(F.coalesce("g", "x").alias("g"), "x", "y"), "placed")
    discard(pairs)
    members = placed.select("g", F.col("x").alias("id")).union(placed.select("g", F.col("y").alias("id"))).distinct()
    blocks = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    cells = placed.join(blocks, "g").select(F.xxhash64("g", block("x"), block("y")).alias("cell"), "x", "y")
    needs = cells.select("cell", F.col("x").alias("id")).union(cells.select("cell", F.col("y").alias("id"))).distinct()
    rows = needs.join(sets, "id").select("cell", F.col("id").alias("x"), F.lit(None).cast("long").alias("y"), "size", "grams")
    rows = rows.unionByName(cells, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell")
    good = materialize(rows.mapInArrow(lambda it: trimmed(_verified(it, t)), "x long, y long, jaccard double"), "pairs")
    named = materialize(sets.select("id", "o", "k"), "named")
    discard(placed, sets)
    return good, named, later.select("o", "k", "first_o", "first_k")


def _classes(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(o, k, first): each set that has a pair, and the first document of all sets that it is connected with."""
    joined = components(pairs.select("x", "y"))
    named = joined.union(joined.select("b", "b").distinct()).join(sets.toDF("a", "o", "k"), "a")
    return named.join(named.groupBy("b").agg(F.min(F.struct("o", "k")).alias("first")), "b").select("o", "k", "first")


def _id(column: str):
    return F.when(F.col(column) != 2**63 - 1, F.col(column))


def _copies(same: DataFrame) -> DataFrame:
    """Further documents of one set; rows that repeat the first document's doc_id and text are that document."""
    return same.where((F.col("o") != F.col("first_o")) | (F.col("k") != F.col("first_k"))).distinct()


def jaccard_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of different sets of word n-grams with Jaccard similarity >= ``threshold``, each set by its
    first document, and (first document, further document, 1.0) for the documents of one set, which are not expanded into all pairs.

    Words are runs of letters, digits and underscores of the lower-cased text. A text of fewer than n words is one n-gram; one of
    none (null, empty, punctuation) is in no pair. Rows that repeat doc_id and text are one document. Rows of one doc_id
    and different texts pair like others, with doc_a = doc_b. A null doc_id comes last, and out as null. Other columns
    are not read. Texts are read whole, whatever their length. An empty table gives an empty table. doc_a comes before doc_b.
    """
    pairs, sets, same = similar_sets(docs, n, threshold)
    within = _copies(same).select(F.col("first_o").alias("oa"), F.col("o").alias("ob"), F.lit(1.0).alias("jaccard"))
    names = sets.select("id", "o")
    across = pairs.join(names.toDF("x", "oa"), "x").join(names.toDF("y", "ob"), "y").select("oa", "ob", "jaccard")
    found = within.union(across).select(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"), "jaccard")
    return found.select(_id("a").alias("doc_a"), _id("b").alias("doc_b"), "jaccard")


def jaccard_classes(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each row of ``docs``.

    ``n_links``: the other documents whose similarity with this one is at least ``threshold``, copies counted each. ``class_id``: the
    first doc_id of all documents that links connect with this one; its own if it has none. Cases as in ``jaccard_pairs``: a text
    without words has no link; rows that repeat doc_id and text are one document and get the same values; a null doc_id comes last, and
    out as null, as class_id too. An empty table gives an empty table.
    """
    pairs, sets, same = similar_sets(docs, n, threshold)
    copies = _copies(same)
    more = copies.groupBy(F.col("first_o").alias("o"), F.col("first_k").alias("k")).agg(F.count(F.lit(1)).alias("more"))
    weight = sets.join(more, ["o", "k"], "left").select("id", F.coalesce("more", F.lit(0)).alias("more"))
    both = pairs.select("x", "y").union(pairs.select("y", "x"))
    links = both.join(weight.toDF("y", "more"), "y").groupBy(F.col("x").alias("id")).agg(F.sum(F.col("more") + 1).alias("links")).join(sets, "id")
    linked = links.join(_classes(pairs, sets), ["o", "k"]).select("o", "k", "links", F.col("first.o").alias("c"))
    linked = linked.join(more, ["o", "k"], "full").select("o", "k", F.coalesce("c", "o").alias("c"), (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
    linked = materialize(linked, "linked")
    first = linked.select(F.col("o").alias("first_o"), F.col("k").alias("first_k"), "c", "n")
    every = linked.union(copies.join(first, ["first_o", "first_k"]).select("o", "k", "c", "n"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), id_order(docs["doc_id"]).alias("o"), content_key(docs["doc_id"], docs["text"].cast("string")).alias("k"))
    found = rows.join(every, ["o", "k"], "left").select("doc_id", F.coalesce("c", "o").alias("c"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    return found.select("doc_id", _id("c").alias("class_id"), "n_links")


def drop_similar(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """``docs`` with one document of each group that ``jaccard_pairs`` connects: the first by doc_id.

    Cases as there; rows that repeat a document that stays, stay with it. Columns unchanged.
    """
    pairs, sets, same = similar_sets(docs, n, threshold)
    gone = _classes(pairs, sets).where(F.struct("o", "k") != F.col("first")).select("o", "k")
    gone = gone.union(_copies(same).select("o", "k"))
    o, k = fresh(docs, "__order"), fresh(docs, "__key")
    gone = materialize(gone, "gone").toDF(o, k)
    text = docs["text"].cast("string")
    kept = docs.withColumns({o: id_order(docs["doc_id"]), k: content_key(docs["doc_id"], text)}).join(gone.hint("shuffle_hash"), [o, k], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
