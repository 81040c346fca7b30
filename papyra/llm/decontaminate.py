"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

Texts are lower-cased words. An item of L words is looked for in every window of L words of every document that shares a
shingle (three words; the whole item if it has fewer) with an item of that length: any other window has similarity 0. A
document of fewer words is one window. A window's 64-bit fingerprint is the sign of the sums of its words' hash bits, taken from running sums. Fingerprints are
cut into radius + 1 blocks; two within the radius agree in a block, so looking up each block finds all of them. The radius
of 21 finds 9 in 10 windows at a similarity of 0.5, also those that hold an item cut short; its blocks have three bits at most, lookups would
find more pairs than there are, and so the fingerprints of one length are compared directly. What is
found is verified: weighted Jaccard similarity of the shingle multisets of window and item, a shingle's weight being
log(1 + items / items that have it).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import content_key, discard, fresh, materialize, trimmed

_WORD = re.compile(r"\w+")
SHINGLE = 3
#: Items in one pass over the documents; a larger benchmark takes several.
ITEMS_A_PASS, CHARS_A_PASS = 20_000, 16 << 20
RADIUS = 21
_SLICE_CHARS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int) -> Counter:
    """Of ``n`` words each; of fewer words, all of them are one shingle."""
    n = min(n, len(words)) or 1
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _bits(words: list[str]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1)


def simhash(words: list[str]) -> int:
    return int(_pack(_bits(words).sum(axis=0, keepdims=True))[0]) if words else 0


def _codes(words: np.ndarray) -> np.ndarray:
    """64-bit hash of each column of word numbers."""
    out = np.zeros(words.shape[1], dtype=np.uint64)
    for row in words:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + row + np.uint64(1)
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each lo up to, not including, its hi."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class BlockIndex:
    """All fingerprints within ``radius`` of a query's, by exact lookups of radius + 1 blocks of bits.

    Where blocks are so few bits that lookups would find more pairs than there are, every pair is compared.
    """

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints.astype(np.uint64), radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        self.dense = sum(0.5 ** int(b - a) for a, b in zip(edges, edges[1:])) >= 1
        if self.dense:
            return
        for a, b in zip(edges, edges[1:]):
            shift, mask = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            part = (self.prints >> shift) & mask
            order = np.argsort(part, kind="stable")
            self.blocks.append((shift, mask, part[order], order))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) index pairs, each once."""
        if not len(queries):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self.dense:
            step = max(1, (1 << 20) // max(1, len(self.prints)))
            near = [np.nonzero(np.bitwise_count(queries[i : i + step, None] ^ self.prints) <= self.radius) for i in range(0, len(queries), step)]
            return np.concatenate([q + i * step for i, (q, _) in enumerate(near)]), np.concatenate([p for _, p in near])
        pairs = []
        for shift, mask, values, order in self.blocks:
            q = (queries >> shift) & mask
            lo, hi = np.searchsorted(values, q), np.searchsorted(values, q, side="right")
            n = hi - lo
            at = np.repeat(np.arange(len(q)), n)
            run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = order[np.repeat(lo, n) + run]
            near = np.bitwise_count(queries[at] ^ self.prints[found]) <= self.radius
            pairs.append(at[near] * len(self.prints) + found[near])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.prints), both % len(self.prints)


class Benchmark:
    """Items, ready for search: [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int, threshold: float, document_count: dict | None = None, total: int | None = None) -> None:
        self.threshold = threshold
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.sets = [shingles(w, SHINGLE) for _, w in self.items]
        count = document_count if document_count is not None else Counter(s for x in self.sets for s in x)
        total = total or len(self.items)
        self.weights, self.unknown = {s: math.log1p(total / n) for s, n in count.items()}, math.log1p(total)
        self.mass = [sum(self.weights[s] * n for s, n in x.items()) for x in self.sets]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, x in self.items for w in x}))}
        by_code: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        by_length: dict[int, list[int]] = defaultdict(list)
        weight_of: dict[tuple[int, int], float] = {}
        for k, (_, w) in enumerate(self.items):
            by_length[len(w)].append(k)
            for s in self.sets[k]:
                code = int(_codes(np.array([[self.vocabulary[x]] for x in s], dtype=np.uint64))[0])
                by_code[len(s)][code].add(len(w))
                weight_of[len(s), code] = max(self.weights[s], weight_of.get((len(s), code), 0))
        #: By shingle size and item length: sorted codes of the shingles of items of that length. Codes are hashes: what two shingles share is verified.
        self.codes: dict[int, tuple[np.ndarray, dict[int, np.ndarray]]] = {}
        for n, codes in by_code.items():
            keys = np.array(sorted(codes), dtype=np.uint64)
            lengths = sorted({x for c in codes.values() for x in c})
            self.codes[n] = keys, {x: np.array([x in codes[int(c)] for c in keys]) for x in lengths}
        self.code_weights = {n: np.array([weight_of[n, int(c)] for c in keys]) for n, (keys, _) in self.codes.items()}
        self.masses = np.array(self.mass)
        self.index = {n: (np.array(k), BlockIndex(np.array([simhash(self.items[i][1]) for i in k], dtype=np.uint64), radius)) for n, k in by_length.items()}

    def similarity(self, words: list[str], k: int) -> float:
        """Weighted Jaccard of the shingle multisets of ``words`` and item k."""
        mine, weight, rest = self.sets[k], self.weights, self.unknown
        both, every = 0.0, self.mass[k]
        for s, n in shingles(words, SHINGLE).items():
            w = weight.get(s, rest)
            every += w * n
            if s in mine:
                both += w * min(n, mine[s])
        return both / (every - both) if every > both else 1.0

    def search(self, documents: list[list[str]]) -> list[tuple[int, int, int, float]]:
        """(document, item, first word, similarity): the best window of each pair at or above the threshold, the first of equals."""
        words = [w for d in documents for w in d]
        if not words or not self.items:
            return []
        sizes = np.array([len(d) for d in documents])
        end_of = np.repeat(np.cumsum(sizes), sizes)
        start_of = end_of - np.repeat(sizes, sizes)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        wanted: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        shared: dict[int, np.ndarray] = {}
        for n, (keys, lengths) in self.codes.items():
            if len(words) < n:
                continue
            fine = end_of[: len(ids) - n + 1] >= np.arange(n, len(ids) + 1)
            for i in range(n):
                fine = fine & (ids[i : len(ids) - n + 1 + i] >= 0)
            at = np.flatnonzero(fine)
            code = _codes(np.stack([ids[at + i] for i in range(n)]).astype(np.uint64))
            place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            hit = keys[place] == code
            at, place = at[hit], place[hit]
            gain = np.zeros(len(ids) + 1)
            gain[at + 1] = self.code_weights[n][place]
            shared[n] = np.cumsum(gain)
            for length, has in lengths.items():
                p = at[has[place]]
                if not len(p):
                    continue
                lo = np.maximum(p - length + n, start_of[p])
                hi = np.maximum(np.minimum(p, end_of[p] - length), start_of[p])  # a shorter document is one window
                wanted[length].append((lo, hi + 1))
        starts = {n: np.unique(np.concatenate([_ranges(lo, hi) for lo, hi in m])) for n, m in wanted.items()}
        needed = np.unique(np.concatenate([_ranges(lo, np.minimum(hi + n - 1, end_of[lo])) for n, m in wanted.items() for lo, hi in m])) if wanted else []
        if not len(needed):
            return []
        compact = np.zeros(len(ids) + 1, dtype=np.int64)
        compact[needed] = np.arange(len(needed))
        running = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits([words[i] for i in needed.tolist()]), axis=0, dtype=np.int32)])
        document = np.repeat(np.arange(len(sizes)), sizes)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n, s in starts.items():
            which, index = self.index[n]
            for part in np.array_split(s, max(1, len(s) // 20_000)):
                size = np.minimum(n, end_of[part] - part)
                # Weight of all shingles of items in the window: what it shares with one item is no more.
                most = shared[min(n, SHINGLE)]
                most = most[np.maximum(part + size - min(n, SHINGLE) + 1, part)] - most[part] + 1e-6
                able = most >= self.threshold * self.masses[which].min()
                part, size, most = part[able], size[able], most[able]
                c = compact[part]
                row, found = index.within(_pack(running[c + size] - running[c]))
                able = most[row] >= self.threshold * self.masses[which[found]]
                row, found = row[able], found[able]
                for p, m, k in zip(part[row].tolist(), size[row].tolist(), which[found].tolist()):
                    sim = self.similarity(words[p : p + m], k)
                    key = int(document[p]), k
                    if sim >= self.threshold and (key not in best or (sim, -p) > (best[key][0], -best[key][1])):
                        best[key] = sim, p
        return [(d, k, p - int(start_of[p]), sim) for (d, k), (sim, p) in sorted(best.items())]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text, hash of each different shingle) of items that have words."""
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if w := words_of(t):
                rows.append((i, t, [_shingle_hash(s) for s in shingles(w, SHINGLE)]))
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["item_id", "text", "hashes"])


def _shingle_hash(shingle: tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(shingle).encode("utf-8", "surrogatepass")) - (1 << 63)


def _passes(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], dict[int, int], int]]:
    """(items, in how many items each of their shingles is, all items): a bounded part of the benchmark for each pass over the documents.

    Shingles are counted by a shuffle; the driver holds one part at a time, of ``ITEMS_A_PASS`` items and ``CHARS_A_PASS`` characters.
    """
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where(F.length("text") > 0)
    items = materialize(items.mapInArrow(_listed, "item_id long, text string, hashes array<long>").withColumn("n", F.monotonically_increasing_id()), "items")
    total = items.count()
    each = items.select("n", F.explode("hashes").alias("h"))
    seen = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "h").groupBy("n").agg(F.collect_list(F.struct("h", "df")).alias("seen"))
    rows = items.select("n", "item_id", "text").join(seen, "n", "left").orderBy("item_id", "text", "n")
    part: list[tuple[int, str]] = []
    count: dict[int, int] = {}
    size = 0
    for r in rows.select("item_id", "text", "seen").toLocalIterator():
        part.append((r.item_id, r.text))
        count.update((h, df) for h, df in r.seen or ())
        size += len(r.text)
        if len(part) == ITEMS_A_PASS or size >= CHARS_A_PASS:
            yield part, count, total
            part, count, size = [], {}, 0
    if part:
        yield part, count, total
    discard(items)


_ready: dict[str, Benchmark] = {}


def _bench(name: str, shared, radius: int, threshold: float) -> Benchmark:
    """A worker makes the search structures of a part once, and keeps those of the last part."""
    if name not in _ready:
        _ready.clear()
        part, count, total = shared.value
        own = {s: count.get(_shingle_hash(s), 1) for _, t in part for s in shingles(words_of(t), SHINGLE)}
        _ready[name] = Benchmark(part, radius, threshold, own, total)
    return _ready[name]


def _checked(radius: int, threshold: float) -> None:
    if not 0 < threshold <= 1 or not 0 <= radius <= 64:
        raise ValueError("threshold must be in (0, 1], radius in [0, 64]")


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("first_word", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, key, item_id, first_word, similarity): each document and item of ``benchmark`` (item_id, text) whose best
    window reaches ``threshold``; ``key`` is the content key of the row, which tells apart rows of one doc_id.

    Null and empty texts on either side match nothing; an empty table on either side gives an empty table. Equal
    similarities: the first window. Repeated documents and repeated items are reported each by itself. A null doc_id or
    item_id is reported as null. Other columns are not read. Texts are searched whole, whatever their length. A benchmark of more than
    ``ITEMS_A_PASS`` items or ``CHARS_A_PASS`` characters takes several passes over the documents, each with its share of items and words.
    """
    _checked(radius, threshold)
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), content_key(docs["doc_id"], text).alias("key"), text.alias("text")).where(F.length("text") > 0)
    found = None
    for part in _passes(benchmark):
        shared = spark.sparkContext.broadcast(part)  # bounded by ITEMS_A_PASS and CHARS_A_PASS
        leaks = some.mapInArrow(lambda it, s=shared, name=uuid.uuid4().hex: trimmed(_search(it, name, s, radius, threshold)), _FOUND)
        found = leaks if found is None else found.union(leaks)
    return spark.createDataFrame([], _FOUND) if found is None else found


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(first text, words of each) of texts that have some ``_SLICE_CHARS`` characters together."""
    at, docs, size = 0, [], 0
    for i, t in enumerate(texts):
        docs.append(words_of(t))
        size += len(t or "")
        if size >= _SLICE_CHARS:
            yield at, docs
            at, docs, size = i + 1, [], 0
    if docs:
        yield at, docs


def _search(batches: Iterator[pa.RecordBatch], name: str, shared, radius: int, threshold: float) -> Iterator[pa.RecordBatch]:
    bench = _bench(name, shared, radius, threshold)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, docs in _slices(batch.column(2).to_pylist()):
            rows = [(ids[at + d], keys[at + d], bench.items[k][0], p, sim) for d, k, p, sim in bench.search(docs)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_FOUND.names)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows in which ``find_leaks`` finds an item; columns unchanged, cases as there. Rows are judged where they are."""
    _checked(radius, threshold)
    columns, schema, left = docs.columns, docs.schema, docs
    text = fresh(docs, "__text")
    for part in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            bench = _bench(name, shared, radius, threshold)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for at, docs in _slices(batch.column(batch.num_columns - 1).to_pylist()):
                    keep[[at + d for d, _, _, _ in bench.search(docs)]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        whole = left.select(*[F.col(f"`{c}`") for c in columns], left["text"].cast("string").alias(text))
        left = whole.mapInArrow(lambda it, run=run: trimmed(run(it)), schema)
    return left
