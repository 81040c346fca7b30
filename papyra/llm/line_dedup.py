"""Removal of repeated line runs, by a suffix array over line ids built with distributed prefix doubling.

A *line* here ends at a newline, after a full stop, exclamation or question mark, or before a capital letter that
follows white space; so a passage pasted into the middle of a physical line still starts and ends at line borders.
Lines are compared without outer white space; blank ones are not part of the sequence and stay with the line before.

The sequence of a document's line ids has one suffix per line. Depth doubles from 1: at depth 2d a suffix is ranked by
its rank at depth d and the rank of the suffix d lines on. Suffixes that are alone at some depth leave, as their longest
common prefix with any neighbour is known to be shorter; what stays at each depth is the suffix array, cut to groups of
at least two. The suffixes that share their first m lines are an interval of that array whose longest common prefix is
at least m; two overlapping ranks of depth 2**floor(log2 m) name it. A repeated run counts from ``min_words`` words on.
Each line of such a run lies in a shortest qualifying piece of it that starts or ends at that line, and this piece is
an interval of depth m <= min_words, so doubling ends once 2d exceeds the largest m: greater depths only join
pieces that are already known, and the union of the pieces is the union of the maximal runs.

What is shuffled are packed arrays. A batch of documents asks about its distinct line ids, pairs of ranks and names of
intervals, each in the range of the suffix array (or hash range) it belongs to; the answers come back in the order of
the questions: whether a line repeats, the rank of a pair, whether a name's first occurrence is here. A task of each of
these steps gives its memory back when it is over: one executor has up to four workers, for two such steps in a stage.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import content_key, discard, fresh, id_order, materialize, trimmed, whole_groups

_UPPER = "".join(map(re.escape, (chr(c) for c in range(0x10000) if chr(c).isupper())))
_BORDER = re.compile(rf"\s(?:(?<=\n)|(?<=[.!?]\s)|(?=[{_UPPER}]))")

def split_lines(text: str) -> list[tuple[int, int]]:
    """Spans of the lines of ``text``, each with the white space after it; together they are the whole text."""
    cuts = [0]
    for m in _BORDER.finditer(text):
        cuts.append(m.end())
    cuts.append(len(text))
    spans: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        if spans and not text[a:b].strip():
            spans[-1] = (spans[-1][0], b)
        elif spans and not text[spans[-1][0] : spans[-1][1]].strip():
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


def _line_texts(text: str) -> list[str]:
    """What ``split_lines`` finds, stripped; nothing for a blank text. The same order and number."""
    return [s for s in map(str.strip, _BORDER.split(text)) if s]


#: Rows of packed arrays: kind 0 is a batch's own state, -1 the documents it leaves out, 9 what it cuts; from 1 on questions or answers.
_ROWS = "batch long, kind int, bucket int, data binary"
_DOCS, _CHARS = 4096, 16 << 20
#: Of the digest that tells texts apart.
_OWNER_BYTES = 8


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["batch", "kind", "bucket", "data"])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each of some sorted rows differs from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    if len(new):
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of a sorted array."""
    at = np.flatnonzero(_heads(bucket)).tolist()
    for a, b in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[a]), a, b


def _lines(batches: Iterator[pa.RecordBatch], min_words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A batch's state (documents, line ids, words a line up to ``min_words``) and its distinct line ids, each with a text that has it."""
    digest, whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
    number = TaskContext.get().partitionId() << 32
    docs: list[tuple[int, int, int]] = []
    counts: list[int] = []
    hashes: list[int] = []
    words: list[int] = []
    size = 0

    def flush() -> pa.RecordBatch:
        n = np.array(counts, dtype=np.int64)
        h = np.array(hashes, dtype=np.uint64)
        o, k = (np.array([d[i] for d in docs], dtype=np.int64) for i in (0, 1))
        t1, t2 = (np.array([d[2] >> s & 0xFFFFFFFFFFFFFFFF for d in docs], dtype=np.uint64) for s in (0, 64))
        state = (o, k, t1, t2, n.astype(np.int32), h, np.array(words, dtype=np.uint16))
        doc = np.repeat(np.arange(len(n)), n)
        owner = (t1 & np.uint64((1 << 8 * _OWNER_BYTES) - 1))[doc]
        order = np.lexsort((doc, owner, h))
        sh, so, sd = h[order], owner[order], doc[order]
        head = _heads(sh)
        inside = ~head & ~_heads(sd)  # twice in one text
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(sh)) - 1
        sure = (so[first] != so[last]) | np.logical_or.reduceat(inside, first) if len(first) else np.zeros(0, dtype=bool)
        uh, uo = sh[first], so[first]
        rows = [(number, 0, -1, pickle.dumps(state))]
        for bucket, a, b in _by_bucket(uh >> np.uint64(64 - bits)):
            planes = uo[a:b].view(np.uint8).reshape(-1, 8)[:, :_OWNER_BYTES].copy()
            rows.append((number, 1, bucket, pickle.dumps((uh[a:b], planes, np.packbits(sure[a:b])))))
        return _rows(rows)

    for batch in batches:
        for o, k, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = _line_texts(text)
            if not lines:
                continue
            docs.append((o, k, whole(text)))
            counts.append(len(lines))
            hashes += map(digest, lines)
            words += [min(min_words, len(x.split())) for x in lines]
            size += len(text)
            if len(docs) == _DOCS or size >= _CHARS:
                yield flush()
                number += 1
                docs, counts, hashes, words, size = [], [], [], [], 0
    if docs:
        yield flush()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each question about line ids, bits: is it in two texts, or twice in one? Other rows as they come."""
    asked: list[tuple] = []
    h, owner, sure = [], [], []
    for batch in batches:
        for number, kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
            if kind != 1:
                yield _rows([(number, kind, bucket, data)])
                continue
            ids, planes, flags = pickle.loads(data)
            wide = np.zeros((len(ids), 8), dtype=np.uint8)
            wide[:, :_OWNER_BYTES] = planes
            h.append(ids)
            owner.append(wide.view(np.uint64).reshape(-1))
            sure.append(np.unpackbits(flags, count=len(ids)).astype(bool))
            asked.append((number, bucket, len(ids)))
    if not asked:
        return
    ids, owners, known = np.concatenate(h), np.concatenate(owner), np.concatenate(sure)
    del h, owner, sure
    order = np.lexsort((owners, ids))
    first = np.flatnonzero(_heads(ids[order]))
    so = owners[order]
    last = np.append(first[1:], len(so)) - 1
    often = (so[first] != so[last]) | np.logical_or.reduceat(known[order], first)
    found = np.empty(len(ids), dtype=bool)
    found[order] = np.repeat(often, np.diff(np.append(first, len(so))))
    at = 0
    for number, bucket, n in asked:
        yield _rows([(number, 1, bucket, pickle.dumps(np.packbits(found[at : at + n])))])
        at += n


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, bytes]]]]]:
    """(batch, its rows by kind: (bucket, data)) of rows sorted by batch, kind and bucket."""
    for table in whole_groups(batches, 0):
        columns = [c.to_pylist() for c in table.columns]
        found: dict[int, list[tuple[int, bytes]]] = {}
        now = None
        for number, kind, bucket, data in zip(*columns):
            if number != now and found:
                yield now, found
                found = {}
            now = number
            found.setdefault(kind, []).append((bucket, data))
        if found:
            yield now, found


def _stretches(batches: Iterator[pa.RecordBatch], min_words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """States (o, k, document, line, rank, pieces) of the lines that lie in a stretch of repeated lines of ``min_words`` words, and its pieces (document, first line, lines): from
    a line on, and up to a line, as few lines as reach so many words. A row's bucket is the most lines of a piece."""
    for number, rows in _grouped(batches):
        o, k, _, _, n, h, w = pickle.loads(rows[0][0][1])
        drop = np.zeros(len(n), dtype=bool)
        for _, data in rows.get(-1, []):
            drop[pickle.loads(data)] = True
        uh, inverse = np.unique(h, return_inverse=True)
        flags = _unpacked([pickle.loads(data) for _, data in rows[1]], _sizes_of(uh >> np.uint64(64 - bits)))
        doc = np.repeat(np.arange(len(n)), n)
        start = np.repeat(np.cumsum(n) - n, n)
        good = flags[inverse] & ~drop[doc]
        head = _heads(doc, good)
        first = np.flatnonzero(head)
        if not len(first):
            continue
        length = np.diff(np.append(first, len(doc)))
        words = w.astype(np.int64)
        enough = np.repeat(np.add.reduceat(words, first) >= min_words, length) & good
        if not enough.any():
            continue
        lo, hi = np.repeat(first, length), np.repeat(first + length, length)
        i = np.arange(len(doc))
        upto = np.concatenate([[0], np.cumsum(words)])
        to = np.searchsorted(upto, upto[:-1] + min_words)
        since = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
        ahead = np.where(to <= hi, to - i, 0)
        back = np.where((since >= lo) & (upto[1:] >= min_words), i + 1 - since, 0)
        kept = np.flatnonzero(enough)
        d, p, a, b = doc[kept], (i - start)[kept], ahead[kept], back[kept]
        piece = np.concatenate([np.stack([d, p, a])[:, a > 0], np.stack([d, p - b + 1, b])[:, b > 0]], axis=1)
        piece = piece[:, np.lexsort(piece[::-1])]
        piece = piece[:, _heads(*piece)].astype(np.int32)
        yield _rows([(number, 0, int(piece[2].max()), pickle.dumps((o, k, d.astype(np.int32), p.astype(np.int32), h[kept], piece)))])


def _find(key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in a sorted array, -1 for none."""
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return np.where(key[at] == wanted, at, -1)


def _mixed(m: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    x = (ra * np.uint64(0x9E3779B97F4A7C15) ^ rb) * np.uint64(0xBF58476D1CE4E5B9) + m.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Questions:
    """What the lines of a batch ask at a depth: ``names`` (m, ra, rb) of intervals with the batch's first occurrence of each, and ``pairs`` of ranks."""

    def __init__(self, state: tuple, depth: int, bits: int) -> None:
        self.o, self.k, self.doc, self.pos, self.rank, pieces = state
        step = 1 << depth
        key = self.doc.astype(np.int64) << 32 | self.pos
        shift = np.uint64(64 - bits)
        d, start, m = pieces[:, (pieces[2] >= step) & (pieces[2] < 2 * step)].astype(np.int64)
        at, to = (_find(key, d << 32 | x) for x in (start, start + m - step)) if len(d) else (d, d)
        fine = (at >= 0) & (to >= 0)
        d, start, m, at, to = (x[fine] for x in (d, start, m, at, to))
        ra, rb = self.rank[at], self.rank[to]
        place = np.empty(len(self.o), dtype=np.int64)
        place[np.lexsort((self.k, self.o))] = np.arange(len(self.o))
        bucket = _mixed(m, ra, rb) >> shift
        order = np.lexsort((start, place[d], m, rb, ra, bucket))
        self.d, self.start, self.m, self.ra, self.rb, self.bucket = (x[order] for x in (d, start, m, ra, rb, bucket))
        self.first = _heads(self.bucket, self.ra, self.rb, self.m)
        after = _find(key, key + step)
        self.alive = np.flatnonzero(after >= 0)
        r1, r2 = self.rank[self.alive], self.rank[after[self.alive]]
        self.order = np.lexsort((r2, r1))
        r1, r2 = r1[self.order], r2[self.order]
        self.pair_head = _heads(r1, r2)
        at = np.flatnonzero(self.pair_head)
        self.r1, self.r2 = r1[at], r2[at]
        self.often = np.diff(np.append(at, len(r1))) > 1
        self.pair_bucket = self.r1 >> shift


def _ask(batches: Iterator[pa.RecordBatch], depth: int, bits: int, last: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            q = _Questions(pickle.loads(data), depth, bits)
            f = np.flatnonzero(q.first)
            d = q.d[f]
            names = (q.m[f].astype(np.uint16), q.ra[f], q.rb[f], q.o[d], q.k[d], q.start[f].astype(np.int32))
            rows = [(number, 1, bucket, pickle.dumps(tuple(x[a:b] for x in names))) for bucket, a, b in _by_bucket(q.bucket[f])]
            if not last:
                rows += [(number, 2, bucket, pickle.dumps((q.r1[a:b], q.r2[a:b], np.packbits(q.often[a:b])))) for bucket, a, b in _by_bucket(q.pair_bucket)]
            yield _rows(rows)


def _answer(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """To names: bits, is the first occurrence of all this batch's? To pairs: their ranks in the suffix array, 0 for those that occur once."""
    asked: dict[int, list[tuple[int, int, int]]] = {1: [], 2: []}
    parts: dict[int, list[tuple]] = {1: [], 2: []}
    for batch in batches:
        for number, kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
            found = pickle.loads(data)
            asked[kind].append((number, bucket, len(found[0])))
            parts[kind].append(found if kind == 1 else (found[0], found[1], np.unpackbits(found[2], count=len(found[0])).astype(bool)))
    if asked[1]:
        m, ra, rb, o, k, start = (np.concatenate(c) for c in zip(*parts[1]))
        order = np.lexsort((start, k, o, m, rb, ra))
        first = np.empty(len(m), dtype=bool)
        first[order] = _heads(m[order], ra[order], rb[order])
        at = 0
        for number, bucket, n in asked[1]:
            yield _rows([(number, 1, bucket, pickle.dumps(np.packbits(first[at : at + n])))])
            at += n
    if asked[2]:
        r1, r2, often = (np.concatenate(c) for c in zip(*parts[2]))
        order = np.lexsort((r2, r1))
        head = np.flatnonzero(_heads(r1[order], r2[order]))
        n = np.diff(np.append(head, len(r1)))
        many = (n > 1) | np.logical_or.reduceat(often[order], head)
        bucket_of = r1[order][head] >> np.uint64(64 - bits) << np.uint64(64 - bits)
        rank = np.empty(len(r1), dtype=np.uint64)
        rank[order] = np.repeat(np.where(many, bucket_of | (head + 1).astype(np.uint64), np.uint64(0)), n)
        at = 0
        for number, bucket, n in asked[2]:
            yield _rows([(number, 2, bucket, pickle.dumps(rank[at : at + n]))])
            at += n


def _advance(batches: Iterator[pa.RecordBatch], depth: int, bits: int) -> Iterator[pa.RecordBatch]:
    """States at the next depth, and the cut runs (o, k, first line, lines) that this depth reveals."""
    for number, rows in _grouped(batches):
        state = pickle.loads(rows[0][0][1])
        q = _Questions(state, depth, bits)
        f = np.flatnonzero(q.first)
        if len(f):
            here = _unpacked([pickle.loads(data) for _, data in rows[1]], _sizes_of(q.bucket[f]))
            keep = np.zeros(len(q.m), dtype=bool)
            keep[f[here]] = True
            cut = ~keep
            if cut.any():
                d = q.d[cut]
                yield _rows([(number, 9, 0, pickle.dumps((q.o[d], q.k[d], q.start[cut], q.m[cut])))])
        if 2 not in rows:
            continue
        ranks = np.concatenate([pickle.loads(data) for _, data in rows[2]])
        each = np.empty(len(q.alive), dtype=np.uint64)
        each[q.order] = ranks[np.cumsum(q.pair_head) - 1]
        on = each > 0
        if on.any():
            at = q.alive[on]
            later = state[5][:, state[5][2] >= 2 << depth]
            if later.size:
                yield _rows([(number, 0, int(later[2].max()), pickle.dumps((state[0], state[1], state[2][at], state[3][at], each[on], later)))])


def _sizes_of(bucket: np.ndarray) -> list[int]:
    return [b - a for _, a, b in _by_bucket(bucket)]


def _unpacked(bits: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(b, count=n).astype(bool) for b, n in zip(bits, sizes)]) if sizes else np.zeros(0, dtype=bool)


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(o, k, whole, cut): for each document, named by order and content key, whether it is a later copy of a whole text, or
    else the numbers of its lines that lie in a run of at least ``min_words`` words that occurs earlier, in a smaller
    doc_id or before in the same document."""
    if not 1 <= min_words < 2**15:
        raise ValueError("min_words must be from 1 to 32767")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, math.ceil(math.log2(2 * parts)))
    text = docs["text"].cast("string")
    some = docs.select(id_order(docs["doc_id"]).alias("o"), content_key(docs["doc_id"], text).alias("k"), text.alias("text")).where(F.length("text") > 0)
    spread = (F.col("bucket"), F.when(F.col("kind") == 0, F.col("batch")))
    lines = some.mapInArrow(lambda it: trimmed(_lines(it, min_words, bits)), _ROWS).repartition(parts, *spread)
    lines = materialize(lines.mapInArrow(lambda it: trimmed(_repeats(it)), _ROWS), "lines")

    # Later copies of whole texts are one repeated run each; the first copy stands for them from here on.
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                o, k, t1, t2, n, _, w = pickle.loads(data)
                words = np.add.reduceat(w.astype(np.int64), np.cumsum(n) - n)
                columns = (np.full(len(o), number), np.arange(len(o), dtype=np.int32), o, k, t1.view(np.int64), t2.view(np.int64), words >= min_words)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["batch", "doc", "o", "k", "t1", "t2", "long"])

    all_ = lines.where("kind = 0").mapInArrow(lambda it: trimmed(texts(it)), "batch long, doc int, o long, k long, t1 long, t2 long, long boolean")
    firsts = all_.groupBy("t1", "t2").agg(F.min(F.struct("o", "k", "batch", "doc")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = all_.join(firsts, ["t1", "t2"]).where(F.struct("o", "k", "batch", "doc") != F.col("f")).select("batch", "doc", "o", "k", "long", (F.struct("o", "k") != F.struct("f.o", "f.k")).alias("other"))
    copies = materialize(copies, "copies")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(b, -1, 0, pickle.dumps(np.array(d))) for b, d in zip(*(c.to_pylist() for c in batch.columns))])

    leave = copies.groupBy("batch").agg(F.collect_list("doc").alias("docs")).mapInArrow(lambda it: trimmed(names(it)), _ROWS)
    by_batch = lines.unionByName(leave).repartition("batch").sortWithinPartitions("batch", "kind", "bucket")
    state = materialize(by_batch.mapInArrow(lambda it: trimmed(_stretches(it, min_words, bits)), _ROWS), "stretches")
    discard(lines)

    cuts = []
    depth = 0
    while (top := state.where("kind = 0").agg(F.max("bucket")).first()[0] or 0) >= 1 << depth:
        own = state.where("kind = 0")
        last = top < 2 << depth
        asked = own.mapInArrow(lambda it, d=depth, z=last: trimmed(_ask(it, d, bits, z)), _ROWS).repartition("bucket", "kind")  # without a number: few rows make few tasks
        answers = asked.mapInArrow(lambda it: trimmed(_answer(it, bits)), _ROWS)
        both = own.unionByName(answers).repartition("batch").sortWithinPartitions("batch", "kind", "bucket")
        cuts.append(materialize(both.mapInArrow(lambda it, d=depth: trimmed(_advance(it, d, bits)), _ROWS), f"depth{depth}"))
        if not depth:
            discard(state)
        state = cuts[-1]
        depth += 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3).to_pylist():
                o, k, start, m = pickle.loads(data)
                order = np.lexsort((start, k, o))
                o, k, start, m = o[order], k[order], start[order], m[order]
                at = np.flatnonzero(_heads(o, k)).tolist()
                found = [np.unique(np.repeat(start[a:b] - (np.cumsum(m[a:b]) - m[a:b]), m[a:b]) + np.arange(m[a:b].sum())).astype(np.int32) for a, b in zip(at, [*at[1:], len(o)])]
                yield pa.RecordBatch.from_arrays([pa.array(o[at]), pa.array(k[at]), pa.array(found, pa.list_(pa.int32()))], names=["o", "k", "cut"])

    whole = copies.where("long and other").select("o", "k", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("cut")).distinct()
    found = whole
    if cuts:
        cut = cuts[0]
        for c in cuts[1:]:
            cut = cut.unionByName(c)
        cut = cut.where("kind = 9").mapInArrow(lambda it: trimmed(runs(it)), "o long, k long, cut array<int>")
        cut = cut.groupBy("o", "k").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
        found = whole.unionByName(cut.select("o", "k", F.lit(False).alias("whole"), "cut"))
    found = materialize(found, "cuts")
    discard(copies, *cuts)
    return found


def _without(text: pd.Series, cut: pd.Series) -> pd.Series:
    def one(t: str | None, gone) -> str | None:
        if t is None:
            return None
        gone = set(gone)
        return "".join(t[a:b] for i, (a, b) in enumerate(split_lines(t)) if i not in gone).rstrip()

    return pd.Series([one(t, g) for t, g in zip(text, cut)], dtype=object)


def _rebuilt(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    return trimmed(_without(t, g) for t, g in parts)


def dedup_lines(docs: DataFrame, min_words: int = 50, drop_emptied: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, any others) with every line deleted from ``text`` that lies in a run of lines of at least
    ``min_words`` words which occurs earlier (smaller doc_id, null ids last, or before in the same text).

    The columns stay as they are. Documents of which nothing is left go (``drop_emptied``). Null, empty and blank texts
    have no lines and stay. Rows that repeat both doc_id and text are one document: they are treated alike. Among equal
    doc_ids with different texts the content key decides which is earlier. Any length of text is processed whole; an
    empty table gives an empty table. If ``n_chars`` is a column it is left as it was.
    """
    cuts = repeated_lines(docs, min_words)
    o, k, cut, whole = (fresh(docs, c) for c in ("__order", "__key", "__cut", "__whole"))
    text = docs["text"].cast("string")
    cuts = cuts.select(F.col("o").alias(o), F.col("k").alias(k), F.col("cut").alias(cut), F.col("whole").alias(whole))
    joined = docs.withColumns({o: id_order(docs["doc_id"]), k: content_key(docs["doc_id"], text)}).join(cuts.hint("shuffle_hash"), [o, k], "left")
    hit = F.col(cut).isNotNull()
    new = F.pandas_udf(_rebuilt, T.StringType())(F.when(hit, F.col("text")), F.when(hit, F.col(cut)))
    if drop_emptied:
        joined = joined.where(f"not coalesce({whole}, false)")
    result = joined.withColumn("text", F.when(hit, new).when(F.col(whole), F.lit("")).otherwise(F.col("text")))
    if drop_emptied:
        result = result.where(F.col(cut).isNull() | (F.length("text") > 0))
    return result.select(*[F.col(f"`{c}`") for c in docs.columns])
