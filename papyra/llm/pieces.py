"""SentencePiece encoding and decoding for models of byte-pair kind, by a Viterbi pass in numpy over batches of words.

The lattice of a word has an edge for each piece that matches a substring. A segmentation is what the model's merges give
exactly if each piece merges back to itself alone and each two neighbours merge to just these two: merges inside a span
that no merge leaves do not depend on what lies beyond. So each prefix of a word has one valid last piece, and the
forward pass is Viterbi's, with a piece's length as the score of its edge where it fits the last piece of the prefix
before it, and no path where it does not.

Words of equal length advance together, a character at a time; of more than 64 characters, those of one power of two, longest first. Polynomial hashes of all substrings that end there probe
the sorted hashes of the pieces (behind a bitmap), pairs of pieces probe the sorted pairs that were judged before, and
the maximum over the edges is the backpointer. Only new words of a worker are encoded; a table of bounded size keeps the rest, and the pairs, from one task to
the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import holds, trimmed

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 20
#: Words of up to so many characters advance with those of their own length only.
_LONG = 64
#: Characters of words in one pass.
_CELLS = 1 << 18
#: Characters of words, and pairs, that a worker remembers before it starts afresh: some 50 and 10 MB.
_MEMORY, _PAIRS = 5 << 19, 1 << 19


def _polynomial(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(1, dtype=np.uint64)
    for c in codes:
        h = h * _BASE + np.uint64(c + 1)
    return h[0]


class _Pairs:
    """Pairs of pieces (first << 32 | second) that were judged: a table with open addressing."""

    BITS = 20

    def __init__(self) -> None:
        self.keys = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.fits = np.zeros(1 << self.BITS, dtype=bool)
        self.count = 0

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * _BASE >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each pair, whether it is there)."""
        slot = self._slots(pairs)
        key = self.keys[slot]
        there = key == pairs
        on = np.flatnonzero(~there & (key >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[on]]
            there[on] = key == pairs[on]
            on = on[~there[on] & (key >= 0)]
        return slot, there

    def put(self, pairs: np.ndarray, fits: np.ndarray) -> None:
        """Different pairs that are not there."""
        self.count += len(pairs)
        while len(pairs):
            slot, _ = self.find(pairs)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.fits[slot[first]] = pairs[first], fits[first]
            rest = np.ones(len(pairs), dtype=bool)
            rest[first] = False
            pairs, fits = pairs[rest], fits[rest]


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model must fall back to bytes")
        if model.encode("a  b　ﬁ") != model.encode("a  b　ﬁ".replace(" ", SPACE)) or model.decode(model.encode("  aﬁ ")) != "  aﬁ ":
            raise ValueError("the model must keep text as it is, but for the space put before it")
        self.names = names
        self.score = {names[i]: model.get_score(i) for i in range(n) if not special[i]}
        self.id = {names[i]: i for i in range(n) if not special[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("pieces of the model cross white space")
        self.longest = max(map(len, self.id))
        inside = {a + b for p in self.id for a, b in zip(p, p[1:])}
        #: Characters no piece joins to another: they stand alone.
        self.alone = "".join(c for c in "\n\t\r" if not any(c in x for x in inside))
        stop = re.escape(self.alone)
        #: Closing marks that no piece joins to a letter before them end a word.
        marks = "".join(c for c in ",.;:!?%$#&*|)" if not any(x[1] == c and x[0] not in ",.;:!?%$#&*|)" + SPACE for x in inside))
        self.words = re.compile(f" *[^ {stop}{re.escape(marks)}]+|[{re.escape(marks)}]+|[{stop}]| +" if self.alone and marks else f" *[^ {stop}]+|[{stop}]| +" if self.alone else " *[^ ]+| +")
        real = [p for p in self.id if self.merged(p) == [p]]
        self.real = set(real)
        keys = np.array([_polynomial([ord(c) for c in p]) for p in real], dtype=np.uint64) * _MIX
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.id[p] for p in real], dtype=np.int64)[order]
        if len(np.unique(self.keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        #: By the first bits of a hash: the first key with these bits and one more, or 0.
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.slots[(self.keys >> np.uint64(64 - _SLOT_BITS))[::-1]] = np.arange(len(keys), 0, -1)
        head = self.keys >> np.uint64(64 - _SLOT_BITS)
        #: The most keys with equal first bits.
        self.crowd = int(np.unique(head, return_counts=True)[1].max())
        self.powers = np.ones(self.longest + 2, dtype=np.uint64)
        for i in range(1, len(self.powers)):
            self.powers[i : i + 1] = self.powers[i - 1 : i] * _BASE
        self.free()
        bytes_of = [b"" if special[i] and not model.is_byte(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.blob = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.blob_len = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.blob_at = np.cumsum(self.blob_len) - self.blob_len

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros(1 << 16, dtype=np.int32)
        self.starts, self.sizes = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int32)
        self.filled = self.count = self.characters = 0

    def free(self) -> None:
        self.forget()
        self.pairs = _Pairs()

    def merged(self, text: str) -> list[str]:
        """The pieces of ``text`` by the model's merges: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, i: int) -> str:
        return self.names[i] if i < len(self.names) else chr(i - len(self.names))

    def _fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two pieces of each pair (first << 32 | second) stay two; first == 2**31 - 1: a word starts."""
        slot, there = self.pairs.find(pairs)
        if not there.all():
            new = np.unique(pairs[~there])
            ok = [self.merged(a + b) == [a, b] for a, b in ((self._name(p >> 32), self._name(p & 0xFFFFFFFF)) for p in new.tolist())]
            self.pairs.put(new, np.array(ok))
            slot, _ = self.pairs.find(pairs)
        return self.pairs.fits[slot]

    def _batch(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of falling length: (last piece of each prefix, its length), each (prefix, word)."""
        n, w = int(lengths[0]), len(words)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if n == lengths[-1]:
            codes = flat.reshape(w, n).T
        else:
            codes = np.zeros((n, w), dtype=np.uint64)
            codes[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(w), lengths)] = flat
        reach = (w - np.searchsorted(lengths[::-1], np.arange(n + 1), side="left")).tolist()
        upto = np.zeros((n + 1, w), dtype=np.uint64)
        for j in range(n):
            upto[j + 1] = upto[j] * _BASE + codes[j] + np.uint64(1)
        last, size = np.zeros((n + 1, w), dtype=np.int64), np.zeros((n + 1, w), dtype=np.int64)
        for j in range(1, n + 1):
            most, live = min(j, self.longest), reach[j]
            spans = np.arange(1, most + 1)
            h = upto[j, :live] - upto[j - spans, :live] * self.powers[spans][:, None]
            h *= _MIX  # hashes of short spans are small numbers
            slot = self.slots[h >> np.uint64(64 - _SLOT_BITS)]
            row, col = np.nonzero(slot)
            probe, at = h[row, col], slot[row, col] - 1
            hit = self.keys[at] == probe
            for _ in range(1, self.crowd):
                further = np.flatnonzero(~hit & (at + 1 < len(self.keys)))
                further = further[self.keys[at[further] + 1] <= probe[further]]
                at[further] += 1
                hit[further] = self.keys[at[further]] == probe[further]
            row, col, piece = row[hit], col[hit], self.key_ids[at[hit]]
            single = np.ones(live, dtype=bool)
            single[col[row == 0]] = False
            lone = np.flatnonzero(single)  # characters that are no piece are edges too
            row, col = np.concatenate([row, np.zeros(len(lone), dtype=row.dtype)]), np.concatenate([col, lone])
            piece = np.concatenate([piece, codes[j - 1, lone].astype(np.int64) + len(self.names)])
            back = j - 1 - row
            begins = back == 0
            fits = np.ones(len(row), dtype=bool)
            inner = ~begins
            fits[inner] = self._fits((last[back[inner], col[inner]] << 32) | piece[inner])
            score = np.zeros(live, dtype=np.int64)
            np.maximum.at(score, col[fits], row[fits] + 1)
            best = fits & (score[col] == row + 1)
            last[j, col[best]] = piece[best]
            size[j, :live] = score
        return last, size

    def _ids(self, piece: int) -> list[int]:
        return [piece] if piece < len(self.names) else [self.byte_ids[b] for b in chr(piece - len(self.names)).encode("utf-8", "surrogatepass")]

    def _learn(self, words: list[str]) -> None:
        groups: dict[int, list[str]] = {}
        for x in words:
            groups.setdefault(len(x) if len(x) <= _LONG else 1 << 20 + len(x).bit_length(), []).append(x)
        for group in groups.values():
            group.sort(key=len, reverse=True)
            at = 0
            while at < len(group):
                part = group[at : at + max(1, _CELLS // len(group[at]))]
                at += len(part)
                lengths = np.array([len(x) for x in part])
                last, size = self._batch(part, lengths)
                col, j, steps = np.arange(len(part)), lengths, []
                while (live := j > 0).any():
                    steps.append(np.where(live, last[j, col], -1))
                    j = np.where(live, j - size[j, col], 0)
                path = np.array(steps[::-1]).T
                if int(path.max(initial=0)) < len(self.names):
                    self._add(part, path[path >= 0].astype(np.int32), (path >= 0).sum(axis=1))
                    continue
                found = [[x for p in row if p >= 0 for x in self._ids(p)] for row in path.tolist()]
                self._add(part, np.array([x for f in found for x in f], dtype=np.int32), np.array([len(f) for f in found]))

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        end, count = self.filled + len(flat), self.count + len(words)
        self.table = self._room(self.table, end)
        self.starts, self.sizes = self._room(self.starts, count), self._room(self.sizes, count)
        self.table[self.filled : end] = flat
        self.starts[self.count : count] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[self.count : count] = sizes
        self.known.update(zip(words, range(self.count, count)))
        self.filled, self.count = end, count
        self.characters += sum(map(len, words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); none for null and empty texts."""
        if self.characters > _MEMORY:
            self.forget()
        if self.pairs.count > _PAIRS:
            self.pairs = _Pairs()
        words: list[str] = []
        counts = []
        find = self.words.findall
        for t in texts:
            found = find(" " + t.replace(SPACE, " ")) if t else []
            counts.append(len(found))
            words += found
        known = self.known
        new = [x for x in set(words) if x not in known]
        if new:
            shown = [x.replace(" ", SPACE) for x in new]
            self._learn(shown)
            for a, b in zip(new, shown):
                if a is not b and a != b:
                    known[a] = known.pop(b)
        which = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        starts, sizes = self.starts[which].astype(np.int64), self.sizes[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.table[np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)]
        ends = np.cumsum(counts, dtype=np.int64)
        return ids, total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ``encode``'s result: bytes of the pieces joined, without the space put before each text."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.blob_len[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.blob[np.arange(total[-1]) + np.repeat(self.blob_at[ids] - total[:-1], size)].tobytes()
        ends = total[np.cumsum(counts, dtype=np.int64)]
        out, a = [], 0
        for b in ends.tolist():
            s = data[a:b].decode("utf-8", "replace")
            out.append(s[1:] if s[:1] == " " else s)
            a = b
        return out


@lru_cache(maxsize=4)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def _local(model_file: str) -> str:
    """A file shipped with ``SparkContext.addFile``, or else a path that all hosts have."""
    import os

    shipped = SparkFiles.get(os.path.basename(model_file))
    return shipped if os.path.exists(shipped) else model_file


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every row of ``docs``, as the model itself would encode its text.

    ``round_trip``: whether decoding the ids gives the text again; U+2581 in a text stands for a space in such models, so
    such a text comes back with a space there, and that counts as equal. Null text: null ids, n_tokens 0, round_trip null.
    Empty text: no ids. Unpaired surrogates cannot be in a Spark string. Repeated rows give repeated results; other columns
    are not read; words and texts of any length are encoded whole.
    """
    docs.sparkSession.sparkContext.addFile(model_file)
    name = model_file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(_local(name))
        holds("pieces", coder.free)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(1).to_pylist()
                ids, counts = coder.encode(texts)
                back = coder.decode(ids, counts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                same = [None if t is None else b == t.replace(SPACE, " ") for t, b in zip(texts, back)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(counts.astype(np.int32)), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(lambda it: trimmed(run(it), "pieces"), out)


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids: null text. Ids of control pieces give nothing; null ids inside a list are skipped."""
    encoded.sparkSession.sparkContext.addFile(model_file)
    name = model_file

    def run(ids: pd.Series) -> pd.Series:
        coder = pieces(_local(name))
        lists = [[] if x is None else [int(i) for i in x if i is not None and i == i] for x in ids]
        back = coder.decode(np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists]))
        return pd.Series([None if x is None else b for x, b in zip(ids, back)], dtype=object)

    return encoded.select("doc_id", F.pandas_udf(run, T.StringType())("ids").alias("text"))
