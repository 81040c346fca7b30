"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained with follow-the-regularised-leader (proximal, per coordinate) under elastic-net penalties on a bounded sample of
labelled rows, then calibrated by one temperature on held-out rows of that sample. Document frequencies cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import fresh, trimmed

BITS = 14
DIM = 1 << BITS
_SLICE = 1 << 18
_GROUP = 32

#: Letters keep their code, all else is a space.
_LETTERS = np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], dtype=np.uint32)


def _tally(buf: list[str], rows: list[int]) -> np.ndarray:
    lens = np.array([len(s) for s in buf])
    codes = np.frombuffer("".join(buf).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.take(_LETTERS, codes, mode="clip")
    beyond = np.flatnonzero(codes >= 0x10000)
    if len(beyond):
        own, place = np.unique(codes[beyond], return_inverse=True)
        a[beyond] = np.array([c if chr(c).isalpha() else 32 for c in own.tolist()], dtype=np.uint32)[place]
    last, mid, first = a[2:], a[1:-1], a[:-2]
    keep = (last != 32) | (mid != 32)
    heads = (np.cumsum(lens) - lens)[1:]
    keep[heads - 2] = keep[heads - 1] = False
    base = np.repeat(np.array(rows, dtype=np.int64) << BITS, lens)[2:][keep]
    last, mid, first = last[keep], mid[keep], first[keep]
    k1, k2 = np.uint32(2654435761), np.uint32(0x85EBCA6B)
    grams = (last * k1 + np.uint32(0x9E3779B9), (mid * k2 + last) * k1, ((first * k2 + mid) * k2 + last + np.uint32(77)) * k1)
    keys = np.empty(3 * len(base), dtype=np.int64)
    for i, g in enumerate(grams):
        np.add(base, g >> np.uint32(32 - BITS), out=keys[i * len(base) : (i + 1) * len(base)])
    return np.bincount(keys, minlength=_GROUP << BITS)


def gram_counts(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed 1- to 3-grams of groups of texts in order: number of texts, then text in the group, gram and count, sorted by text
    and gram. Texts of any length go in slices."""
    texts = list(texts)
    for g in range(0, len(texts), _GROUP):
        group = texts[g : g + _GROUP]
        out: np.ndarray | int = 0
        buf: list[str] = []
        rows: list[int] = []
        size = 0
        for r, t in enumerate(group):
            t = (t or "").lower()
            for s in range(0, len(t), _SLICE):
                buf.append(("  " if s == 0 else t[s - 2 : s]) + t[s : s + _SLICE])
                rows.append(r)
                size += len(buf[-1])
                if size >= _SLICE:
                    out = out + _tally(buf, rows)
                    buf, rows, size = [], [], 0
        if buf:
            out = out + _tally(buf, rows)
        at = np.flatnonzero(out)
        yield len(group), at >> BITS, at & (DIM - 1), out[at] if len(at) else at


@dataclass
class Model:
    """Languages in order, idf by n-gram, weights (n-gram, language), bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    heldout_accuracy: float = float("nan")

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        """A row a text; all zero where a text has no letters."""
        k = len(self.languages)
        found = [np.zeros((0, k))]
        for n, row, gram, count in gram_counts(texts):
            x = np.log1p(count) * self.idf[gram]
            norm = np.sqrt(np.bincount(row, x * x, n))
            z = np.stack([np.bincount(row, x * self.weights[gram, c], n) for c in range(k)], axis=1)
            z = (z / np.where(norm > 0, norm, 1)[:, None] + self.bias) / self.temperature
            e = np.exp(z - z.max(axis=1, keepdims=True))
            found.append(np.where((norm > 0)[:, None], e / e.sum(axis=1, keepdims=True), 0))
        return np.concatenate(found)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, classes) and bias by proximal FTRL; x: (indices, values) of each row. The bias has no penalty."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    penalty = np.full((DIM + 1, 1), l1)
    penalty[DIM] = 0

    def current(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= penalty[i], 0, -(z[i] - np.sign(z[i]) * penalty[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(x)):
            i, v = np.append(x[r][0], DIM), np.append(x[r][1], 1.0)
            w = current(i)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = v[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = current(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Of a grid, the temperature of least log loss."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    return min(np.geomspace(0.05, 5, 60), key=loss) if len(y) else 1.0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        for _, row, gram, _ in gram_counts(batch.column(0).to_pylist()):
            df += np.bincount(gram, minlength=DIM)
            rows += len(np.unique(row))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM).astype(np.int32)), pa.array(np.append(df[at], rows))], names=["g", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, values = [], []
        for n, row, gram, count in gram_counts(batch.column(1).to_pylist()):
            ends = np.searchsorted(row, np.arange(n + 1))
            for a, b in zip(ends, ends[1:]):
                at.append(gram[a:b].astype("<i4").tobytes())
                values.append(count[a:b].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "n"])


def train(docs: DataFrame, sample_rows: int = 2000, label: str = "lang") -> Model | None:
    """Fit on at most ``sample_rows`` labelled rows (those of least hash, a fifth of them held out for calibration).

    Rows without label or without letters are not used. With no usable row there is no model (None); with one language
    all texts with letters get it.
    """
    text = docs["text"].cast("string")
    df = docs.select(text.alias("t")).where(F.length("t") > 0).mapInArrow(lambda it: trimmed(_frequencies(it)), "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    seen = np.zeros(DIM + 1)
    for g, n in df.collect():  # at most DIM + 1 rows
        seen[g] = n
    idf = (np.log((1 + seen[DIM]) / (1 + seen[:DIM])) + 1).astype(np.float32)
    rows = docs.select(docs[label].cast("string").alias("lang"), text.alias("t"), F.xxhash64(docs["doc_id"], text, docs[label].cast("string")).alias("h")).where("lang is not null and length(t) > 0")
    edge = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return None
    found = rows.where(F.col("h") <= edge).select("lang", "t").mapInArrow(_sparse, "lang string, at binary, n binary").limit(sample_rows).collect()
    found = sorted((r.lang, r.at, r.n) for r in found if r.at)
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    order = np.random.default_rng(0).permutation(len(found))
    x, y = [], []
    for r in order:
        i = np.frombuffer(found[r][1], dtype="<i4")
        v = np.log1p(np.frombuffer(found[r][2], dtype="<i4").astype(np.float32)) * idf[i]
        x.append((i, v / np.linalg.norm(v)))
        y.append(languages.index(found[r][0]))
    y = np.array(y)
    held = len(x) // 5
    w, b = ftrl(x[held:], y[held:], len(languages))
    logits = np.array([v @ w[i] + b for i, v in x[:held]]).reshape(held, len(languages))
    accuracy = float((logits.argmax(axis=1) == y[:held]).mean()) if held else float("nan")
    return Model(languages, idf, w.astype(np.float32), b.astype(np.float32), float(_temperature(logits, y[:held])), accuracy)


def identified(docs: DataFrame, model: Model | None) -> Column:
    """Struct column of ``docs``: language (null where there are no letters), confidence (calibrated, 0 there)."""
    if model is None:
        return F.struct(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        p = m.probabilities(text)
        top = p.max(axis=1) if len(p) else np.zeros(0)
        names = np.array([*m.languages, None], dtype=object)
        return pd.DataFrame({"language": names[np.where(top > 0, p.argmax(axis=1), len(m.languages))], "confidence": top.astype(float)})

    kind = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return F.pandas_udf(guess, kind)(docs["text"].cast("string"))


def identify_languages(docs: DataFrame, sample_rows: int = 2000, min_confidence: float = 0.5) -> DataFrame:
    """(doc_id, lang, language, confidence, accepted) for every row of ``docs``.

    Null, empty and letterless texts: language null, confidence 0, not accepted. Equal probabilities: the first language in
    alphabetical order. Repeated rows are judged one by one, alike. Other columns of ``docs`` are not read. Long texts are
    read whole. An empty table gives an empty table.
    """
    guess = identified(docs, train(docs, sample_rows))
    found = docs.select(docs["doc_id"], docs["lang"], guess.alias("__guess"))
    return found.select("doc_id", "lang", "__guess.language", "__guess.confidence", (F.col("__guess.confidence") >= min_confidence).alias("accepted"))


def keep_identified(docs: DataFrame, sample_rows: int = 2000, min_confidence: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``identify_languages`` accepts, columns unchanged."""
    guess = fresh(docs, "__guess")
    found = docs.withColumn(guess, identified(docs, train(docs, sample_rows)))
    return found.where(F.col(guess)["confidence"] >= min_confidence).select(*[F.col(f"`{c}`") for c in docs.columns])
