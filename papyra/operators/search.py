"""BM25 retrieval of one or many queries in one plan, with edit-distance fallback, and the rarest-term variant."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from papyra.functions.scoring import bm25, idf
from papyra.functions.text import analyze
from papyra.operators.index import SearchIndex
from papyra.tables import spread

#: Hits: a rounded score orders them, the smaller doc_id comes first among equals.
HITS = ("qid", "rank", "doc_id", "book_id", "score")
#: Rows of (query, term) in a block of queries.
WANTED = 1 << 20
#: A null qid, while queries are numbers.
_NO_QID = -(1 << 63)


def query_terms(queries: DataFrame, stopwords: Sequence[str] = (), profile: str = "none") -> DataFrame:
    """(qid, term, qtf) of queries (qid, text)."""
    found = queries.select("qid", F.explode(analyze(F.col("text"), profile)).alias("term"))
    if stopwords:
        found = found.where(~F.col("term").isin(*stopwords))
    return found.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def resolve_terms(terms: DataFrame, vocab: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(token, term, df): each distinct token with itself where the vocabulary has it, else with all terms within edit distance 2, or 1 up to 4 letters.

    ``df`` is the sum over the token's terms. Candidates meet by length: a hash join on it, then the edit distance.
    """
    distinct = terms.select(F.col("term").alias("token")).distinct()
    exact = distinct.join(vocab, distinct["token"] == vocab["term"]).select("token", "term", "df")
    if not fuzzy:
        return exact
    missing = distinct.join(vocab, distinct["token"] == vocab["term"], "left_anti")
    reach = F.when(F.length("token") > 4, 2).otherwise(1)
    lengths = F.sequence(F.greatest(F.lit(1), F.length("token") - reach), F.length("token") + reach)
    spread = missing.select("token", reach.alias("reach"), F.explode(lengths).alias("len"))
    near = spread.join(vocab.withColumn("len", F.length("term")), "len").where(F.levenshtein("token", "term", 2).between(0, F.col("reach"))).select("token", "term", "df")
    total = F.sum("df").over(W.partitionBy("token"))
    return exact.union(near.withColumn("df", total))


def score_documents(index: SearchIndex, terms: DataFrame, k1: float = 1.5, b: float = 0.75, fuzzy: bool = True) -> DataFrame:
    """(qid, doc_id, score) of all documents that hold a term of the query; a term counts as often as the query has it."""
    resolved = resolve_terms(terms, index.vocab, fuzzy)
    wanted = terms.withColumnRenamed("term", "token").join(resolved, "token").crossJoin(F.broadcast(index.stats.select("n", "avgdl")))  # one row
    hits = index.postings.join(wanted, "term")
    weight = F.col("qtf") * bm25(idf(F.col("n"), F.col("df")), F.col("tf"), F.coalesce("dl", F.lit(1)), F.col("avgdl"), k1, b)
    return hits.groupBy("qid", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))


@dataclass(frozen=True)
class _Asked:
    """A block of queries: distinct terms, and rows (query, term, weight) by their numbers, sorted by query."""

    qids: np.ndarray
    words: pa.Array
    query: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    avgdl: float


def _asked(wanted: DataFrame, stats: DataFrame) -> Iterator[_Asked]:
    """The queries in blocks of some ``WANTED`` rows, which bounds what is broadcast."""
    rows = wanted.crossJoin(F.broadcast(stats.select("n", "avgdl")))  # one row
    rows = rows.select(F.coalesce(F.col("qid").cast("long"), F.lit(_NO_QID)).alias("qid"), "term", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("weight"), "avgdl")
    found = rows.limit(WANTED + 1).toArrow()
    tables = [found]
    if found.num_rows > WANTED:
        blocks = -(-rows.count() // (WANTED // 2))
        tables = (rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow() for i in range(blocks))
    for t in tables:
        if t.num_rows:
            words = t["term"].combine_chunks().dictionary_encode()
            qids, query = np.unique(t["qid"].to_numpy(), return_inverse=True)
            order = np.argsort(query, kind="stable")
            yield _Asked(qids, words.dictionary, query[order], words.indices.to_numpy()[order], t["weight"].to_numpy()[order], float(t["avgdl"][0].as_py()))


def _best(asked: _Asked, docs: np.ndarray, dl: np.ndarray, row: np.ndarray, word: np.ndarray, k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(qid, doc_id, score): of some documents those that may be among the k best of each query; row, word: the place of each token that is asked for."""
    key, tf = np.unique(word.astype(np.int64) * len(docs) + row, return_counts=True)
    at = key % len(docs)
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[at] / asked.avgdl))
    begin = np.searchsorted(key, np.arange(len(asked.words) + 1, dtype=np.int64) * len(docs))
    score = np.zeros(len(docs))
    ends = np.searchsorted(asked.query, np.arange(len(asked.qids) + 1)).tolist()
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for q, (i, j) in enumerate(zip(ends, ends[1:])):
        hit = []
        for w, weight in zip(asked.word[i:j].tolist(), asked.weight[i:j].tolist()):
            part = slice(begin[w], begin[w + 1])
            score[at[part]] += weight * impact[part]
            hit.append(at[part])
        some = np.concatenate(hit)
        if len(some):
            if j - i > 1:
                some = np.flatnonzero(score) if len(some) * 8 > len(docs) else np.unique(some)
            found = score[some]
            if len(some) > k:  # equal after rounding are kept
                keep = found >= np.partition(found, len(found) - k)[len(found) - k] - 1e-6
                some, found = some[keep], found[keep]
            out.append((q, some, found))
            score[hit[0] if len(hit) == 1 else np.concatenate(hit)] = 0
    if out:
        columns = np.repeat(asked.qids[[q for q, _, _ in out]], [len(s) for _, s, _ in out]), docs[np.concatenate([s for _, s, _ in out])], np.concatenate([f for _, _, f in out])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "doc_id", "score"])


def _scan(batches: Iterator[pa.RecordBatch], asked: _Asked, k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Each document of (doc_id, dl, tokens) is read once, for all queries of a block, in groups of a bounded number of documents and tokens."""
    held: list[tuple[np.ndarray, ...]] = []
    size = docs = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, docs
        starts = np.cumsum([0, *(len(h[0]) for h in held)])
        ids, dl = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        row = np.concatenate([h[2] + s for h, s in zip(held, starts)])
        word = np.concatenate([h[3] for h in held])
        held, size, docs = [], 0, 0
        if len(row):
            yield from _best(asked, ids, dl, row, word, k, k1, b)

    for batch in batches:
        lists = batch.column(2)
        word = pc.fill_null(pc.index_in(lists.flatten(), asked.words), -1).to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        own = word >= 0
        held.append((batch.column(0).to_numpy(), pc.fill_null(batch.column(1), 1).to_numpy().astype(np.float64), row[own], word[own]))
        size, docs = size + int(own.sum()), docs + len(lists)
        if size >= 1 << 22 or docs >= 1 << 16:
            yield from flush()
    if held:
        yield from flush()


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """``scores`` with ``rank`` from 1 to k within each query; k <= 0: no rows."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def search(index: SearchIndex, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, fuzzy: bool = True, stopwords: Sequence[str] = (), profile: str = "none") -> DataFrame:
    """The k best chunks of each query (qid, text): (qid, rank, doc_id, book_id, score).

    Null, empty and unknown queries have no hits. Equal scores: the smaller doc_id first. With a forward table each document is read once
    for a block of queries, and a task returns its own best; without one, postings are joined with the queries' terms.
    """
    terms = query_terms(queries, stopwords, profile)
    if index.forward is None or k < 1 or not isinstance(queries.schema["qid"].dataType, IntegralType):
        scores = score_documents(index, terms, k1, b, fuzzy)
    else:
        wanted = terms.withColumnRenamed("term", "token").join(resolve_terms(terms, index.vocab, fuzzy), "token")
        spark, scores = queries.sparkSession, None
        for asked in _asked(wanted, index.stats):
            shared = spark.sparkContext.broadcast(asked)  # a block of queries
            found = spread(index.forward).mapInArrow(lambda it, a=shared: _scan(it, a.value, k, k1, b), "qid long, doc_id long, score double")
            scores = found if scores is None else scores.union(found)
        scores = spark.createDataFrame([], "qid long, doc_id long, score double") if scores is None else scores.withColumn("score", F.round("score", 6))
        scores = scores.withColumn("qid", F.nullif(F.col("qid"), F.lit(_NO_QID)).cast(queries.schema["qid"].dataType))
    return top_k(scores, k).join(index.chunks.select("doc_id", "book_id"), "doc_id").select(*HITS)


def search_rarest(index: SearchIndex, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, profile: str = "none") -> DataFrame:
    """An approximate top-k (qid, rank, doc_id, score): candidates hold the query's rarest term and, while at least 2k remain, the next ones too; lengths are
    guessed from the query's terms. Like ``search``, but for documents without the rarest term."""
    terms = query_terms(queries, profile=profile).select("qid", "term").join(index.vocab, "term")
    order = W.partitionBy("qid").orderBy("df", "term")
    wanted = terms.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(index.stats.select("n", "avgdl")))  # one row
    hits = index.postings.select("term", "doc_id", "tf").join(wanted, "term")
    # run: how many of the query's terms, from the rarest on, a document holds without a gap.
    docs = hits.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"), F.sum("tf").alias("length"), F.collect_list(F.struct("place", "tf", "df")).alias("terms"), F.first("n").alias("n"), F.first("avgdl").alias("avgdl"))
    docs = docs.where(F.array_contains("places", 1))
    masks = docs.select("qid", "places").groupBy("qid", "places").agg(F.count(F.lit(1)).alias("c"))
    masks = masks.groupBy("qid").agg(F.collect_list(F.struct("places", "c")).alias("masks"))
    last = terms.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n_terms"))

    def fits(places, need):
        return F.size(F.array_except(need, places)) == 0

    def size(need):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(fits(m["places"], need), m["c"]).otherwise(0))

    first = F.array(F.lit(1))
    steps = F.when(F.col("n_terms") > 1, F.sequence(F.lit(2), F.col("n_terms"))).otherwise(F.array().cast("array<int>"))
    chosen = F.aggregate(steps, first, lambda need, t: F.when((size(need) > 5 * k) & (size(F.concat(need, F.array(t))) >= 2 * k), F.concat(need, F.array(t))).otherwise(need))
    need = masks.join(last, "qid").select("qid", chosen.alias("need"))
    kept = docs.join(need, "qid").where(fits(F.col("places"), F.col("need")))
    length = F.when(F.col("length") < F.floor(F.col("avgdl") * 0.5), F.floor("avgdl")).otherwise(F.col("length"))
    kept = kept.withColumn("length", length)
    score = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + bm25(idf(F.col("n"), t["df"]), t["tf"], F.col("length"), F.col("avgdl"), k1, b))
    return top_k(kept.select("qid", "doc_id", F.round(score, 6).alias("score")), k).select("qid", "rank", "doc_id", "score")


def federated(base: DataFrame, recent: DataFrame, k: int) -> DataFrame:
    """The k best of two lists of hits (qid, doc_id, book_id, score); scores are taken as they are."""
    both = base.select("qid", "doc_id", "book_id", "score").unionByName(recent.select("qid", "doc_id", "book_id", "score"))
    return top_k(both, k).select(*HITS)


def first_hits(hits: DataFrame, k: int = 10) -> DataFrame:
    """The best hit of each book of a query, the first k books in order of rank."""
    own = F.row_number().over(W.partitionBy("qid", "book_id").orderBy("rank"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    return hits.withColumn("__own", own).where("__own = 1").drop("__own").withColumn("place", place).where(F.col("place") <= k)
