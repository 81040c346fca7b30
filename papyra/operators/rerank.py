"""Re-ranking of hits with book metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.functions.scoring import popularity
from papyra.functions.text import analyze, known, title_key

REFERENCE_WORKS = ("dictionary", "encyclopedia", "lexicon", "glossary", "index", "catalog", "thesaurus", "concordance")
BOOK_URL = "https://www.gutenberg.org/ebooks/"


def rerank_editions(hits: DataFrame, queries: DataFrame, meta: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, book_id, title, author, score, url): hits of known books, boosted by title, author and popularity; of editions of one title the best one.

    Hits (qid, rank, book_id, score); meta has one row a book_id. Null or empty titles and authors read ``Unknown``. Equal
    scores: the earlier hit.
    """
    title, author = known(F.col("title")), known(F.col("author"))
    some = hits.select("qid", F.col("rank").alias("hit"), "book_id", "score").join(queries.select("qid", F.lower("text").alias("query")), "qid")
    some = some.join(meta.withColumns({"title": title, "author": author}), "book_id")
    words = F.filter(F.split("query", r"\s+"), lambda t: t != "")
    factor = F.when(F.contains(F.lower("title"), "query"), 1.5).otherwise(1.0) * F.when(F.arrays_overlap(words, F.split(title_key(F.col("author")), " ")), 2.0).otherwise(1.0)
    gate = F.coalesce(F.col("ratings_average") != 0, F.lit(False)) | F.coalesce(F.col("want_to_read_count") != 0, F.lit(False)) | F.coalesce(F.col("edition_count") != 0, F.lit(False))
    popular = F.when(gate, popularity(*(F.col(c) for c in ("ratings_average", "ratings_count", "want_to_read_count", "edition_count")))).otherwise(1.0)
    some = some.withColumn("score", F.round(F.col("score") * factor * popular, 6)).withColumns({"tk": title_key(F.col("title")), "ak": title_key(F.col("author"))})
    edition = F.row_number().over(W.partitionBy("qid", "tk", "ak").orderBy(F.desc("score"), "hit"))
    best = some.withColumn("e", edition).where("e = 1")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "hit"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "book_id", "title", "author", "score", F.concat(F.lit(BOOK_URL), "book_id").alias("url"))


def rerank_books(hits: DataFrame, queries: DataFrame, meta: DataFrame, avgdl: DataFrame, k: int = 10, stopwords: Sequence[str] = (), profile: str = "none") -> DataFrame:
    """(qid, rank, book_id, title, author, score, doc_id): books by their two best chunks, title matches, ratings and author diversity.

    Hits (qid, rank, doc_id, book_id, score), ``avgdl`` one row. Books without metadata stay, without boosts and with empty
    title and author. Equal scores: the smaller doc_id.
    """
    stop = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    asked = queries.select("qid", F.array_except(F.array_distinct(analyze(F.col("text"), profile)), stop).alias("q")).where(F.size("q") > 0)
    about = meta.select("book_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), "ratings_average", "want_to_read_count")
    about = about.withColumn("tt", F.array_distinct(analyze(F.concat_ws(" ", "title", "author"), profile)))
    some = hits.select("qid", "doc_id", "book_id", "score").join(asked, "qid").join(about, "book_id", "left").crossJoin(F.broadcast(avgdl.select("avgdl")))  # one row
    some = some.withColumns({"title": F.coalesce("title", F.lit("")), "author": F.coalesce("author", F.lit("")), "m": F.coalesce(F.size(F.array_intersect("q", "tt")), F.lit(0)), "nq": F.size("q")})
    m, nq = F.greatest("m", F.lit(0)), F.col("nq")
    chunk = (F.col("score") + 3.0 * 2.0 * m) * (1 + 0.3 * m / nq) * F.log(1 + 1000 / F.col("avgdl")) * F.when((m == nq) & (nq > 1), 1.2).otherwise(1.0)
    some = some.withColumn("chunk", F.round(chunk, 9))
    place = F.row_number().over(W.partitionBy("qid", "book_id").orderBy(F.desc("chunk"), "doc_id"))
    two = some.withColumn("p", place).where("p <= 2")
    first = lambda c: F.max(F.when(F.col("p") == 1, F.col(c))).alias(c)
    book = two.groupBy("qid", "book_id").agg(*[first(c) for c in ("doc_id", "title", "author", "m", "nq", "ratings_average", "want_to_read_count")], F.sum(F.when(F.col("p") == 1, F.col("chunk")).otherwise(0.2 * F.col("chunk"))).alias("s"))
    score = F.col("s") * F.when(F.lower("title").rlike("|".join(REFERENCE_WORKS)), 0.7).otherwise(1.0) * F.when(F.col("m") == F.col("nq"), 1.3).otherwise(1.0)
    score = score * F.when(F.col("ratings_average") > 0, 1 + F.col("ratings_average") / 5 * 0.5).otherwise(1.0)
    score = score * F.when(F.col("want_to_read_count") > 0, 1 + F.least(F.lit(0.2), F.log10(F.greatest(F.lit(1), "want_to_read_count")) * 0.05)).otherwise(1.0)
    return _diverse(book.withColumn("score", F.round(score, 9)), k)


def _diverse(books: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(W.partitionBy("qid", "author").orderBy(F.desc("score"), "doc_id")) - 1
    damped = books.withColumn("n", n).withColumn("score", F.round(F.col("score") * F.pow(F.lit(0.9), F.col("n")), 6))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return damped.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "book_id", "title", "author", "score", "doc_id")
