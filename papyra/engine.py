"""One object over the index, the metadata and the searches, for programs and the command line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.index import SearchIndex, build_index, load_index, save_index
from papyra.operators.metadata import chunk_metadata, search_metadata
from papyra.operators.rerank import rerank_books, rerank_editions
from papyra.operators.search import first_hits, search, search_rarest
from papyra.sources.books import read_book_files
from papyra.streaming.realtime import RealtimeIndex

#: So many more hits than results are re-ranked.
MORE, MORE_FIRST = 20, 10


class Engine:
    """Searches over one index; with ``log_path`` also what was added since, and what was added is committed to the index at ``path``."""

    def __init__(self, spark: SparkSession, index: SearchIndex, meta: DataFrame | None = None, stopwords: Sequence[str] = (), profile: str = "pt", path: str | None = None, log_path: str | None = None) -> None:
        self.spark, self.index, self.meta, self.stopwords, self.profile = spark, index, meta, tuple(stopwords), profile
        self.realtime = RealtimeIndex(spark, index, log_path, path, profile) if log_path else None

    @classmethod
    def build(cls, spark: SparkSession, folder: str, path: str, stopwords: Sequence[str] = (), chunk_size: int = 1000, overlap: int = 100, batch_size: int = 100, profile: str = "pt") -> Engine:
        """Index the book files of a folder into tables at ``path``."""
        save_index(build_index(read_book_files(spark, folder).select("ordinal", "book_id", "text"), stopwords=stopwords, chunk_size=chunk_size, overlap=overlap, batch_size=batch_size, profile=profile), path)
        return cls.open(spark, path, stopwords=stopwords, profile=profile)

    @classmethod
    def open(cls, spark: SparkSession, path: str, meta: DataFrame | None = None, stopwords: Sequence[str] = (), profile: str = "pt", log_path: str | None = None) -> Engine:
        return cls(spark, load_index(spark, path), meta, stopwords, profile, path, log_path)

    def reindex(self, folder: str, path: str, chunk_size: int = 1000, overlap: int = 100, batch_size: int = 100) -> None:
        """Replace the index by one of a folder's book files."""
        self.index = Engine.build(self.spark, folder, path, self.stopwords, chunk_size, overlap, batch_size, self.profile).index

    def _added(self) -> RealtimeIndex:
        if self.realtime is None:
            raise ValueError("the engine was opened without a log: nothing can be added")
        return self.realtime

    def add(self, content: str, book_id: str | None = None, title: str | None = None, author: str | None = None) -> None:
        """Add one document; it is found from then on. Many at once: ``add_all``."""
        self.add_all(self.spark.createDataFrame([(content, book_id, title, author)], "content string, book_id string, title string, author string"))

    def add_all(self, documents: DataFrame) -> None:
        """Add (content, book_id, title, author) rows."""
        self._added().add(documents.select("content", F.to_json(F.struct("book_id", "title", "author")).alias("metadata")))

    def flush(self, mode: str = "discard") -> int:
        """How many added documents were dropped, or with ``commit`` moved to the index."""
        n = self._added().flush(mode)
        self.index = self._added().base
        return n

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string")

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, fuzzy: bool = True) -> DataFrame:
        """With a log, hits of both indexes; the options are those of the plain index then."""
        if self.realtime is not None:
            return self.realtime.search(queries, k, stopwords=self.stopwords)
        return search(self.index, queries, k, k1, b, fuzzy, self.stopwords, self.profile)

    def search_rarest(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return search_rarest(self.index, queries, k, profile=self.profile)

    def editions(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return rerank_editions(self.search(queries, MORE * k), queries, self._meta(), k)

    def books(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return rerank_books(self.search(queries, MORE * k), queries, self._meta(), self.index.stats, k, self.stopwords, self.profile)

    def first_hits(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return first_hits(self.search(queries, MORE_FIRST * k), k)

    def metadata(self, source: str, book_id: str) -> DataFrame:
        return self._meta().where((F.col("source") == source) & (F.col("book_id") == book_id))

    def book(self, source: str, book_id: str) -> dict:
        """One book's metadata; LookupError if there is none."""
        found = self.metadata(source, book_id).first()
        if found is None:
            raise LookupError(f"{source} has no book {book_id}")
        return found.asDict(recursive=True)

    def is_indexed(self, book_id: str) -> bool:
        return not self.index.chunks.where(F.col("book_id") == book_id).isEmpty()

    def chunk_metadata(self) -> DataFrame:
        """(doc_id, book_id, metadata): each chunk's JSON, with its id and the tokens of title and author."""
        return chunk_metadata(self.index.chunks, self._meta(), self.profile)

    def find_titles(self, text: str, source: str | None = None, limit: int = 10) -> DataFrame:
        return search_metadata(self._meta(), text, source, limit)

    def health(self) -> dict[str, object]:
        return {"status": "ok", "documents": self.index.stats.first()["n"]}

    def _meta(self) -> DataFrame:
        if self.meta is None:
            raise ValueError("the engine was opened without metadata")
        return self.meta


def register_functions(spark: SparkSession) -> None:
    """``stem``, ``html_text``, ``analyze`` (stems of a text), ``tokenize``, ``chunk_text`` (chunks of a normalised text), ``parse_book`` (text of a file's content, by
    extension), ``encode_postings`` and ``decode_postings`` for SQL."""
    import pandas as pd

    from papyra.functions.codecs import decode_postings, encode_postings
    from papyra.functions.stemmer import stem
    from papyra.functions.text import chunk_spans, python_tokens
    from papyra.sources.parsers import html_text, parse_bytes

    def one(f, kind: str):
        return F.pandas_udf(lambda s: pd.Series([None if x is None else f(x) for x in s], dtype=object), kind)

    spark.udf.register("stem", one(stem, "string"))
    spark.udf.register("html_text", one(html_text, "string"))
    spark.udf.register("tokenize", one(python_tokens, "array<string>"))
    spark.udf.register("analyze", one(lambda t: [stem(w) for w in python_tokens(t)], "array<string>"))
    spark.udf.register("chunk_text", one(lambda t: [c for a, b in chunk_spans(t, 1000, 100) if (c := t[a:b].strip())], "array<string>"))
    spark.udf.register("parse_book", F.pandas_udf(lambda content, ext: pd.Series([parse_bytes(c, e) for c, e in zip(content, ext)], dtype=object), "string"))
    spark.udf.register("encode_postings", one(lambda p: encode_postings([(x["doc_id"], x["tf"]) for x in p]), "binary"))
    spark.udf.register("decode_postings", one(lambda b: [{"doc_id": d, "tf": tf} for d, tf in decode_postings(b)], "array<struct<doc_id: bigint, tf: int>>"))
