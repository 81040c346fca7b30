"""Near-real-time additions: a write-ahead log, a small index over it, and search of both indexes together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.functions.text import analyze
from papyra.operators.index import SearchIndex, append_books, committed, corpus_stats, dense_ids, document_frequencies, extend_index, load_index, term_frequencies
from papyra.operators.search import federated, search
from papyra.sources.sinks import append_log, clear_log, read_log
from papyra.tables import discard, file_system, materialize, numbered

RAM_K1 = 1.2


def recent_index(log: DataFrame, base_id: int = 0, as_logged: bool = False, profile: str = "none") -> SearchIndex:
    """Index of log rows (id, content, metadata): one chunk a row, ids from ``base_id`` on in order of the log's. ``as_logged``: every hit's book is ``RAM_BOOK``, not the
    book_id of its metadata."""
    place = dense_ids(log.select(F.col("id").alias("ordinal"), F.lit(1).alias("n")), base_id).toDF("id", "doc_id")
    book = F.lit("RAM_BOOK") if as_logged else F.coalesce(F.get_json_object("metadata", "$.book_id"), F.lit("RAM_BOOK"))
    rows = log.join(place, "id").select(F.col("doc_id").cast("long"), book.alias("book_id"), F.col("content").alias("text"), analyze(F.col("content"), profile).alias("tokens"))
    rows = rows.withColumns({"ordinal": F.col("doc_id"), "seq": F.lit(0), "dl": F.coalesce(F.size("tokens"), F.lit(0)), "segment_id": F.lit(-1).cast("long")})
    postings = term_frequencies(rows)
    return SearchIndex(rows.drop("tokens"), postings, document_frequencies(postings), corpus_stats(rows))


def search_both(base: SearchIndex, recent: SearchIndex, queries: DataFrame, k: int = 10, stopwords: Sequence[str] = (), one_scale: bool = False, profile: str = "none") -> DataFrame:
    """(qid, rank, doc_id, book_id, score): the k best hits of both, analysed alike. Each side has its own statistics and k1 (1.5, and 1.2 for recent rows, without the
    edit-distance fallback); ``one_scale``: both are scored as one index."""
    if one_scale:
        chunks = base.chunks.select("doc_id", "book_id", "dl").unionByName(recent.chunks.select("doc_id", "book_id", "dl"))
        postings = base.postings.unionByName(recent.postings)
        return search(SearchIndex(chunks, postings, document_frequencies(postings), corpus_stats(chunks)), queries, k, stopwords=stopwords, profile=profile)
    return federated(search(base, queries, k, stopwords=stopwords, profile=profile), search(recent, queries, k, k1=RAM_K1, fuzzy=False, profile=profile), k)


class RealtimeIndex:
    """A base index with a log at ``log_path``; opening it again finds what the log holds.

    ``path``: where the base index is saved. A commit then appends the log to it as a batch, named by its last id, before the log is emptied: if it fails
    between the two, the next opening drops the rows that the batch has. ``profile``: how both the log and queries are analysed, as the base index was.
    """

    def __init__(self, spark: SparkSession, base: SearchIndex | None, log_path: str, path: str | None = None, profile: str = "none") -> None:
        if base is None and path is None:
            raise ValueError("a base index or the path of a saved one is needed")
        self.spark, self.log_path, self.path, self.profile = spark, log_path, path, profile
        self.base = load_index(spark, path) if base is None else base
        fs, where = file_system(spark, log_path)
        if not fs.exists(where):
            clear_log(spark, log_path)
        done = self._done()
        if done >= 0 and not read_log(spark, log_path).where(F.col("id") <= done).isEmpty():
            left = materialize(self._log(), "log")
            clear_log(spark, log_path)
            append_log(spark, log_path, left)

    def _done(self) -> int:
        """The last log id that is in the saved index, or -1."""
        return max((int(b.removeprefix("log-")) for b in (committed(self.spark, self.path) if self.path else ()) if b.startswith("log-")), default=-1)

    def _log(self) -> DataFrame:
        return read_log(self.spark, self.log_path).where(F.col("id") > self._done())

    def _base_id(self) -> int:
        return self.base.chunks.agg(F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).first()[0]

    def add(self, documents: DataFrame) -> None:
        """Append (content, metadata) rows to the log; they are found from then on."""
        top = read_log(self.spark, self.log_path).agg(F.max("id")).first()[0]
        start = max(self._base_id() if top is None else top + 1, self._done() + 1)
        rows = numbered(documents.select("content", "metadata"), ["content", "metadata"], "id", start)
        append_log(self.spark, self.log_path, rows.withColumn("length", F.lit(0)))

    def add_stream(self, documents: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add a stream of (content, metadata) rows, batch by batch, until what there is has been read. A batch that runs again after a failure is recognised by its number and not added twice."""

        def put(rows: DataFrame, number: int) -> None:
            done = read_log(self.spark, self.log_path).where(F.get_json_object("metadata", "$.__batch") == str(number))
            if done.isEmpty():
                tagged = F.to_json(F.map_concat(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("__batch"), F.lit(str(number)))))
                self.add(rows.select("content", tagged.alias("metadata")))

        return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def recent(self) -> SearchIndex:
        return recent_index(self._log(), self._base_id(), profile=self.profile)

    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        return search_both(self.base, self.recent(), queries, k, **{"profile": self.profile} | options)

    def flush(self, mode: str = "discard") -> int:
        """Empty the log and return how many rows it held; ``commit`` adds them to the base index first, each row whether its book is there or not."""
        if mode not in ("discard", "commit"):
            raise ValueError("mode is discard or commit")
        log = materialize(self._log(), "flushed")
        n, last = log.agg(F.count(F.lit(1)), F.max("id")).first()
        if mode == "commit" and n:
            books = log.select(F.col("id").alias("ordinal"), F.coalesce(F.get_json_object("metadata", "$.book_id"), F.concat(F.lit("log-"), "id")).alias("book_id"), F.col("content").alias("text"))
            if self.path:
                append_books(self.spark, self.path, f"log-{last}", books, profile=self.profile)
                self.base = load_index(self.spark, self.path)
            else:
                self.base = extend_index(self.base, books, profile=self.profile)
        clear_log(self.spark, self.log_path)
        discard(log)
        return n


def index_stream(spark: SparkSession, folder: str, schema: str, index_path: str, checkpoint: str, files_a_batch: int = 1000, **options) -> StreamingQuery:
    """Index Parquet files of books (ordinal, book_id, text) as they come to ``folder``: each micro-batch is appended to the saved index at ``index_path``, which
    ``load_index`` opens; one that runs again is recognised by its number. Options as for ``chunk_books``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def put(rows: DataFrame, number: int) -> None:
        append_books(spark, index_path, f"stream-{number}", rows, **options)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
