"""Registered queries that write and read again: saved, appended, streamed and committed indexes, logs, dumps, catalogues, book files, chunk stores, codecs, state."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.codecs import decode_lists, encode_lists
from papyra.functions.text import normalize_whitespace
from papyra.memory import by_length, trimmed
from papyra.operators import index as ix
from papyra.operators import metadata as md
from papyra.operators.search import search
from papyra.plans.catalog import _BASE, _KEY, _META, _SEARCH, _books, _hits, _meta, _queries, _query, _table, _tok
from papyra.sources import sinks, state
from papyra.sources.books import read_book_files, read_catalog, read_works
from papyra.streaming.realtime import RealtimeIndex, index_stream
from papyra.tables import file_system, materialize, new_path

#: Where the second batch of an index begins.
_HALF = 500


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by distinct text, white space normalised: batches of an index do not look for equal texts in each other."""
    return materialize(ix.dedup_books(_books(spark, sf_dir).withColumn("text", normalize_whitespace("text"))), "unique", "zstd")


@_query(f"{_SEARCH}, {_hits(10)} SELECT * FROM hits")
def saved_index(spark, sf_dir):
    path = new_path(spark, "saved")
    ix.save_index(ix.build_index(_books(spark, sf_dir)), path)
    return search(ix.load_index(spark, path), _queries(spark))


@_query(f"{_BASE} SELECT doc_id, book_id, seq, dl, text FROM chunks")
def appended_index(spark, sf_dir):
    path, books = new_path(spark, "appended"), _unique(spark, sf_dir)
    ix.save_index(ix.build_index(books.where(F.col("ordinal") < _HALF)), path)
    for _ in range(2):  # a batch that is there already is not added again
        ix.append_books(spark, path, "more", books.where(F.col("ordinal") >= _HALF))
    return ix.load_index(spark, path).chunks.select("doc_id", "book_id", "seq", "dl", "text")


@_query(f"{_BASE} SELECT term, df FROM vocab")
def streamed_index(spark, sf_dir):
    source, path, checkpoint, books = new_path(spark, "source"), new_path(spark, "streamed"), new_path(spark, "checkpoint"), _unique(spark, sf_dir)
    for part in (F.col("ordinal") < _HALF, F.col("ordinal") >= _HALF):
        books.where(part).write.mode("append").option("compression", "zstd").parquet(source)
        index_stream(spark, source, "ordinal long, book_id string, text string", path, checkpoint).awaitTermination()
    return ix.load_index(spark, path).vocab


@_query(f"{_BASE} SELECT term, df FROM vocab")
def committed_log(spark, sf_dir):
    path, log, books = new_path(spark, "index"), new_path(spark, "log"), _unique(spark, sf_dir)
    ix.save_index(ix.build_index(books.where(F.col("ordinal") % 3 != 0)), path)
    RealtimeIndex(spark, None, log, path).add(books.where(F.col("ordinal") % 3 == 0).select(F.col("text").alias("content"), F.to_json(F.struct("book_id")).alias("metadata")))
    RealtimeIndex(spark, None, log, path).flush("commit")  # another opening finds the log
    return RealtimeIndex(spark, None, log, path).base.vocab


@_query(f"{_BASE} SELECT doc_id, book_id, seq, text FROM chunks WHERE book_id = '7' AND seq = 0")
def chunk_store(spark, sf_dir):
    path = new_path(spark, "store")
    sinks.write_chunks(ix.build_index(_books(spark, sf_dir)).chunks, path)
    return sinks.read_chunk(spark, path, "7", 0).select("doc_id", "book_id", "seq", "text")


@_query("SELECT doc_id AS id, text AS content, 0 AS length FROM documents")
def log_scan(spark, sf_dir):
    path, rows = new_path(spark, "log"), _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("{}").alias("metadata"), F.lit(0).alias("length"))
    sinks.append_log(spark, path, rows.where("id % 2 = 0"))
    sinks.append_log(spark, path, rows.where("id % 2 = 1"))
    return sinks.read_log(spark, path).select("id", "content", "length")


@_query("SELECT doc_id, source FROM documents WHERE length(text) < 100")
def rejected_rows(spark, sf_dir):
    path = new_path(spark, "rejects")
    sinks.write_rejects(_table(spark, sf_dir, "documents").where("length(text) < 100").select("doc_id", "source"), path)
    return spark.read.schema("doc_id long, source string").json(path)


@_query("SELECT 'OL' || doc_id || 'W' AS key, lang || ' ' || doc_id AS title, 'OL' || doc_id % 9 || 'A' AS author, doc_id / 8 AS ratings_average, CAST(doc_id % 5 AS INTEGER) AS edition_count FROM documents WHERE doc_id % 4 <> 0")
def works_dump(spark, sf_dir):
    """Each work in two revisions, the later of which counts, among lines of other types and broken ones."""
    path, d = new_path(spark, "dump"), _table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    author = F.array(F.struct(F.struct(F.concat(F.lit("/authors/OL"), i % 9, F.lit("A")).alias("key")).alias("author")))
    work = lambda title: F.to_json(F.struct(title.alias("title"), author.alias("authors"), (i / 8).alias("ratings_average"), (i % 5).cast("int").alias("edition_count")))
    line = lambda revision, title: F.concat_ws("\t", F.when(i % 4 != 0, "/type/work").otherwise("/type/edition"), F.concat(F.lit("/works/OL"), i, F.lit("W")), F.lit(revision), F.lit("2020"), work(title))
    lines = d.select(F.explode(F.array(line("2", F.lit("old")), line("10", F.concat_ws(" ", "lang", i)), F.lit("short"), F.lit("/type/work\t/works/X\t1\t2\t{broken"))).alias("value"))
    lines.write.text(path)
    return read_works(spark, path).select("key", "title", F.col("authors")[0].alias("author"), "ratings_average", "edition_count")


@_query("SELECT CAST(doc_id AS VARCHAR) AS book_id, source || ', \"' || lang || '\"' AS title, source AS author, lang AS language FROM documents")
def catalog_csv(spark, sf_dir):
    path, d = new_path(spark, "catalog"), _table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("Text#"), F.concat("source", F.lit(', "'), "lang", F.lit('"')).alias("Title"), F.col("source").alias("Authors"), F.col("lang").alias("Language"), F.lit("").alias("Subjects"), F.lit("2001").alias("Issued"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return read_catalog(spark, path).select("book_id", "title", "author", "language")


@_query("SELECT row_number() OVER (ORDER BY CAST(item_id AS VARCHAR) || '.txt') - 1 AS ordinal, CAST(item_id AS VARCHAR) AS book_id, md5(text) AS md5, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def book_files(spark, sf_dir):
    """A text file for each row of the small table of items, read as books."""
    path = new_path(spark, "books")
    for r in _table(spark, sf_dir, "benchmark").select("item_id", "text").toLocalIterator():
        fs, where = file_system(spark, f"{path}/{r.item_id}.txt")
        out = fs.create(where, True)
        out.write(r.text.encode())
        out.close()
    return read_book_files(spark, path).select("ordinal", "book_id", "md5", "text")


def _bytes(x: str) -> str:
    return f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 ELSE 4 END"


@_query(f"""{_BASE}, d AS (SELECT term, doc_id, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS delta FROM postings)
SELECT term, CAST(sum({_bytes('delta')} + {_bytes('tf')}) AS BIGINT) AS n_bytes, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM d GROUP BY term""")
def posting_bytes(spark, sf_dir):
    """Posting lists as bytes, and read from them again."""

    def run(batches):
        for batch in by_length(batches, 1):
            data = encode_lists(batch.column(1))
            ends, doc, tf = decode_lists(data)
            pairs = pc.binary_join_element_wise(*(pa.array(x).cast(pa.string()) for x in (doc, tf)), ":")
            back = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pairs), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(data).cast(pa.int64()), back], names=["term", "n_bytes", "postings"])

    lists = ix.posting_lists(ix.build_index(_books(spark, sf_dir)).postings)
    return lists.select("term", "postings").mapInArrow(lambda it: trimmed(run(it)), "term string, n_bytes long, postings string")


@_query(f"""{_BASE}, meta AS ({_META}) SELECT doc_id, m.title, len({_tok("coalesce(m.title, '') || ' ' || coalesce(m.author, '')")}) AS n_title_tokens,
  array_to_string({_tok("coalesce(m.title, '') || ' ' || coalesce(m.author, '')")}, ' ') AS title_tokens FROM chunks LEFT JOIN meta m USING (book_id)""")
def chunk_metadata(spark, sf_dir):
    rows = md.chunk_metadata(ix.build_index(_books(spark, sf_dir)).chunks, _meta(spark, sf_dir), profile="none")
    found = F.from_json("metadata", "chunk_id long, title string, title_tokens array<string>")
    rows = rows.select(found.alias("m"))
    return rows.select(F.col("m.chunk_id").alias("doc_id"), "m.title", F.size("m.title_tokens").cast("long").alias("n_title_tokens"), F.array_join("m.title_tokens", " ").alias("title_tokens"))


@_query("SELECT source, CASE WHEN source <= 'src2' THEN -1 ELSE max(doc_id) END AS position, CASE WHEN source <= 'src2' THEN NULL ELSE CAST(max(doc_id) AS VARCHAR) END AS last_book_id FROM documents GROUP BY source")
def seed_offsets(spark, sf_dir):
    """Positions set twice; sources up to 'src2' have none."""
    d = _table(spark, sf_dir, "documents").where("source > 'src2'").groupBy("source").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    empty = spark.createDataFrame([], state.schemas.SEED_OFFSETS)
    first = state.set_offsets(empty, d.select("source", F.col("a").alias("position"), F.col("a").cast("string").alias("last_book_id")))
    second = state.set_offsets(first, d.select("source", F.col("b").alias("position"), F.col("b").cast("string").alias("last_book_id")))
    return state.seed_offsets(second, _table(spark, sf_dir, "documents"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query(f"""SELECT book_id, title, CASE WHEN CAST(book_id AS BIGINT) % 2 = 0 THEN 'https://www.gutenberg.org/cache/epub/' || book_id || '/pg' || book_id || '.cover.medium.jpg' ELSE 'own' END AS cover_url,
  {_KEY.format('title')} AS title_key FROM ({_META})""")
def cover_urls(spark, sf_dir):
    from papyra.functions.text import title_key

    rows = _meta(spark, sf_dir).withColumn("source", F.lit("gutenberg")).withColumn("cover_url", F.when(F.col("book_id").cast("long") % 2 != 0, "own"))
    return md.with_cover(rows).select("book_id", "title", "cover_url", title_key(F.col("title")).alias("title_key"))

