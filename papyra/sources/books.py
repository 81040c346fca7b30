"""Books from files, pages, catalogues and dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.operators.metadata import last_wins
from papyra.sources.parsers import book_page, html_text, parse_bytes
from papyra.tables import numbered

_EXTENSIONS = ("epub", "txt", "pdf")


def read_book_files(spark: SparkSession, folder: str) -> DataFrame:
    """(ordinal, book_id, path, md5, text) of the .epub, .txt and .pdf files of a folder, in that order, then by path; unreadable files are left out.

    ``book_id`` is the file's name without extension; ordinals keep the places of files that are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{epub,txt,pdf}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.element_at(F.split(name, r"\."), -1)
    kind = F.when(ext == "epub", 0).when(ext == "txt", 1).otherwise(2)
    order = numbered(files.select("path", kind.alias("kind")), ["kind", "path"], "ordinal").select("path", "ordinal")  # names only

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [parse_bytes(c, e) for c, e in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["path", "book_id", "md5", "text"])

    book_id = F.regexp_replace(name, r"\.[^.]*$", "")
    parsed = files.select("path", book_id.alias("book_id"), F.md5("content").alias("md5"), "content", ext.alias("ext")).mapInArrow(parse, "path string, book_id string, md5 string, text string")
    return parsed.where("text is not null").join(order, "path").select("ordinal", "book_id", "path", "md5", "text")


def html_to_text(html):
    """Column of the text of a column of pages."""
    return F.pandas_udf(lambda s: pd.Series([html_text(t) for t in s], dtype=object), "string")(html)


def page_metadata(html):
    """Column of (title, properties, files) of a column of catalogue pages."""
    kind = "title string, properties map<string,string>, files array<struct<format string, url string>>"

    def run(s: pd.Series) -> pd.DataFrame:
        found = [book_page(t) or {"title": None, "properties": None, "files": None} for t in s]
        return pd.DataFrame(found, columns=["title", "properties", "files"], dtype=object)

    return F.pandas_udf(run, kind)(html)


def linked_books(html, limit: int):
    """Array of distinct book numbers among the first ``limit`` book links of a page."""
    return F.array_distinct(F.slice(F.regexp_extract_all(html, F.lit(r"/ebooks/(\d+)"), 1), 1, limit))


def read_catalog(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(book_id, title, author, language, subjects, issued) from a catalogue CSV with or without byte-order mark; rows without number go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    names = {"Text#": "book_id", "Title": "title", "Authors": "author", "Language": "language", "Subjects": "subjects", "Issued": "issued"}
    rows = raw.where(F.col("`Text#`").isNotNull() & (F.col("`Text#`") != "")).select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
    return rows if limit is None else rows.limit(limit)


_WORK = "key string, title string, authors array<struct<author:struct<key:string>>>, subjects array<string>, editions array<string>, ratings_average double, ratings_count int, want_to_read_count int, edition_count int"


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """(key, title, authors, ratings_average, ratings_count, want_to_read_count, edition_count, subjects) from a dump of works: tab-separated type, key,
    revision, time, JSON. Other types, short lines and broken JSON are skipped; of one key the latest revision counts."""
    parts = F.split("value", "\t", 5)
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") == 5) & (F.col("p")[0] == "/type/work"))
    rows = rows.select(F.element_at(F.split(F.col("p")[1], "/"), -1).alias("key"), F.col("p")[2].try_cast("int").alias("revision"), F.col("p")[3].alias("at"), F.from_json(F.col("p")[4], _WORK).alias("w"))
    rows = last_wins(rows.where("w.title is not null").withColumn("__o", F.struct("revision", "at")), ["key"], "__o")
    authors = F.transform(F.filter("w.authors", lambda a: a["author"]["key"].isNotNull()), lambda a: F.element_at(F.split(a["author"]["key"], "/"), -1))
    editions = F.coalesce("w.edition_count", F.when(F.col("w.editions").isNotNull(), F.size("w.editions")))
    return rows.select("key", "w.title", authors.alias("authors"), "w.ratings_average", "w.ratings_count", "w.want_to_read_count", editions.alias("edition_count"), F.slice("w.subjects", 1, 10).alias("subjects"))


def preferred_format(candidates: DataFrame, order: tuple[str, ...] = _EXTENSIONS, least_bytes: int = 100) -> DataFrame:
    """Of fetched candidates (book_id, format, status, bytes, ...) the first good one of each book: status 200, more than ``least_bytes``, in the order of formats."""
    rank = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("format"))
    good = candidates.where((F.col("status") == 200) & (F.col("bytes") > least_bytes) & (rank > 0))
    return good.withColumn("__n", F.row_number().over(W.partitionBy("book_id").orderBy(rank))).where("__n = 1").drop("__n")
