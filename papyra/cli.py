"""Command line: index a folder of books, search an index, add to it, commit; read dumps of works, enrich books, create tables."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from papyra.engine import Engine
from papyra.operators.index import committed
from papyra.operators.metadata import enrich, outcome_counts
from papyra.sources.books import read_works
from papyra.sources.state import create_tables


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="papyra", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("books")
    index.add_argument("path")
    index.add_argument("--chunk-size", type=int, default=1000)
    index.add_argument("--overlap", type=int, default=100)
    index.add_argument("--batch-size", type=int, default=100)
    index.add_argument("--stopword", action="append", default=[])
    query = commands.add_parser("search")
    query.add_argument("path")
    query.add_argument("text", nargs="+")
    query.add_argument("-k", type=int, default=10)
    query.add_argument("--metadata", help="Parquet table of books: hits are re-ranked with it")
    query.add_argument("--log", help="folder of the log of added documents, which are searched too")
    index.add_argument("--reindex", action="store_true", help="replace an index that is there")
    add = commands.add_parser("add")
    add.add_argument("path")
    add.add_argument("log")
    add.add_argument("file", nargs="+", help="text files; the name without extension is the book's id")
    flush = commands.add_parser("flush")
    flush.add_argument("path")
    flush.add_argument("log")
    flush.add_argument("--mode", choices=("discard", "commit"), default="commit")
    works = commands.add_parser("works", help="a dump of works as a Parquet table")
    works.add_argument("dump")
    works.add_argument("table")
    fill = commands.add_parser("enrich", help="ratings and counts of works for a Parquet table of books")
    fill.add_argument("books")
    fill.add_argument("works")
    fill.add_argument("table")
    commands.add_parser("create-tables")
    for p in (index, query, add, flush):
        p.add_argument("--profile", choices=("pt", "none"), default="pt")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("papyra").getOrCreate()
    if given.command == "index":
        if committed(spark, given.path) and not given.reindex:
            parser.error(f"{given.path} has an index; --reindex replaces it")
        engine = Engine.build(spark, given.books, given.path, given.stopword, given.chunk_size, given.overlap, given.batch_size, given.profile)
        print(engine.health()["documents"], "chunks")
    elif given.command == "add":
        engine = Engine.open(spark, given.path, profile=given.profile, log_path=given.log)
        rows = [(open(f, encoding="utf-8").read(), os.path.splitext(os.path.basename(f))[0], None, None) for f in given.file]
        engine.add_all(spark.createDataFrame(rows, "content string, book_id string, title string, author string"))
        print(len(rows), "added")
    elif given.command == "flush":
        print(Engine.open(spark, given.path, profile=given.profile, log_path=given.log).flush(given.mode), given.mode)
    elif given.command == "works":
        read_works(spark, given.dump).write.mode("overwrite").parquet(given.table)
        print(spark.read.parquet(given.table).count(), "works")
    elif given.command == "enrich":
        enrich(spark.read.parquet(given.books), spark.read.parquet(given.works)).write.mode("overwrite").parquet(given.table)
        outcome = F.when(F.col("ratings_average").isNotNull(), "rated").otherwise("not rated").alias("outcome")
        for r in outcome_counts(spark.read.parquet(given.table).select(outcome), "outcome").orderBy("outcome").collect():
            print(r.n, r.outcome)
    elif given.command == "create-tables":
        create_tables(spark)
    else:
        meta = spark.read.parquet(given.metadata) if given.metadata else None
        engine = Engine.open(spark, given.path, meta, profile=given.profile, log_path=given.log)
        asked = engine.queries(*given.text)
        if meta is not None:
            for r in engine.books(asked, given.k).orderBy("qid", "rank").collect():
                print(r.qid, r.rank, r.book_id, r.title, r.author, f"{r.score:.4f}", sep="\t")
        else:
            for r in engine.first_hits(asked, given.k).orderBy("qid", "place").collect():
                print(r.qid, r.place, r.book_id, r.doc_id, f"{r.score:.4f}", sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
