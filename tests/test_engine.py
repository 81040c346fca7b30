import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyra.engine import Engine, register_functions
from papyra.operators import index as ix
from papyra.operators import metadata as md
from papyra.operators.rerank import rerank_books, rerank_editions
from papyra.operators.search import first_hits, search, search_rarest
from papyra.sources import books as sb
from papyra.sources import sinks
from papyra.streaming.realtime import RealtimeIndex, index_stream

TEXTS = ["the quick brown fox jumps over the lazy dog " * 20, "liberty and justice for all people " * 20, "python programming is fun for people " * 20]


def books(spark, texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "ordinal long, book_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


@pytest.fixture(scope="module")
def index(spark):
    return ix.build_index(books(spark, TEXTS))


def brute(docs, query, k1=1.5, b=0.75):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        tf, s = Counter(d), 0.0
        for t in query:
            df = sum(t in x for x in docs)
            if tf[t]:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg))
        if s:
            out[i] = round(s, 6)
    return out


def test_search(spark, index):
    hits = search(index, asked(spark, "fox", "people", "", "zzzzzzz", "pythom", "people people")).collect()
    by = {q: [(r.book_id, r.score) for r in sorted(hits, key=lambda r: r.rank) if r.qid == q] for q in range(6)}
    assert [b for b, _ in by[0]] == ["0"] and sorted(b for b, _ in by[1]) == ["1", "2"] and not by[2] and not by[3]
    assert [b for b, _ in by[4]] == ["2"]
    assert [round(2 * s, 5) for _, s in by[1]] == [round(s, 5) for _, s in by[5]]
    docs = [[t for t in x.split() if len(t) > 1] for x in TEXTS]
    assert {int(b): s for b, s in by[1]} == pytest.approx(brute(docs, ["people"]), abs=2e-6)
    assert search(index, asked(spark, "people"), 1).count() == 1 and search(index, asked(spark, "people"), 0).count() == 0
    assert search_rarest(index, asked(spark, "people fox")).collect()[0].doc_id == 0
    assert first_hits(search(index, asked(spark, "people"))).count() == 2


def test_rarest_narrows(spark):
    texts = [f"common item{'x' * (i % 3)} " + ("rare" if i % 2 else "other") for i in range(80)]
    own = ix.build_index(books(spark, [f"{t} w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i, t in enumerate(texts)]))
    hits = search_rarest(own, asked(spark, "rare common"), 5)
    assert hits.count() == 5 and {r.doc_id % 2 for r in hits.collect()} == {1}


def test_index(spark, tmp_path, index):
    assert index.stats.first().n == 3
    twice = ix.build_index(books(spark, [TEXTS[0], None, "", TEXTS[0], "1 2 3", "b" * 2000]))
    assert sorted((r.doc_id, r.book_id) for r in twice.chunks.collect()) == [(0, "0")]
    ix.save_index(index, str(tmp_path / "i"))
    again = ix.load_index(spark, str(tmp_path / "i"))
    assert {(r.doc_id, r.score) for r in search(again, asked(spark, "fox people")).collect()} == {(r.doc_id, r.score) for r in search(index, asked(spark, "fox people")).collect()}
    more = ix.add_books(index, books(spark, [TEXTS[0], "x", "y", "fresh words come here"]).where("ordinal <> 1"))
    assert sorted(r.doc_id for r in more.chunks.collect()) == [0, 1, 2, 3]
    empty = ix.build_index(books(spark, ["a"]).limit(0))
    assert empty.stats.first().avgdl == 0 and search(empty, asked(spark, "fox")).count() == 0


def test_stopwords(spark):
    c = ix.chunk_books(books(spark, ["the and", "the fox"]), stopwords=["the", "and"]).collect()
    assert [(r.book_id, r.dl, r.tokens) for r in c] == [("1", 2, ["fox"])]
    assert ix.chunk_books(books(spark, ["the and"]), stopwords=["the", "and"], keep_all_stopword=True).count() == 1
    assert ix.chunk_books(books(spark, ["texto analise"]), profile="pt").first().tokens == ["text", "analis"]


def test_dense_ids(spark):
    rows = [(i, i % 3) for i in range(10000)]
    got = dict(ix.dense_ids(spark.createDataFrame(rows, "ordinal long, n long"), 5).collect())
    total = 5
    for i, n in rows:
        assert got[i] == total
        total += n


def test_postings(spark, index):
    one = {r.term: r.postings for r in ix.posting_lists(index.postings).collect()}
    assert [tuple(p) for p in one["people"]] == [(1, 20), (2, 20)]
    delta = ix.posting_deltas(index.postings).where("term = 'people'").orderBy("doc_id").collect()
    assert [r.delta for r in delta] == [1, 1]


META = "source string, book_id string, title string, author string, ratings_average double, ratings_count long, want_to_read_count long, edition_count int"


def hits(spark, rows):
    return spark.createDataFrame([(0, i + 1, d, b, s) for i, (b, s, d) in enumerate(rows)], "qid long, rank int, doc_id long, book_id string, score double")


def test_editions(spark):
    meta = spark.createDataFrame([("s", "1", "Python Guide", "Ann Lee", None, None, None, None), ("s", "2", "python: guide!", "Ann Lee", None, None, None, None), ("s", "3", "", None, 5.0, 100, 10000, 100)], META)
    got = rerank_editions(hits(spark, [("1", 0.95, 7), ("2", 0.9, 8), ("3", 0.5, 9), ("999", 3.0, 1)]), asked(spark, "python guide"), meta).orderBy("rank").collect()
    assert [(r.book_id, r.score, r.title) for r in got] == [("1", round(0.95 * 1.5, 6), "Python Guide"), ("3", 0.8, "Unknown")]
    got = rerank_editions(hits(spark, [("1", 1.0, 7)]), asked(spark, "lee"), meta).first()
    assert got.score == 2.0


def test_books(spark):
    meta = spark.createDataFrame([("s", "1", "python programming", "x", 5.0, 1000, 10000, 50), ("s", "2", "other dictionary", "x", None, None, None, None)], META)
    avg = spark.createDataFrame([(100.0,)], "avgdl double")
    got = rerank_books(hits(spark, [("1", 2.0, 1), ("1", 1.0, 2), ("2", 4.0, 3), ("9", 1.0, 4)]), asked(spark, "python programming"), meta, avg).orderBy("rank").collect()
    p = math.log(11)
    one = lambda s: (s + 12) * 1.3 * p * 1.2
    expect = [("1", (one(2) + 0.2 * one(1)) * 1.3 * 1.5 * 1.2), ("2", 4 * p * 0.7 * 0.9), ("9", p)]
    assert [(r.book_id, r.score) for r in got] == [(b, round(s, 6)) for b, s in expect]


def test_metadata(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "n", 7)], "id int, v string, keep int")
    new = spark.createDataFrame([(2, "B", 0), (3, "C", 1), (None, "N", 0)], "id int, v string, keep int")
    assert sorted(map(tuple, md.upsert(old, new, ["id"], ["keep"]).collect()), key=str) == sorted([(1, "a", 5), (2, "B", 6), (3, "C", 1), (None, "N", 7)], key=str)
    assert md.insert_missing(old, new, ["id"]).where("id = 2").first().v == "b"
    assert md.next_id(old.limit(0), "id").first()[0] == 0
    assert md.members(old, old.limit(0), "id").count() == 0
    works = spark.createDataFrame([("W1", "The Great Gatsby", ["Scott"], 4.5, 100, 5000, 20), ("W2", "The Great Gatsby Again", None, 1.0, 1, 1, 1)], "key string, title string, authors array<string>, ratings_average double, ratings_count int, want_to_read_count int, edition_count int")
    asked_ = spark.createDataFrame([("g", "1", "Great Gatsby!", "x", None, None, None, None), ("g", "2", "Missing", "x", None, None, None, None), ("g", "3", None, None, 2.0, None, None, None)], META)
    got = {r.book_id: r.ratings_average for r in md.enrich(asked_, works).collect()}
    assert got == {"1": 4.5, "2": None, "3": 2.0}
    q = md.latency_quantiles(spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "ms double"), "ms").first()
    assert (q.p50, q.p90, q.p99, q.mean) == (50.5, 90.9, 99.99, 50.5)
    assert md.latency_quantiles(spark.createDataFrame([(3.0,)], "ms double"), "ms").first().p90 == 0


def test_files(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "1.txt").write_text("one two\nthree")
    (d / "2.txt").write_bytes(b"\xff\xfe")
    (d / "3.md").write_text("no")
    rows = sb.read_book_files(spark, str(d)).collect()
    assert [(r.ordinal, r.book_id, r.text) for r in rows] == [(0, "1", "one two three")]
    c = tmp_path / "c.csv"
    c.write_text('﻿Text#,Title,Authors,Language,Subjects,Issued\n1,"A, ""b""",X,en,S,2001\n,none,,,,\n', encoding="utf-8")
    assert [tuple(r) for r in sb.read_catalog(spark, str(c)).collect()] == [("1", 'A, "b"', "X", "en", "S", "2001")]
    w = tmp_path / "w.txt"
    body = {"title": "T", "authors": [{"author": {"key": "/authors/OL1A"}}], "subjects": [str(i) for i in range(12)]}
    w.write_text("\n".join(["\t".join(["/type/work", "/works/OL1W", v, "2020", json.dumps(body | {"title": t})]) for v, t in (("2", "old"), ("10", "T"))] + ["/type/edition\t/e\t1\t2\t{}", "short", "/type/work\t/works/X\t1\t2\t{broken"]))
    got = sb.read_works(spark, str(w)).collect()
    assert [(r.key, r.title, r.authors, len(r.subjects)) for r in got] == [("OL1W", "T", ["OL1A"], 10)]
    page = spark.createDataFrame([('<h1>Book by Ann</h1><table><tr><th>Language</th><td>en</td></tr></table><a href="/ebooks/5">x</a><a href="/ebooks/5">y</a><a href="/ebooks/6">z</a>',), (None,)], "h string")
    r = page.select(sb.page_metadata(F.col("h")).alias("m"), sb.linked_books(F.col("h"), 2).alias("l")).collect()
    assert (r[0].m.title, r[0].m.properties, r[0].l, r[1].m.title) == ("Book", {"Language": "en"}, ["5"], None)
    got = spark.createDataFrame([("1", "txt", 200, 500), ("1", "epub", 200, 50), ("2", "epub", 404, 500)], "book_id string, format string, status int, bytes int")
    assert [(r.book_id, r.format) for r in sb.preferred_format(got).collect()] == [("1", "txt")]


def test_sinks(spark, tmp_path, index):
    sinks.write_chunks(index.chunks, str(tmp_path / "c"))
    assert sinks.read_chunk(spark, str(tmp_path / "c"), "1", 0).count() == 1 and sinks.read_chunk(spark, str(tmp_path / "c"), "1", 9).count() == 0
    log = tmp_path / "w"
    log.mkdir()
    (log / "a.json").write_text(sinks.log_line(4, "x y", {"book_id": "7"}) + "\n\n{broken\n")
    assert [(r.id, r.content) for r in sinks.read_log(spark, str(log)).collect()] == [(4, "x y")]


def test_realtime(spark, tmp_path, index):
    path = str(tmp_path / "log")
    own = RealtimeIndex(spark, index, path)
    assert own.search(asked(spark, "fox")).count() == 1
    own.add(spark.createDataFrame([("a fox in the snow", '{"book_id": "77"}'), ("no animals", None)], "content string, metadata string"))
    found = {r.book_id for r in own.search(asked(spark, "fox")).collect()}
    assert found == {"0", "77"}
    again = RealtimeIndex(spark, index, path)
    assert {r.doc_id for r in again.search(asked(spark, "animals")).collect()} <= {3, 4}
    assert again.search(asked(spark, "fox"), one_scale=True).count() == 2
    src = tmp_path / "in"
    spark.createDataFrame([("streamed fox", None)], "content string, metadata string").write.parquet(str(src))
    stream = spark.readStream.schema("content string, metadata string").parquet(str(src))
    again.add_stream(stream, str(tmp_path / "cp")).awaitTermination()
    assert again.search(asked(spark, "streamed")).count() == 1
    assert again.flush("commit") == 3 and again.search(asked(spark, "streamed")).count() == 1
    assert again.flush() == 0
    with pytest.raises(ValueError):
        again.flush("else")


def test_index_stream(spark, tmp_path):
    books(spark, TEXTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        index_stream(spark, str(tmp_path / "in"), "ordinal long, book_id string, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()) == [0, 1, 2]


def test_engine(spark, tmp_path):
    d = tmp_path / "b"
    d.mkdir()
    for i, t in enumerate(TEXTS):
        (d / f"{i}.txt").write_text(t)
    e = Engine.build(spark, str(d), str(tmp_path / "i"))
    assert e.health() == {"status": "ok", "documents": 3}
    assert e.first_hits(e.queries("programming")).first().book_id == "2"
    with pytest.raises(ValueError):
        e.editions(e.queries("x"))
    register_functions(spark)
    assert spark.sql("SELECT stem('texto')").first()[0] == "text"
