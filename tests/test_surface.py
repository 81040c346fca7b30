"""The library's surface: adding and flushing, missing books, SQL functions, command line, tables, metadata of chunks."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra import cli
from papyra.engine import Engine, register_functions
from papyra.functions.text import python_tokens, tokens
from papyra.operators import metadata as md
from papyra.sources import state

BOOK = "source string, book_id string, title string, author string, cover_url string"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "1.txt").write_text("os livros velhos da casa")
    (d / "2.txt").write_text("python programming for people")
    return d


def test_add_flush_and_missing(spark, tmp_path, folder):
    path, log = str(tmp_path / "i"), str(tmp_path / "log")
    plain = Engine.build(spark, str(folder), path)
    with pytest.raises(ValueError):
        plain.add("x")
    e = Engine.open(spark, path, spark.createDataFrame([("s", "1", "Livros", "Ann", None)], BOOK), log_path=log)
    e.add("novas casas brancas", "7", "Casas", "Bo")
    assert {r.book_id for r in e.search(e.queries("casas")).collect()} == {"1", "7"}
    assert e.flush("commit") == 1 and e.is_indexed("7") and not e.is_indexed("8")
    assert {r.book_id for r in Engine.open(spark, path).search(e.queries("brancas")).collect()} == {"7"}
    assert e.book("s", "1")["title"] == "Livros"
    with pytest.raises(LookupError):
        e.book("s", "99")
    rows = {r.book_id: json.loads(r.metadata) for r in e.chunk_metadata().collect()}
    assert rows["1"]["title_tokens"] == ["livr", "ann"] and rows["1"]["chunk_id"] == 0 and rows["7"]["title_tokens"] == []


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT analyze('Os Livros, da CASA') a, tokenize('Os Livros') t, chunk_text(repeat('word ', 300)) c, parse_book(encode('x  y', 'utf-8'), 'txt') p, size(decode_postings(encode_postings(array(struct(7L AS doc_id, 2 AS tf), struct(9L AS doc_id, 1 AS tf))))) n").first()
    assert (r.a, r.t, len(r.c), r.p, r.n) == (["os", "livr", "da", "cas"], ["os", "livros"], 2, "x y", 2)


def test_command_line(spark, tmp_path, folder, capsys):
    path, log = str(tmp_path / "i"), str(tmp_path / "log")
    assert cli.main(["index", str(folder), path]) == 0
    with pytest.raises(SystemExit):
        cli.main(["index", str(folder), path])
    cli.main(["index", str(folder), path, "--reindex"])
    (tmp_path / "9.txt").write_text("fresh words")
    cli.main(["add", path, log, str(tmp_path / "9.txt")])
    capsys.readouterr()
    cli.main(["search", path, "fresh", "--log", log])
    assert "\t9\t" in capsys.readouterr().out
    cli.main(["flush", path, log])
    cli.main(["search", path, "fresh"])
    assert "\t9\t" in capsys.readouterr().out


def test_tables(spark):
    for name in state.TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql("CREATE TABLE seed_offsets (source string) USING parquet")
    state.create_tables(spark)
    assert spark.table("seed_offsets").columns == ["source", "position", "last_book_id"] and "cover_url" in spark.table("books").columns
    rows = spark.createDataFrame([("s", 5, "9")], "source string, position bigint, last_book_id string")
    got = state.seed_offsets(rows, spark.createDataFrame([("s",), ("t",)], "source string")).orderBy("source").collect()
    assert [tuple(r) for r in got] == [("s", 5, "9"), ("t", -1, None)] and state.counts(a=rows) == {"a": 1}
    for name in state.TABLES:
        spark.sql(f"DROP TABLE {name}")


def test_covers(spark):
    rows = [("gutenberg", "5", None, None, None), ("gutenberg", "6", None, None, "own"), ("other", "7", None, None, None)]
    assert [r.cover_url and r.cover_url[-23:] for r in md.with_cover(spark.createDataFrame(rows, BOOK)).collect()] == ["/5/pg5.cover.medium.jpg", "own", None]
    with pytest.raises(Exception, match="required"):
        md.with_cover(spark.createDataFrame([(None, "5", None, None, None)], BOOK)).collect()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_tokens_in_python(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    # Lower case of a few letters differs between Java and Python; the engine's tables have Java's.
    texts = [t for t in texts if all(c.lower() == c or c.isascii() for c in t)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.w for r in rows.select("i", tokens(F.col("t")).alias("w")).collect()} == {i: python_tokens(t) for i, t in enumerate(texts)}
