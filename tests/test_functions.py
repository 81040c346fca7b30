import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.functions.codecs import decode_postings, encode_postings, merge_postings
from papyra.functions.scoring import bm25, idf, popularity
from papyra.functions.stemmer import stem
from papyra.sources.parsers import epub_text, html_text, parse_bytes


def test_stems():
    assert [stem(w) for w in ("texto", "para", "analise")] == ["text", "par", "analis"]
    assert stem("a") == "a" and stem("xyz") == "xyz"


def test_tokens(spark):
    rows = [("Texto para ANÁLISE!",), ("Straße, œuvre x1y Ça",), ("",), (None,), ("a " + "b" * 26,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.tokens(F.col("t"))).collect()]
    assert got == [["texto", "para", "analise"], ["strasse", "oeuvre", "ca"], [], None, []]
    got = spark.createDataFrame(rows[:1], "t string").select(T.analyze(F.col("t"))).first()[0]
    assert got == ["text", "par", "analis"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é", max_size=600), st.integers(1, 150), st.integers(0, 60))
def test_chunks_cover_the_text(text, size, overlap):
    text = " ".join(text.split())
    if overlap >= size:
        return
    spans = T.chunk_spans(text, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= size for a, b in spans)
    assert all(a2 > a1 and a2 <= b1 for (a1, b1), (a2, _) in zip(spans, spans[1:]))


def test_chunk_column(spark):
    df = spark.createDataFrame([("x" * 1001,), ("x" * 1000,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.chunk_text(F.col("t"))).collect()]
    assert [None if g is None else [len(c) for c in g] for g in got] == [[1000, 101], [1000], [], None]
    with pytest.raises(ValueError):
        T.chunk_text(F.col("t"), 100, 100)


def test_keys(spark):
    row = spark.range(1).select(T.title_key(F.lit(" The  Título, (2nd)! ")), T.shard_key(F.lit("7")), T.known(F.lit("")), T.phrase_tokens(F.lit("A b-c!"))).first()
    assert list(row) == ["the título 2nd", "07", "Unknown", ["a", "bc"]]
    assert T.json_field('{"a": "x", "b": 1}', "a") == "x" and T.json_field("{}", "a") is None


def test_scores(spark):
    row = spark.range(1).select(
        F.round(popularity(F.lit(5.0), F.lit(100), F.lit(10000), F.lit(100)), 6), popularity(*[F.lit(None).cast("double")] * 4), popularity(F.lit(5.0), F.lit(9), F.lit(0), F.lit(0)),
        F.round(idf(F.lit(10), F.lit(1)), 6), F.round(bm25(F.lit(2.0), F.lit(1), F.lit(10), F.lit(10.0)), 6),
    ).first()
    assert list(row) == [1.6, 1.0, 1.0, 1.992430, 2.0]


@given(st.lists(st.tuples(st.integers(0, 2**31), st.integers(1, 10**6)), max_size=50))
def test_codec(postings):
    assert decode_postings(encode_postings(postings)) == sorted(postings)


def test_codec_merge():
    assert decode_postings(merge_postings(encode_postings([(1, 2)]), encode_postings([(1, 3), (0, 1)]))) == [(0, 1), (1, 2), (1, 3)]
    with pytest.raises(ValueError):
        decode_postings(b"\x80")


def test_parsers(tmp_path):
    import io
    import zipfile

    assert html_text("<head><title>t</title></head><body>a<p>b &amp; c</p><script>d</script></body>") == "a b & c d"
    assert html_text("<p>x</p>y") == "x y" and html_text(None) is None
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ch1.xhtml", "<body>one</body>")
        z.writestr("toc.xhtml", "<body>skip</body>")
        z.writestr("ch2.html", "<body>two</body>")
    assert epub_text(buffer.getvalue()) == "one two"
    assert epub_text(b"no archive") is None
    assert parse_bytes(b"a \n b", "txt") == "a b" and parse_bytes(b"\xff", "txt") is None and parse_bytes(b"a", "doc") is None and parse_bytes(None, "txt") is None


def test_stem_is_total():
    rng = random.Random(1)
    for _ in range(2000):
        w = "".join(rng.choices("aeioucrmnts", k=rng.randint(1, 14)))
        assert w.startswith(stem(w)[:1]) and len(stem(w)) <= len(w) + 1
