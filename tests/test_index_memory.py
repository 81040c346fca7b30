"""The index's steps hold some chunks at a time, move texts once, and give what cutting book by book gives."""

import hashlib
import random
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import index as ix

BOOK = "ordinal long, book_id string, text string"


def test_every_character_as_in_spark(spark):
    texts = [f"ab{c}cd {c} {c}" for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (ord(c) < 0x3100 or not ord(c) % 97)]
    rows = spark.createDataFrame(pa.table({"i": range(len(texts)), "t": texts})).select("i", T.tokens(F.col("t")).alias("w"), T.normalize_whitespace(F.col("t")).alias("s")).toArrow().sort_by("i")
    assert T.token_lists(texts).to_pylist() == rows["w"].to_pylist()
    assert [T.squeezed(t) for t in texts] == rows["s"].to_pylist()


def by_hand(rows, start, **options):
    first = {}
    for ordinal, book_id, text in sorted(rows):
        if t := T.squeezed(text or ""):
            first.setdefault(t, (ordinal, book_id))
    out = []
    for t, (ordinal, book_id) in sorted(first.items(), key=lambda x: x[1][0]):
        seq = 0
        for a, b in T.chunk_spans(t, 40, 5):
            chunk = t[a:b].strip()
            every = T.python_tokens(chunk)
            if own := [w for w in every if w not in options.get("stopwords", ())]:
                out.append((start + len(out), book_id, ordinal, seq, chunk, len(every), ordinal // 7, own))
                seq += 1
    return out


@pytest.mark.parametrize("stopwords", [(), ("ab", "the")])
def test_chunks_as_by_hand(spark, monkeypatch, stopwords):
    rng = random.Random(3)
    words = ["ab", "the", "Straße", "1", "x", "été", "　", "\n\n", "z" * 26, "longer", "\x1f"]
    texts = [None, "", " \t", "1 2", *(" ".join(rng.choices(words, k=rng.choice([1, 3, 30, 90]))) for _ in range(200))]
    rows = [(i * 3, str(i), t) for i, t in enumerate(texts + texts[50:80])]
    monkeypatch.setattr(ix, "CHUNK_BUCKET", 16)
    monkeypatch.setattr(ix, "_TOGETHER", 100)
    got = ix.chunk_books(spark.createDataFrame(rows, BOOK).repartition(3), stopwords, 40, 5, start_doc_id=9, batch_size=7)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 9, stopwords=stopwords)
    assert got.columns[:7] == [c.split()[0] for c in ix.schemas.CHUNKS.split(", ")]


def test_a_long_book_is_cut_some_chunks_at_a_time():
    text = "some words of a book " * 400_000
    digest = hashlib.sha256(T.squeezed(text).encode()).digest()
    columns = pa.array([0, 0]), pa.array([5, 5]), pa.array([digest, None], pa.binary()), pa.array([None, "5"]), pa.array([None, text])
    rows = pa.RecordBatch.from_arrays(list(columns), names=["b", "ordinal", "sha", "book_id", "text"])
    largest, n = 0, 0
    tracemalloc.start()
    for batch in ix._cut(iter([rows]), 1000, 100, [], False, 100, False):
        largest, n = max(largest, batch.nbytes), n + batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 9000 and largest < 4 << 20 and peak < 9 * len(text), (n, largest, peak)


def test_few_tables_are_written(spark, monkeypatch):
    """Before: books, chunks and postings, and texts with their tokens went through a shuffle."""
    names, write = [], ix.materialize
    monkeypatch.setattr(ix, "materialize", lambda df, name, *a: names.append(name) or write(df, name, *a))
    own = ix.build_index(spark.createDataFrame([(0, "0", "one two two"), (1, "1", "two three")], BOOK))
    assert own.stats.first().n == 2 and names == ["chunks", "buckets"]
    assert {r.term: r.df for r in own.vocab.collect()} == {"one": 1, "two": 2, "three": 1} and own.vocab is own.vocab and names == ["chunks", "buckets", "vocab"]
    assert sorted(map(tuple, own.postings.collect())) == [("one", 0, 1, 3), ("three", 1, 1, 2), ("two", 0, 2, 3), ("two", 1, 1, 2)]
    assert sorted(map(tuple, ix.build_index(own.chunks, keep=False).vocab.collect())) == [("one", 1), ("three", 1), ("two", 2)]
