"""Posting lists as bytes by array arithmetic agree with those one at a time; grouped postings with single ones."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions.codecs import decode_lists, decode_postings, encode_lists, encode_postings
from papyra.memory import by_length
from papyra.operators import index as ix

KIND = pa.list_(pa.struct([("doc_id", pa.int64()), ("tf", pa.int32())]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.integers(0, 300), st.integers(0, 2**62)), st.integers(1, 2**31 - 1)), max_size=8), max_size=8), st.integers(0, 3))
def test_as_one_at_a_time(rows, skip):
    lists = pa.array([[{"doc_id": d, "tf": t} for d, t in sorted(r)] for r in rows], KIND).slice(skip)
    data = encode_lists(lists)
    assert data.to_pylist() == [encode_postings(r) for r in rows[skip:]]
    whole = pa.array([encode_postings(r) for r in rows], pa.binary())
    ends, doc, tf = decode_lists(whole.slice(min(skip, len(whole))))
    pairs = list(zip(doc.tolist(), tf.tolist()))
    assert [pairs[a:b] for a, b in zip(ends, ends[1:])] == [decode_postings(encode_postings(r)) for r in rows[skip:]]


@pytest.mark.parametrize("data", [[b"\x80"], [b"\x01"], [b"\x01", b"\x01"], [b"", b"\x81", b"\x01\x01"]])
def test_cut_bytes(data):
    with pytest.raises(ValueError):
        decode_lists(pa.array(data, pa.binary()))


def test_slices():
    rows = pa.RecordBatch.from_arrays([pa.array([[1] * n for n in (3, 0, 2, 9, 1, 1)])], names=["x"])
    assert [b.num_rows for b in by_length(iter([rows, rows.slice(0, 0)]), 0, 5)] == [3, 1, 2]


def test_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "_GROUP", 3)
    own = ix.build_index(spark.createDataFrame([(i, str(i), f"all two{'x' * (i % 3)} all w{chr(97 + i % 26)}") for i in range(40)], "ordinal long, book_id string, text string"))
    plain = own.postings.select("*")
    one, two = (sorted(map(str, ix.posting_lists(p).collect())) for p in (own.postings, plain))
    assert one == two and not hasattr(plain, "papyra_groups")
    ix.save_index(own, str(tmp_path / "i"))
    saved = ix.load_index(spark, str(tmp_path / "i")).postings
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, plain.collect()))
    files = saved.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("term").alias("t")).collect()
    assert all(list(r.t) == sorted(r.t) for r in files)
