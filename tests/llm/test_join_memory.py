"""The n-gram join holds little at a time: one bucket unpacked, a bounded memory of words, small batches; each step gives its memory back."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import jaccard_join

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def _rows(buckets, batches, size):
    rng = np.random.default_rng(5)
    for b in range(batches):  # as they come from a shuffle: the buckets mixed
        for k in range(buckets):
            value = rng.integers(0, 4 * size, size, dtype=np.uint64) | np.uint64(k << 48)
            keys = np.unique(value << np.uint64(10) | rng.integers(0, 1024, size, dtype=np.uint64))
            yield k, b, keys


def test_buckets_are_unpacked_one_at_a_time():
    rows = list(_rows(12, 8, 20_000))
    batches = [jaccard_join._packed([(k, b, jaccard_join._planes(keys), None)]) for k, b, keys in rows]
    held = sum(len(keys) * 8 for _, _, keys in rows)
    tracemalloc.start()
    found = 0
    for batch in jaccard_join._repeated(iter(batches)):
        found += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 2.5 * held, f"{peak / held:.1f} times the partition"


def test_repeated_hashes_of_all_buckets():
    rows = list(_rows(5, 3, 500))
    got = []
    for batch in jaccard_join._repeated(jaccard_join._packed([(k, b, jaccard_join._planes(keys), None)]) for k, b, keys in rows):
        for _, b, grams, df in zip(*(c.to_pylist() for c in batch.columns)):
            got += zip([b] * (len(grams) // 8), jaccard_join._unplanes(grams, "<u8").tolist(), jaccard_join._unplanes(df, "<u4").tolist())
    every = [(b, int(x)) for _, b, keys in rows for x in keys]
    count = {}
    for _, x in every:
        count[x >> 10] = count.get(x >> 10, 0) + 1
    assert sorted(got) == sorted((b, x, count[x >> 10]) for b, x in every if count[x >> 10] > 1)


def test_words_that_are_remembered_are_bounded(monkeypatch):
    seen, plain = [], jaccard_join.gram_hashes
    monkeypatch.setattr(jaccard_join, "gram_hashes", lambda words, n, known: seen.append(len(known)) or plain(words, n, known))
    monkeypatch.setattr(jaccard_join, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    texts = [" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(range(60), pa.int64()), pa.array(texts)], names=["o", "k", "text"])
    assert sum(b.num_rows for b in jaccard_join._grams(iter([batch]), 3, 4))
    assert max(seen) <= 1 << 17


def test_every_step_takes_small_batches_and_gives_its_memory_back(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[: 38 + i % 3])) for i in range(8)] + [(9, None)], "doc_id long, text string")
    before, steps, seen, frame = spark.conf.get(NAME), [], [], type(docs)
    plain, kept = frame.mapInArrow, jaccard_join.materialize
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: steps.append(f) or plain(self, f, *a, **k))
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: seen.append((name, spark.conf.get(NAME))) or kept(df, name))
    pairs, _, same = jaccard_join.similar_sets(docs)
    assert (pairs.count(), same.count()) == (3, 5)
    assert len(seen) >= 6 and {size for _, size in seen} == {"4m"} and spark.conf.get(NAME) == before
    with pytest.raises(ValueError):
        jaccard_join.similar_sets(docs, threshold=0)
    given = []
    monkeypatch.setattr(jaccard_join, "trimmed", lambda rows, keep="": given.append(rows) or rows)
    for k, step in enumerate(steps, 1):
        step(iter(()))
        assert len(given) == k, f"step {k} of {len(steps)} keeps its memory"
    assert len(steps) >= 6
