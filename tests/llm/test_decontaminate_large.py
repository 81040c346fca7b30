"""A benchmark of millions of different words, one in several passes, and parameters that make no sense."""

import random

import pytest

from papyra.llm import decontaminate as dc


def test_large_vocabulary():
    items = [(i, " ".join(f"w{i * 550 + j}" for j in range(550))) for i in range(4000)]
    bench = dc.Benchmark(items, dc.RADIUS, 0.5)
    found = bench.search([("x y z " + items[3999][1] + " x y").split(), ["x"] * 600])
    assert found == [(0, 3999, 3, pytest.approx(1.0))]


def test_passes(spark, monkeypatch):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for i in range(25)] + [(None, "one two three four five")]
    rows = [(i, " ".join(rng.choices(vocab, k=20)) + " " + items[i % 26][1] + " tail " * 30) for i in range(40)] + [(40, "one two three four five"), (None, "clean text"), (41, "a" * 3_000_000 + " " + items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(str, dc.find_leaks(docs, benchmark).collect()))
    kept = sorted(map(str, dc.drop_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "ITEMS_A_PASS", 7)
    assert sorted(map(str, dc.find_leaks(docs, benchmark).collect())) == once and len(once) >= 42
    assert sorted(map(str, dc.drop_leaks(docs, benchmark).collect())) == kept and len(kept) == 1


@pytest.mark.parametrize(("radius", "threshold"), [(21, 0.0), (65, 0.5), (-1, 0.5), (21, 1.5)])
def test_parameters(spark, radius, threshold):
    empty = spark.createDataFrame([], "doc_id long, item_id long, text string")
    with pytest.raises(ValueError):
        dc.drop_leaks(empty, empty, radius, threshold)
