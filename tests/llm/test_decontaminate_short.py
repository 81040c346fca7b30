"""A document shorter than an item is one window."""

import random

from papyra.llm import decontaminate as dc


def test_short_documents():
    rng = random.Random(17)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.randint(4, 38)))) for i in range(30)]
    documents = [w[a:b] for _, t in items for w in [t.split()] for a, b in ((0, -1), (1, None), (0, 3), (0, None), (2, -2))]
    bench = dc.Benchmark(items, 64, 0.5)
    want = set()
    for d, w in enumerate(documents):
        for k, (item, iw) in enumerate(bench.items):
            windows = [w] if len(w) < len(iw) else [w[p : p + len(iw)] for p in range(len(w) - len(iw) + 1)]
            if any(bench.similarity(x, k) >= 0.5 for x in windows):
                want.add((d, k))
    assert {(d, k) for d, k, _, _ in bench.search(documents)} == want
    assert any(len(documents[d]) < len(bench.items[k][1]) for d, k in want)
