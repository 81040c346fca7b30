"""Recall at the default radius against brute force over similarity alone, on items cut short and followed by other text."""

import inspect
import random

from papyra.llm import decontaminate as dc


def test_recall_of_cut_items():
    rng = random.Random(18)
    words = [f"w{k}" for k in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(15, 59)))) for i in range(150)]
    radius = inspect.signature(dc.find_leaks).parameters["radius"].default
    bench = dc.Benchmark(items, radius, 0.5)
    documents, want = [], set()
    for k, (_, w) in enumerate(bench.items):
        for c in range(1, len(w) // 2):
            window = w[c:] + rng.choices(words, k=c)
            if 0.5 <= bench.similarity(window, k) < 0.7:
                want.add((len(documents), k))
                documents.append(window)
    found = {(d, k) for d, k, _, _ in bench.search(documents)}
    assert len(want) > 200 and len(want & found) >= 0.9 * len(want)
