"""The classifier against plain versions of its parts: n-grams a text at a time, dense softmax, dense FTRL; texts without letters; long texts."""

import math
from collections import Counter

import numpy as np
import pytest

from papyra.llm import language_id as li


def plain_grams(text):
    a = [32, 32] + [ord(c) if c.isalpha() else 32 for c in text.lower()]
    k1, k2, m = 2654435761, 0x85EBCA6B, 0xFFFFFFFF
    out = Counter()
    for x, y, z in zip(a, a[1:], a[2:]):
        if z != 32 or y != 32:
            for g in ((z * k1 + 0x9E3779B9) & m, ((y * k2 + z) & m) * k1 & m, ((((x * k2 + y) & m) * k2 + z + 77) & m) * k1 & m):
                out[g >> (32 - li.BITS)] += 1
    return out


TEXTS = ["The cat sat.", "", None, "Ein schöner Tag, 1999!", "😀😀 ☃ 12", "𝒳 marks", "x" * 10, "word " * (li._SLICE // 3), "é"]


def test_grams():
    got = [Counter(dict(zip(gram[row == r].tolist(), count[row == r].tolist()))) for n, row, gram, count in li.gram_counts(TEXTS) for r in range(n)]
    assert got == [plain_grams(t or "") for t in TEXTS]


def test_probabilities():
    rng = np.random.default_rng(23)
    model = li.Model(["a", "b", "c"], rng.random(li.DIM).astype(np.float32) + 1, rng.normal(size=(li.DIM, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), 0.7)
    for p, t in zip(model.probabilities(TEXTS), TEXTS):
        x = np.zeros(li.DIM)
        for g, n in plain_grams(t or "").items():
            x[g] = math.log1p(n) * model.idf[g]
        if not x.any():
            assert not p.any()
            continue
        z = (x / np.linalg.norm(x) @ model.weights.astype(float) + model.bias) / 0.7
        assert p == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-5)


def test_ftrl_is_dense_ftrl():
    rng = np.random.default_rng(24)
    x = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(30)]
    y = rng.integers(3, size=30)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    z, n = np.zeros((41, 3)), np.zeros((41, 3))
    weights = lambda: np.array([[0 if i < 40 and abs(z[i, c]) <= l1 else -(z[i, c] - (math.copysign(l1, z[i, c]) if i < 40 and z[i, c] else 0)) / ((beta + math.sqrt(n[i, c])) / alpha + l2) for c in range(3)] for i in range(41)])
    for epoch in range(4):
        for r in np.random.default_rng(epoch).permutation(30):
            w = weights()
            dense = np.zeros(41)
            dense[x[r][0]], dense[40] = x[r][1], 1
            s = np.exp(dense @ w)
            g = np.outer(dense, s / s.sum() - np.eye(3)[y[r]])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
    w, b = li.ftrl(x, y, 3)
    assert w[:40] == pytest.approx(weights()[:40], abs=1e-9) and b == pytest.approx(weights()[40], abs=1e-9) and not w[40:].any()


def test_letterless_beyond_the_first_plane(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat and looked.", "en"), (2, "Der Hund geht mit dem Mann nach Haus.", "de"), (3, "😀😀 😀", "en"), (3, "😀😀 😀", "de"), (4, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.language, r.accepted) for r in li.identify_languages(docs).collect()}
    assert got[3] == (None, False) and got[4] == (None, False) and got[1][0] in ("en", "de")
