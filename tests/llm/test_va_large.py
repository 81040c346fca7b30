"""Finite elements of any size, and dimensions without variance, have neighbours."""

import numpy as np
import pytest

from papyra.llm import va_search


def found(spark, x):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in va_search.top_k(rows, 3).collect():
        got.setdefault(r.vec_id, {})[r.rank] = r.distance
    return np.array([[got[i][r] for r in (1, 2, 3)] for i in range(len(x))])


@pytest.mark.parametrize("large", [[1e21, 1.0, 0, 0], [1e25] * 4, [3e38, -3e38, 3e38, 1]])
def test_large_elements(spark, large):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x[::9] *= np.float32(1e25)
    x[7] = large
    x[:, 3] = 5
    d = np.sqrt(((x[:, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(found(spark, x), np.sort(d, axis=1)[:, :3], rtol=1e-9, atol=1e-8)


def test_no_variance(spark):
    assert (found(spark, np.full((6, 3), 2.5, dtype=np.float32)) == 0).all()
