"""Products with pivots are made a strip of rows at a time, however many pivots a table has."""

import tracemalloc

import numpy as np

from lumenlake.operators.neighbours import nearest, vector_pairs


def test_memory_of_nearest_pivots_is_bounded():
    draw = np.random.default_rng(3)
    rows, pivots = draw.normal(size=(10_000, 8)), draw.normal(size=(4_096, 8))
    tracemalloc.start()
    cell, angle = nearest(rows, pivots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all products at once: 328 MB
    for k in (0, 255, 256, 9_999):
        assert cell[k] == (pivots @ rows[k]).argmax()
        assert abs(np.cos(angle[k]) - np.clip(pivots[cell[k]] @ rows[k], -1, 1)) < 1e-9


def test_visits_by_strips_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr("lumenlake.operators.neighbours.STRIP", 64)
    draw = np.random.default_rng(4)
    v = draw.normal(size=(300, 6)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, vector array<float>")
    products = v.astype(float) @ v.T.astype(float)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if products[i, j] >= 0.9}
    assert {(r.a, r.b) for r in vector_pairs(rows, 0.9, 12).collect()} == want
