"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import vectors


def table(spark, x, odd=True):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    if odd:
        n, d = len(rows), len(x[0])
        rows += [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [1.0, None] + [0.0] * (d - 2)), (n + 4, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(500, 16))
    near = base[:40] + rng.normal(scale=0.05, size=(40, 16))
    return np.concatenate([base, near, base[:10], near[:3] * 2])


def test_near_duplicates(spark, x):
    rows = {r["vec_id"]: r for r in vectors.near_duplicates(table(spark, x), 0.95, leaf=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(10):
        root = np.array([min([root[i], *root[np.flatnonzero(linked[i])]]) for i in range(len(x))])
    assert [rows[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [rows[i]["component_id"] for i in range(len(x))] == root.tolist()
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] and rows[i]["component_id"] == i for i in range(len(x), len(x) + 5))
    assert vectors.near_duplicates(table(spark, x, odd=False).limit(0)).count() == 0


def test_nearest(spark, x):
    rows = vectors.nearest(table(spark, x), F.col("vec_id") % 10 == 0, k=5).collect()
    hits = total = 0
    for q in range(0, len(x), 10):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(x)), far))[:5]
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in mine] == pytest.approx(far[[r["vec_id"] for r in mine]].tolist())
        hits, total = hits + len({r["vec_id"] for r in mine} & set(best.tolist())), total + 5
    assert hits / total >= 0.95
    few = vectors.nearest(table(spark, x[:3], odd=False), F.col("vec_id") == 0, k=10)
    assert few.count() == 2
