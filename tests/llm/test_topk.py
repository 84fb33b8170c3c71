"""Histogram selection against sorting all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.llm import topk


def plain(rows, ask, k, scale=64):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if ask(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        found = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def got(spark, rows, k, **kw):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, rank int").repartition(5)
    return sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 10 == 0, k=k, **kw).collect())


@pytest.mark.parametrize(("size", "spread"), [(3, 0.05), (8, 1.0), (4, 1e6), (2, 1e7)])
def test_random_vectors(spark, size, spread):
    rng = random.Random(size)
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(size)]) for i in rng.sample(range(4000), 300)]
    assert got(spark, rows, 7) == plain(rows, lambda i: i % 10 == 0, 7)


def test_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", (3, 8))
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 20)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot) for i in range(0, 260, 2)] + [(i, [0.1 * (i % 3), 0.0, -0.3]) for i in range(1, 200, 2)]
    rows += [(1000, None), (1010, [None, 1.0, 0.0]), (1020, [math.nan, 1.0, 0.0]), (1030, [math.inf, 0.0, 0.0]), (None, hot), (1040, []), (1050, [1.0]), (20, hot), (21, hot), (21, hot)]
    for k in (1, 5, 40, 1000):
        assert got(spark, rows, k) == plain(rows, lambda i: i % 10 == 0, k)


def test_empty_and_too_large(spark):
    assert got(spark, [], 3) == [] and got(spark, [(1, [1.0])], 3) == [] and got(spark, [(10, [1.0])], 3) == []
    with pytest.raises(OverflowError):
        got(spark, [(10, [1e17]), (11, [1e17])], 3)
