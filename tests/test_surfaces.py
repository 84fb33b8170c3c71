import numpy as np
import pytest

from freshet.operators import surfaces


def basis(x, knots):
    """Cubic B-splines by recursion, end pieces extended."""
    n = len(knots) - 4
    j = np.clip(np.searchsorted(knots, x, side="right") - 1, 3, n - 1)
    out = np.zeros((len(x), n))
    for row, (v, i) in enumerate(zip(x, j)):
        b = {i: 1.0}
        for d in range(1, 4):
            new = {}
            for m in range(i - d, i + 1):
                left, right = b.get(m, 0.0), b.get(m + 1, 0.0)
                total = 0.0
                if left:
                    total += (v - knots[m]) / (knots[m + d] - knots[m]) * left
                if right:
                    total += (knots[m + d + 1] - v) / (knots[m + d + 1] - knots[m + 1]) * right
                new[m] = total
            b = new
        for m, value in b.items():
            out[row, m] = value
    return out


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(13)
    data = {s: (rng.lognormal(4, 1, size=200), None) for s in ("us", "ds")}
    data = {s: (q, 100 + np.sqrt(q) + rng.normal(scale=0.1, size=200)) for s, (q, _) in data.items()}
    rows = [(s, float(a), float(b)) for s, (q, w) in data.items() for a, b in zip(q, w)]
    rows += [("us", -5.0, 1.0), ("us", 3.0, 1.0), ("us", float("nan"), 1.0), ("ds", float("inf"), 1.0)]
    return data, spark.createDataFrame(rows, "site string, flow double, wse double")


def test_spline_is_the_least_squares_fit(spark, sites):
    data, df = sites
    model = surfaces.fit_rating(df)
    asked = [1.0, 20.0, 60.0, 150.0, 5000.0]
    queries = spark.createDataFrame([(s, v) for s in data for v in asked], "site string, flow double")
    got = {(r["site"], r["flow"]): r["fitted"] for r in surfaces.apply_rating(queries, model).collect()}
    for s, (q, w) in data.items():
        keep = q > 10
        q, w = q[keep], w[keep]
        knots = np.r_[[q.min()] * 4, np.quantile(q, np.linspace(0, 1, 9)[1:-1]), [q.max()] * 4]
        coefs = np.linalg.lstsq(basis(q, knots), w, rcond=None)[0]
        want = basis(np.array(asked), knots) @ coefs
        for v, value in zip(asked, want):
            assert got[s, v] == pytest.approx(value, rel=1e-5, abs=1e-5)
    trace = surfaces.rating_trace(model, 11).where("site = 'us'").orderBy("point").collect()
    assert len(trace) == 11 and trace[0]["flow"] == pytest.approx(min(v for v in data["us"][0] if v > 10))


def test_too_few_observations_fail(spark):
    df = spark.createDataFrame([("a", 20.0 + i, 1.0 * i) for i in range(11)], "site string, flow double, wse double")
    with pytest.raises(Exception, match="at least 12"):
        surfaces.fit_rating(df).collect()
