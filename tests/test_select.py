import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import select, windows


@pytest.fixture(scope="module")
def storms(spark):
    rng = np.random.default_rng(17)
    rows = []
    for e in range(120):
        size, flow = rng.lognormal(1, 0.8), rng.lognormal(3, 0.9)
        for h in range(6 if e else 40):
            rows.append((e, f"2024-01-01 {h % 24:02d}:00:00" if h < 24 else f"2024-01-02 {h - 24:02d}:00:00", float(flow * rng.random()), float(size * (h + 1) / 6), float(size * rng.random())))
    df = spark.createDataFrame(rows, "event_id long, ts string, inflow double, precip_cum double, precip_excess double")
    return df.withColumn("datetime", F.to_timestamp("ts").cast("timestamp_ntz")).drop("ts")


@pytest.fixture(scope="module")
def maxima(storms):
    from freshet.operators.stats import event_maxima

    return select.cut_lineage(windows.return_periods(event_maxima(storms)))


def test_return_periods_match_arrays(maxima):
    pdf = maxima.toPandas().sort_values("event_id").reset_index(drop=True)
    for source, target in (("precip_cum", "rp_precip"), ("inflow", "rp_inflow")):
        v = pdf[source].to_numpy()
        blocks = np.sort([v[i : i + 10].max() for i in range(0, len(v), 10)])
        rp = (len(blocks) + 1) / np.arange(len(blocks), 0, -1)
        i = np.clip(np.searchsorted(blocks, v, side="right") - 1, 0, len(blocks) - 2)
        want = rp[i] + (rp[i + 1] - rp[i]) / (blocks[i + 1] - blocks[i]) * (v - blocks[i])
        np.testing.assert_allclose(pdf[target], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("shortlist,tol", [(25, 0.15), (1, 0.15), (1, 0.9)])
def test_design_picks_are_apart_and_pass_over_nothing_nearer(maxima, shortlist, tol):
    pdf = maxima.toPandas().set_index("event_id")
    targets, window = (1, 1.5, 2, 3, 5, 8), 0.3
    got = [r["event_id"] for r in select.select_design(maxima, targets, window, tol, shortlist).orderBy("pick").collect()]
    rp = {e: np.array(v) for e, v in zip(pdf.index, pdf[["rp_precip", "rp_inflow"]].to_numpy(), strict=True)}

    def alike(a, b):
        return bool((np.abs(rp[a] - rp[b]) < tol * np.maximum(rp[a], rp[b])).all())

    size = pdf[["precip_cum", "inflow"]]
    peaks = {pdf["rp_precip"].idxmax(), pdf["rp_inflow"].idxmax(), ((size - size.min()) / np.ptp(size.to_numpy(), axis=0)).sum(axis=1).idxmax()}
    assert set(got[: len(peaks)]) == peaks and len(set(got)) == len(got) and len(got) > len(peaks)
    for k in range(len(peaks), len(got)):
        assert not any(alike(got[k], e) for e in got[:k])
    for target in targets:
        with np.errstate(divide="ignore"):
            off = {e: np.linalg.norm(np.log10(v / target)) for e, v in rp.items()}
        for field in (0, 1):
            inside = [e for e, v in rp.items() if (1 - window) * target <= v[field] <= (1 + window) * target]
            nearest = min((off[e] for e in inside if e in got), default=np.inf)
            for e in inside:
                assert e in got or off[e] >= nearest or any(alike(e, p) for p in got)


def test_diverse_pick_is_farthest_first(storms):
    features = select.cut_lineage(select.storm_features(storms, 3))
    pdf = features.toPandas().set_index("event_id")
    v = {e: np.array(x) for e, x in pdf["v"].items()}
    chosen = [3, 50]
    for _ in range(7):
        rest = [e for e in v if e not in chosen]
        chosen.append(max(rest, key=lambda e: (min(np.linalg.norm(v[e] - v[c]) for c in chosen), -e)))
    assert select.select_diverse(features, [3, 50], 7) == chosen[2:]


def test_storm_features_are_the_scaled_leading_scores(storms):
    got = np.array([r["v"] for r in select.storm_features(storms, 2).orderBy("event_id").collect()])
    rows = storms.orderBy("event_id", "datetime").toPandas()
    event = np.unique(rows["event_id"], return_inverse=True)[1]
    step = np.arange(len(rows)) - np.searchsorted(event, event)
    for k, name in enumerate(("precip_excess", "inflow")):
        x = np.zeros((event.max() + 1, step.max() + 1))
        x[event, step] = rows[name]
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        lead = u[:, :2] * s[:2]
        np.testing.assert_allclose(np.abs(got[:, 2 * k : 2 * k + 2]), np.abs(lead / lead.std(0)), atol=1e-6)


def test_full_selection_is_disjoint_and_of_the_asked_size(storms, maxima):
    out = select.select_events(storms, maxima, 14, 6, (1, 2, 4, 8), (0.05, 20)).toPandas()
    assert out["event_id"].is_unique and (out["type"] == "Train").sum() == 14 and (out["type"] == "Test").sum() == 6
    assert set(out["set"]) == {"Max", "AEP", "Diverse", "Test"}


def test_empty_test_range_is_an_error(maxima):
    with pytest.raises(ValueError, match="no eligible"):
        select.select_test(maxima, (1e6, 1e7), 4)
