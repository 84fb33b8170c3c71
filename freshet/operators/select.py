"""Choice of training and test storms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.exprs import rp_close
from freshet.operators.filters import joint_range
from freshet.operators.joins import exclude, restrict
from freshet.operators.reduce import principal_modes
from freshet.operators.sets import fill_sample, near_targets, rank_candidates, sample_log_bins, union_ids
from freshet.operators.stats import extreme_events
from freshet.operators.windows import event_hour
from freshet.session import cut_lineage

PICKED = "event_id long, pick int, set string, type string"
CHECKPOINT_EVERY = 5


def _picked_frame(maxima: DataFrame, picks: Sequence[tuple[int, str]], role: str) -> DataFrame:
    rows = [(int(e), i, label, role) for i, (e, label) in enumerate(picks)]
    chosen = maxima.sparkSession.createDataFrame(rows, PICKED)
    return maxima.drop("pick", "set", "type").join(F.broadcast(chosen), "event_id")  # one row per selected storm


def select_design(
    maxima: DataFrame, targets: Sequence[float], window: float = 0.2, tol: float = 0.15, shortlist: int = 25
) -> DataFrame:
    """Extreme storms, then per target return period and field the nearest storm unlike all chosen ones.

    Candidates are ranked in Spark; only ``shortlist`` rows per slot reach the
    accept loop. A slot whose full shortlist is refused is searched again over
    all events with the refusals written as a filter.
    """
    cols = ["event_id", "rp_precip", "rp_inflow"]
    extremes = extreme_events(maxima).join(maxima.select(*cols), "event_id").orderBy("rank").collect()
    chosen = [(r["event_id"], r["rp_precip"], r["rp_inflow"]) for r in extremes]
    picks = [(r["event_id"], "Max") for r in extremes]

    def close(a: float | None, b: float | None) -> bool:
        if a is None or b is None or max(a, b) == 0:
            return False
        return abs(a - b) / max(a, b) < tol

    def refused(event_id, p, q) -> bool:
        return any(event_id == e or (close(p, cp) and close(q, cq)) for e, cp, cq in chosen)

    ranked = rank_candidates(maxima, targets, window, shortlist).select("slot", "rank", *cols)
    slots: dict[int, list] = {}
    for row in ranked.orderBy("slot", "rank").collect():
        slots.setdefault(row["slot"], []).append(row)
    for slot in sorted(slots):
        rows = slots[slot]
        pick = next((r for r in rows if not refused(*(r[c] for c in cols))), None)
        if pick is None and len(rows) == shortlist:
            free = near_targets(maxima, targets, window).where((F.col("slot") == slot) & ~_refused_filter(chosen, tol))
            pick = free.orderBy(F.col("log_dist").asc_nulls_last(), "event_id").select(*cols).first()
        if pick is not None:
            chosen.append(tuple(pick[c] for c in cols))
            picks.append((pick["event_id"], "AEP"))
    return _picked_frame(maxima, picks, "Train")


def _refused_filter(chosen: Sequence[tuple], tol: float) -> Column:
    out = F.col("event_id").isin([e for e, _, _ in chosen])
    for _, p, q in chosen:
        both = rp_close("rp_precip", F.lit(p), tol) & rp_close("rp_inflow", F.lit(q), tol)
        out = out | F.coalesce(both, F.lit(False))
    return out


def storm_features(storms: DataFrame, n_components: int = 5) -> DataFrame:
    """Standardised principal components of each storm's rainfall and inflow, as one array per event.

    Hours an event does not reach count as 0, so they need no rows.
    """
    hourly = cut_lineage(event_hour(storms).select("event_id", "hour", "precip_excess", "inflow"))
    parts = None
    for name in ("precip_excess", "inflow"):
        found = principal_modes(hourly, ["event_id"], "hour", name, n_components)
        n_modes = min(n_components, found.eigen.count())
        arrays = found.loadings(n_modes).groupBy("hour").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("mode", "loading"))), lambda s: s["loading"]).alias("_l")
        )
        # Centring would only shift every score by the same amount; the scaling below removes it.
        scores = hourly.join(arrays, "hour").groupBy("event_id").agg(
            *[F.sum(F.col(name) * F.get("_l", j)).alias(f"{name}_{j}") for j in range(n_modes)]
        )
        parts = scores if parts is None else parts.join(scores, "event_id")
    cols = [c for c in parts.columns if c != "event_id"]
    stats = parts.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    scaled = [
        (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else F.lit(0.0) for c in cols
    ]
    return parts.select("event_id", F.array(*scaled).alias("v"))


def distance_to(v: str, point: Sequence[float]) -> Column:
    """Euclidean distance of an array column to a fixed point."""
    total = F.lit(0.0)
    for i, p in enumerate(point):
        gap = F.get(v, i) - F.lit(float(p))
        total = total + gap * gap
    return F.sqrt(total)


def select_diverse(features: DataFrame, seeds: Sequence[int], n: int) -> list[int]:
    """Farthest-first pick: each round takes the event farthest from everything chosen so far."""
    known = features.where(F.col("event_id").isin(list(seeds))).select("v").collect()
    points = F.array(*[F.array(*[F.lit(float(p)) for p in r["v"]]) for r in known])
    start = F.array_min(
        F.transform(
            points,
            lambda s: F.sqrt(F.aggregate(F.zip_with("v", s, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)),
        )
    )
    state = cut_lineage(
        features.where(~F.col("event_id").isin(list(seeds))).withColumn("d", start if known else F.lit(float("inf")))
    )
    picked: list[int] = []
    for i in range(n):
        best = state.agg(F.max_by(F.struct("event_id", "v"), F.struct(F.col("d"), -F.col("event_id"))).alias("b")).first()["b"]
        if best is None:
            break
        picked.append(best["event_id"])
        state = state.where(F.col("event_id") != best["event_id"]).withColumn(
            "d", F.least("d", distance_to("v", best["v"]))
        )
        if i % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            state = cut_lineage(state)
    return picked


def select_test(
    maxima: DataFrame, rp_range: tuple[float, float], n: int, excluded: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """Test storms: one per log-spaced bin of either return period, then filled up to ``n``."""
    lo, hi = rp_range
    eligible = joint_range(maxima, lo, hi)
    if excluded is not None:
        eligible = exclude(eligible, excluded)
    eligible = cut_lineage(eligible)
    if eligible.isEmpty():
        raise ValueError("no eligible storms in the test return-period range")
    bins = n // 2
    ids = cut_lineage(
        union_ids(
            sample_log_bins(eligible, "rp_precip", lo, hi, bins, seed),
            sample_log_bins(eligible, "rp_inflow", lo, hi, bins, seed + 1),
        )
    )
    ids = ids.unionByName(fill_sample(eligible, ids, n, seed).select("event_id"))
    return restrict(maxima, ids).withColumns({"set": F.lit("Test"), "type": F.lit("Test")})


def select_events(
    storms: DataFrame,
    maxima: DataFrame,
    n_train: int = 35,
    n_test: int = 14,
    targets: Sequence[float] = (2, 5, 10, 25, 50, 100, 200, 500, 1000, 2000),
    rp_range: tuple[float, float] = (5, 2000),
    window: float = 0.2,
    tol: float = 0.15,
) -> DataFrame:
    """Design storms, diverse storms up to ``n_train``, then test storms, labelled by ``set`` and ``type``."""
    maxima = cut_lineage(maxima)
    design = cut_lineage(select_design(maxima, targets, window, tol).drop("pick"))
    seeds = [r["event_id"] for r in design.select("event_id").collect()]
    extra = select_diverse(cut_lineage(storm_features(storms)), seeds, max(0, n_train - len(seeds)))
    diverse = _picked_frame(maxima, [(e, "Diverse") for e in extra], "Train").drop("pick")
    train = design.unionByName(diverse)
    return train.unionByName(select_test(maxima, rp_range, n_test, train.select("event_id")))
