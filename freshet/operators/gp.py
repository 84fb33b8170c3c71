"""Sparse Gaussian-process regression from distributed Gram sums.

The collapsed bound of a sparse GP (Titsias 2009) sees the data only through
``sum k k'``, ``sum k y``, ``sum y y`` and the row count, where ``k`` holds the
kernel between one row and the inducing points. One pass sums these for every
candidate lengthscale and inducing set, and for all modes together; what is
left per candidate is algebra on matrices of the size of the inducing set, done
in tasks. Variance and noise do not need new sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.exprs import check_kernel
from freshet.operators import gram
from freshet.operators.stats import inducing_grid
from freshet.session import cut_lineage

JITTER = 1e-6
# Where random starts and evolution draw (variance, lengthscale, noise), as powers of ten. Other searches are free.
LOG_BOUNDS = ((-1.0, 1.0), (-1.0, 1.0), (-3.0, 0.0))
# Beyond these powers of ten a parameter is no longer a number to compute with.
LOG_REACH = 60.0
# Largest model a prediction task may receive.
MODEL_BYTES = 512 << 20

SCORE = "slot int, mode int, log_variance double, log_noise double, loss double"
MODEL = (
    "mode int, kernel string, variance double, lengthscale double, noise double, loss double, "
    "z array<array<double>>, c array<double>, linv binary, pinv binary"
)


# --- inputs ---------------------------------------------------------------------------------------


def stack(long: DataFrame, key: str = "mode", value: str = "z", name: str = "x") -> DataFrame:
    """Long features to one array per ``(run, t)`` in key order."""
    packed = F.array_sort(F.collect_list(F.struct(key, value)))
    return long.groupBy("run", "t").agg(F.transform(packed, lambda s: s[value]).alias(name))


def training_rows(x: DataFrame, y: DataFrame, x_key: str = "mode") -> DataFrame:
    """``(run, t, x, y)`` arrays from long inputs and long targets."""
    return stack(x, x_key, "z", "x").join(stack(y, "mode", "z", "y"), ["run", "t"])


def inducing_kmeans(rows: DataFrame, m: int, seed: int = 0) -> np.ndarray:
    """Inducing points at the centres of ``m`` clusters."""
    vectors = rows.select(array_to_vector("x").alias("features"))
    if m == 1:
        width = len(rows.select("x").first()["x"])
        means = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)]).first()
        return np.array([list(means)])
    fitted = KMeans(k=m, seed=seed, featuresCol="features").fit(vectors)
    return np.array(fitted.clusterCenters())


def inducing_points(rows: DataFrame, m: int, how: str = "kmeans", seed: int = 0) -> np.ndarray:
    if how == "kmeans":
        return inducing_kmeans(rows, m, seed)
    if how == "grid":
        long = rows.select(F.posexplode("x").alias("feature", "value"))
        grid = inducing_grid(long, m).collect()
        out = np.zeros((m, 1 + max(r["feature"] for r in grid)))
        for r in grid:
            out[r["point"], r["feature"]] = r["z"]
        return out
    raise ValueError(f"unknown inducing initialiser {how!r}; use kmeans or grid")


# --- algebra on small matrices --------------------------------------------------------------------


def correlation(kernel: str, a: np.ndarray, b: np.ndarray, lengthscale: float) -> np.ndarray:
    """Kernel of unit variance between two sets of points."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    r = np.sqrt(np.maximum(d2, 0.0)) / lengthscale
    if kernel == "Matern12":
        return np.exp(-r)
    if kernel == "Matern32":
        return (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r)
    if kernel == "Matern52":
        return (1 + math.sqrt(5) * r + 5 / 3 * r * r) * np.exp(-math.sqrt(5) * r)
    if kernel == "RBF":
        return np.exp(-0.5 * r * r)
    return np.exp(-0.5 * r)


def _log_prior(*values: float) -> float:
    """LogNormal(0, 1) on each hyper-parameter."""
    return sum(-math.log(v) - 0.5 * math.log(2 * math.pi) - 0.5 * math.log(v) ** 2 for v in values)


@dataclass
class Sums:
    """Unit-variance Gram sums of one candidate for one mode."""

    phi: np.ndarray
    b: np.ndarray
    yy: float
    n: int


def _factors(kuu: np.ndarray, s: Sums, variance: float, noise: float, settle: bool = False):
    """Factors of the bound. ``1 + inner`` has no eigenvalue below 1; ``settle`` lifts those that rounding puts there."""
    chol = np.linalg.cholesky(variance * kuu + JITTER * np.eye(len(kuu)))
    linv = np.linalg.inv(chol)
    inner = variance * variance * linv @ s.phi @ linv.T / noise
    whole = np.eye(len(kuu)) + (inner + inner.T) / 2
    values, vectors = np.linalg.eigh(whole) if settle else (np.ones(1), None)
    if values[0] < 1:
        lb = np.linalg.qr((vectors * np.sqrt(np.maximum(values, 1.0))).T, mode="r").T
        lb = lb * np.where(np.diag(lb) < 0, -1.0, 1.0)
    else:
        lb = np.linalg.cholesky(whole)
    c = np.linalg.solve(lb, linv @ (variance * s.b)) / noise
    return linv, inner, lb, c


def loss_of(kuu: np.ndarray, s: Sums, variance: float, lengthscale: float, noise: float) -> float:
    """Negative collapsed bound minus log priors."""
    try:
        linv, inner, lb, c = _factors(kuu, s, variance, noise)
    except np.linalg.LinAlgError:
        return math.inf
    # What holds exactly must hold in doubles: the inducing points explain no more than there is, and no pivot of
    # ``1 + inner`` is below 1. Where it does not, or the kernel matrix is close to singular, the bound is rounding error.
    scale = np.abs(np.diag(linv))
    explained = noise * float(np.trace(inner)) <= s.n * variance * (1 + 1e-6) and noise * float(c @ c) <= s.yy * (1 + 1e-6)
    if not explained or np.diag(lb).min() < 1 - 1e-6 or (scale.min() / scale.max()) ** 2 < 1e-10:
        return math.inf
    bound = (
        -0.5 * s.n * math.log(2 * math.pi)
        - np.log(np.diag(lb)).sum()
        - 0.5 * s.n * math.log(noise)
        - 0.5 * s.yy / noise
        + 0.5 * float(c @ c)
        - 0.5 * s.n * variance / noise
        + 0.5 * float(np.trace(inner))
    )
    value = -(bound + _log_prior(variance, lengthscale, noise))
    return float(value) if math.isfinite(value) else math.inf


def _descend(f, start: Sequence[float], bounds=None, step: float = 0.5, rounds: int = 200) -> tuple[list[float], float]:
    """Pattern search for two smooth parameters, free or inside a box."""
    bounds = bounds or [(-LOG_REACH, LOG_REACH)] * len(start)
    at, best = list(start), f(*start)
    for _ in range(rounds):
        moved = False
        for i in range(len(at)):
            for direction in (step, -step):
                trial = list(at)
                trial[i] += direction
                value = f(*trial) if bounds[i][0] <= trial[i] <= bounds[i][1] else math.inf
                if value < best:
                    at, best, moved = trial, value, True
                    break
        if not moved:
            step /= 2
            if step < 1e-4:
                break
    return at, best


# --- the distributed pass -------------------------------------------------------------------------


@dataclass
class Candidate:
    """One lengthscale with its inducing points; ``modes`` limits it to some modes."""

    slot: int
    lengthscale: float
    z: np.ndarray
    modes: tuple[int, ...] | None = None
    log_variance: float = 0.0
    log_noise: float = -1.0


def gram_pass(rows: DataFrame, kernel: str, candidates: Sequence[Candidate]) -> DataFrame:
    """Gram sums of every candidate, all modes at once.

    The matrix of a slot has ``M + 1`` rows: ``[sum k k' | sum k y']`` and
    ``[count, 0 ... | sum y y]``.
    """
    groups: dict[int, tuple[np.ndarray, list[tuple[int, float]]]] = {}
    for cand in candidates:
        key = id(cand.z)
        groups.setdefault(key, (cand.z, []))[1].append((cand.slot, cand.lengthscale))
    work = list(groups.values())

    def accumulate(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["x"].tolist(), dtype=np.float64)
            y = np.array(batch["y"].tolist(), dtype=np.float64)
            for z, members in work:
                for slot, lengthscale in members:
                    k = correlation(kernel, z, x, lengthscale)
                    sums = np.zeros((len(z) + 1, len(z) + y.shape[1]))
                    sums[:-1, : len(z)] = k @ k.T
                    sums[:-1, len(z) :] = k @ y
                    sums[-1, 0] = len(x)
                    sums[-1, len(z) :] = (y * y).sum(axis=0)
                    total[slot] = total[slot] + sums if slot in total else sums
        return total

    return gram.partial_sums(rows.select("x", "y"), accumulate)


def _assemble(group: pd.DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    body = b"".join(bytes(b) for b in group.sort_values("block")["body"])
    full = np.frombuffer(body, dtype=np.float64).reshape(m + 1, -1)
    return full[:-1, :m], full[:-1, m:], full[-1, m:], int(round(full[-1, 0]))


def score_pass(sums: DataFrame, kernel: str, candidates: Sequence[Candidate], tune: bool = True, bounds=None) -> DataFrame:
    """Loss per candidate and mode; ``tune`` also finds the best variance and noise of each, within ``bounds`` if given."""
    by_slot = {c.slot: c for c in candidates}

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        cand = by_slot[int(group["slot"].iloc[0])]
        phi, b, yy, n = _assemble(group, len(cand.z))
        kuu = correlation(kernel, cand.z, cand.z, cand.lengthscale)
        out = []
        for mode in range(b.shape[1]):
            if cand.modes is not None and mode not in cand.modes:
                continue
            s = Sums(phi, b[:, mode], float(yy[mode]), n)

            def f(v: float, e: float) -> float:
                return loss_of(kuu, s, 10**v, cand.lengthscale, 10**e)

            at, best = [cand.log_variance, cand.log_noise], f(cand.log_variance, cand.log_noise)
            if tune:
                at, best = _descend(f, at, bounds)
            out.append((cand.slot, mode, at[0], at[1], best))
        return pd.DataFrame(out, columns=["slot", "mode", "log_variance", "log_noise", "loss"])

    return sums.groupBy("slot").applyInPandas(solve, SCORE)


def best_per_mode(scores: DataFrame) -> list:
    """Winning candidate of every mode: one small row each."""
    row = F.struct("slot", "log_variance", "log_noise", "loss")
    winners = scores.groupBy("mode").agg(F.min_by(row, F.struct("loss", "slot")).alias("_w"))
    return winners.select("mode", "_w.*").orderBy("mode").collect()


@dataclass
class Choice:
    """Hyper-parameters chosen for one mode."""

    mode: int
    log_variance: float
    log_lengthscale: float
    log_noise: float
    loss: float
    z: np.ndarray


def _evaluate(rows: DataFrame, kernel: str, candidates: Sequence[Candidate], tune: bool, bounds=None) -> dict[int, Choice]:
    by_slot = {c.slot: c for c in candidates}
    scores = score_pass(gram_pass(rows, kernel, candidates), kernel, candidates, tune, bounds)
    return {
        r["mode"]: Choice(
            r["mode"], r["log_variance"], math.log10(by_slot[r["slot"]].lengthscale), r["log_noise"], r["loss"], by_slot[r["slot"]].z
        )
        for r in best_per_mode(scores)
    }


def _better(old: dict[int, Choice], new: dict[int, Choice]) -> dict[int, Choice]:
    return {m: new[m] if m not in old or (m in new and new[m].loss < old[m].loss) else old[m] for m in {**old, **new}}


# --- searches -------------------------------------------------------------------------------------


def search_profile(rows, kernel, z, initial: float, points: int = 9, refine: int = 2, seed: int = 0) -> dict[int, Choice]:
    """Lengthscale grid with the best variance and noise at each point, then finer grids around each mode's best.

    The grid grows by half its width on a side for as long as a mode is best at its end there.
    """
    lo, hi = LOG_BOUNDS[1]
    gap = (hi - lo) / (points - 1)
    grid = sorted({*np.linspace(lo, hi, points).tolist(), math.log10(max(initial, 1e-6))})
    best = _evaluate(rows, kernel, [Candidate(i, 10**g, z) for i, g in enumerate(grid)], True)
    ends = dict.fromkeys(best, (grid[0], grid[-1]))
    while True:
        candidates: list[Candidate] = []
        for mode, choice in best.items():
            low, high = ends[mode]
            at = choice.log_lengthscale
            side = -1 if at - low < gap / 2 else 1 if high - at < gap / 2 else 0
            if not side or abs(at) > LOG_REACH / 2:
                continue
            more = [at + side * gap * i for i in range(1, points // 2 + 1)]
            ends[mode] = (min(low, *more), max(high, *more))
            for g in more:
                candidates.append(Candidate(len(candidates), 10**g, z, (mode,), choice.log_variance, choice.log_noise))
        if not candidates:
            break
        best = _better(best, _evaluate(rows, kernel, candidates, True))
    for _ in range(refine):
        candidates = []
        for mode, choice in best.items():
            for shift in (-0.5, -0.25, 0.25, 0.5):
                candidates.append(
                    Candidate(len(candidates), 10 ** (choice.log_lengthscale + shift * gap), z, (mode,), choice.log_variance, choice.log_noise)
                )
        best = _better(best, _evaluate(rows, kernel, candidates, True))
        gap /= 4
    return best


# --- gradients ------------------------------------------------------------------------------------


def _slope(kernel: str, r: np.ndarray) -> np.ndarray:
    """Derivative of the unit kernel by the scaled distance, over that distance; 0 where points coincide."""
    if kernel == "RBF":
        return -np.exp(-0.5 * r * r)
    if kernel == "Matern32":
        return -3 * np.exp(-math.sqrt(3) * r)
    if kernel == "Matern52":
        return -5 / 3 * (1 + math.sqrt(5) * r) * np.exp(-math.sqrt(5) * r)
    rate = 1.0 if kernel == "Matern12" else 0.5
    safe = np.maximum(r, 1e-12)
    return np.where(r > 1e-12, -rate * np.exp(-rate * safe) / safe, 0.0)


def _scaled_distance(a: np.ndarray, b: np.ndarray, lengthscale: float) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0)) / lengthscale


@dataclass
class Point:
    """Parameters of one mode during a gradient search: natural logarithms and inducing points."""

    logs: np.ndarray  # variance, lengthscale, noise
    z: np.ndarray


@dataclass
class Slopes:
    """Loss at a point, its derivatives as far as the Gram sums give them, and what the rows still have to add."""

    loss: float
    logs: np.ndarray
    z: np.ndarray
    g: np.ndarray
    h: np.ndarray


def _slopes(kernel: str, point: Point, s: Sums) -> Slopes:
    """Derivatives of the loss that do not need the rows.

    ``g`` and ``h`` are such that the derivative by the kernel between the
    inducing points and a row ``(x, y)`` is ``g k + h y``.
    """
    v, ls, e = np.exp(point.logs)
    z, n = point.z, s.n
    unit = correlation(kernel, z, z, ls)
    kuu = v * unit + JITTER * np.eye(len(z))
    phi, b = v * v * s.phi, v * s.b
    inv = np.linalg.inv(kuu)
    a_inv = np.linalg.inv(kuu + phi / e)
    alpha = a_inv @ b
    d_phi = -a_inv / (2 * e) - np.outer(alpha, alpha) / (2 * e**3) + inv / (2 * e)
    d_kuu = 0.5 * inv - 0.5 * a_inv - np.outer(alpha, alpha) / (2 * e**2) - inv @ phi @ inv / (2 * e)
    g, h = 2 * d_phi, alpha / e**2
    d_e = (
        -n / (2 * e) + np.sum(a_inv * phi) / (2 * e**2) + s.yy / (2 * e**2) - b @ alpha / e**3
        + alpha @ phi @ alpha / (2 * e**4) + n * v / (2 * e**2) - np.sum(inv * phi) / (2 * e**2)
    )
    d_v = -n / (2 * e) + np.sum(d_kuu * unit) + (np.sum(g * phi) + h @ b) / v
    r = _scaled_distance(z, z, ls)
    w = d_kuu * v * _slope(kernel, r)
    np.fill_diagonal(w, 0.0)
    d_z = 2 * (w.sum(1)[:, None] * z - w @ z) / ls**2
    d_ls = -np.sum(w * r * r) / ls
    bound = np.array([d_v * v, d_ls * ls, d_e * e])
    prior = -(1 + point.logs)
    return Slopes(loss_of(unit, s, v, ls, e), -(bound + prior), -d_z, g, h)


def row_slopes(rows: DataFrame, kernel: str, points: dict[int, Point], slopes: dict[int, Slopes]) -> dict[int, np.ndarray]:
    """What the rows add to the derivatives of every mode, in one pass: inducing points, then the lengthscale."""
    width = next(iter(points.values())).z.shape[1]
    work = [(m, *np.exp(points[m].logs[:2]), points[m].z, slopes[m].g, slopes[m].h) for m in sorted(points)]

    def accumulate(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["x"].tolist(), dtype=np.float64)
            y = np.array(batch["y"].tolist(), dtype=np.float64)
            for mode, v, ls, z, g, h in work:
                r = _scaled_distance(z, x, ls)
                w = (g @ (v * correlation(kernel, z, x, ls)) + np.outer(h, y[:, mode])) * v * _slope(kernel, r)
                sums = np.zeros((len(z) + 1, width))
                sums[:-1] = w.sum(1)[:, None] * z - w @ x
                sums[-1, 0] = np.sum(w * r * r)
                total[mode] = total[mode] + sums if mode in total else sums
        return total

    found = gram.fetch(gram.partial_sums(rows.select("x", "y"), accumulate), width)
    out = {}
    for m, sums in found.items():
        ls = math.exp(points[m].logs[1])
        d = np.zeros((len(sums), width))
        d[:-1], d[-1, 0] = -sums[:-1] / ls**2, sums[-1, 0]
        out[m] = d
    return out


def losses_and_gradients(rows: DataFrame, kernel: str, points: dict[int, Point]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, derivatives by the log parameters, by the inducing points) of every mode, in two passes over the rows."""
    candidates = [Candidate(m, math.exp(p.logs[1]), p.z, (m,)) for m, p in sorted(points.items())]
    n_modes = len(rows.select("y").first()["y"])
    width = len(candidates[0].z) + n_modes
    slopes = {}
    for m, sums in gram.fetch(gram_pass(rows, kernel, candidates), width).items():
        k = len(points[m].z)
        slopes[m] = _slopes(kernel, points[m], Sums(sums[:-1, :k], sums[:-1, k + m], float(sums[-1, k + m]), int(round(sums[-1, 0]))))
    added = row_slopes(rows, kernel, points, slopes)
    return {m: (s.loss, s.logs + np.array([0.0, added[m][-1, 0], 0.0]), s.z + added[m][:-1]) for m, s in slopes.items()}


def _climb(rows, kernel, points: dict[int, Point], max_iter: int, move_z: bool, move_logs: bool, rule: str, rate: float) -> dict[int, tuple[float, Point]]:
    """Adam or Adadelta steps for all modes at once; the best point of each mode is kept.

    A mode that has not gained a hundred-thousandth for more than 50 steps stays where it is.
    """
    now = {m: Point(p.logs.copy(), p.z.copy()) for m, p in points.items()}
    best: dict[int, tuple[float, Point]] = {}
    mark, stale = dict.fromkeys(now, math.inf), dict.fromkeys(now, 0)
    first = {m: 0.0 for m in now}
    second = {m: 0.0 for m in now}
    for step in range(1, max_iter + 2):
        live = {m: p for m, p in now.items() if stale[m] <= 50}
        if not live:
            break
        for m, (loss, d_logs, d_z) in losses_and_gradients(rows, kernel, live).items():
            if m not in best or loss < best[m][0]:
                best[m] = (loss, Point(now[m].logs.copy(), now[m].z.copy()))
            gained = (mark[m] - loss) / max(abs(loss), 1e-12) > 10e-6
            mark[m], stale[m] = (loss, 0) if gained else (mark[m], stale[m] + 1)
            grad = np.concatenate((d_logs * move_logs, (d_z * move_z).ravel()))
            if rule == "adam":
                first[m] = 0.9 * first[m] + 0.1 * grad
                second[m] = 0.999 * second[m] + 0.001 * grad**2
                move = -rate * first[m] / (1 - 0.9**step) / (np.sqrt(second[m] / (1 - 0.999**step)) + 1e-7)
            else:
                second[m] = 0.95 * second[m] + 0.05 * grad**2
                unit = np.sqrt(first[m] + 1e-7) / np.sqrt(second[m] + 1e-7) * grad
                first[m] = 0.95 * first[m] + 0.05 * unit**2
                move = -rate * unit
            now[m] = Point(now[m].logs + move[:3], now[m].z + move[3:].reshape(now[m].z.shape))
    return best


def search_gradient(
    rows, kernel, z, initial: float, max_iter: int = 100, seed: int = 0, stages: Sequence[str] = ("z", "logs"), rule: str = "adam", rate: float = 0.001
) -> dict[int, Choice]:
    """Gradient steps from unit variance and noise: each stage moves the inducing points (z), the parameters (logs) or both."""
    points = _start(rows, z, initial)
    found: dict[int, tuple[float, Point]] = {}
    for stage in stages:
        found = _climb(rows, kernel, points, max_iter, stage != "logs", stage != "z", rule, rate)
        points = {m: p for m, (_, p) in found.items()}
    return _chosen(found)


def search_adam(rows, kernel, z, initial: float, max_iter: int = 100, seed: int = 0, rate: float = 0.001) -> dict[int, Choice]:
    """Adam on all parameters together."""
    return search_gradient(rows, kernel, z, initial, max_iter, seed, ("both",), "adam", rate)


def search_adadelta(rows, kernel, z, initial: float, max_iter: int = 100, seed: int = 0, rate: float = 0.001) -> dict[int, Choice]:
    """Adadelta on all parameters together."""
    return search_gradient(rows, kernel, z, initial, max_iter, seed, ("both",), "adadelta", rate)


HISTORY = 10  # pairs of steps and slopes that shape a quasi-Newton direction
TRIALS = (1.0, 0.25, 0.0625, 4.0)  # step lengths that are tried in one pass


def trial_losses(rows: DataFrame, kernel: str, trials: dict[int, tuple[int, Point]]) -> dict[int, Slopes]:
    """Loss and row-free derivatives of many (mode, point) trials, in one pass; infinite where the kernel matrix breaks down."""
    candidates = [Candidate(slot, math.exp(p.logs[1]), p.z, (m,)) for slot, (m, p) in sorted(trials.items())]
    width = len(candidates[0].z) + len(rows.select("y").first()["y"])
    out = {}
    for slot, sums in gram.fetch(gram_pass(rows, kernel, candidates), width).items():
        m, p = trials[slot]
        k = len(p.z)
        try:
            found = _slopes(kernel, p, Sums(sums[:-1, :k], sums[:-1, k + m], float(sums[-1, k + m]), int(round(sums[-1, 0]))))
        except np.linalg.LinAlgError:
            found = None
        good = found is not None and math.isfinite(found.loss) and np.isfinite(found.logs).all() and np.isfinite(found.z).all()
        out[slot] = found if good else Slopes(math.inf, np.zeros(3), np.zeros_like(p.z), np.zeros((k, k)), np.zeros(k))
    return out


@dataclass
class Descent:
    """State of one mode: free variables, loss, slope, and the last steps with the changes of slope they made."""

    x: np.ndarray
    loss: float
    slope: np.ndarray
    steps: list[np.ndarray]
    changes: list[np.ndarray]
    reach: float = 1.0
    failed: int = 0

    def direction(self) -> np.ndarray:
        """Quasi-Newton direction by the two loops over the remembered steps."""
        q, weights = self.slope.copy(), []
        for s, y in zip(reversed(self.steps), reversed(self.changes), strict=True):
            a = (s @ q) / (y @ s)
            weights.append(a)
            q -= a * y
        if self.steps:
            q *= (self.steps[-1] @ self.changes[-1]) / (self.changes[-1] @ self.changes[-1])
        for s, y, a in zip(self.steps, self.changes, reversed(weights), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        return -q


def _bfgs(
    rows, kernel, points: dict[int, Point], max_iter: int, move_z: bool, move_logs: bool, gain: float = 2e-9, flat: float = 1e-5
) -> dict[int, tuple[float, Point]]:
    """Limited-memory BFGS for all modes at once: a pass for all trial steps of all modes, and one for the slopes at those taken.

    A mode ends when a step gains less than ``gain`` of its loss, when its
    slope is flat, or when no step down is found twice in a row.
    """
    shape = next(iter(points.values())).z.shape

    def at(x: np.ndarray) -> Point:
        return Point(x[:3], x[3:].reshape(shape))

    def slopes_of(chosen: dict[int, tuple[np.ndarray, Slopes]]) -> dict[int, np.ndarray]:
        """Whole slopes at points whose Gram sums are known; fixed variables have none."""
        added = row_slopes(rows, kernel, {m: at(x) for m, (x, _) in chosen.items()}, {m: s for m, (_, s) in chosen.items()})
        out = {}
        for m, (_, s) in chosen.items():
            logs = s.logs + np.array([0.0, added[m][-1, 0], 0.0])
            out[m] = np.concatenate((logs * move_logs, ((s.z + added[m][:-1]) * move_z).ravel()))
        return out

    begin = {m: np.concatenate((p.logs, p.z.ravel())) for m, p in points.items()}
    first = trial_losses(rows, kernel, {m: (m, at(x)) for m, x in begin.items()})
    slope = slopes_of({m: (x, first[m]) for m, x in begin.items()})
    state = {m: Descent(x, first[m].loss, slope[m], [], []) for m, x in begin.items()}
    live = {m for m, d in state.items() if math.isfinite(d.loss) and np.abs(d.slope).max() > flat}
    for _ in range(max_iter):
        if not live:
            break
        trials, ways = {}, {}
        for m in sorted(live):
            d = state[m]
            way = d.direction()
            if way @ d.slope >= 0:
                d.steps, d.changes, way = [], [], -d.slope
            if not d.steps:
                way = way / max(1.0, np.abs(d.slope).sum())
            ways[m] = way
            for j, t in enumerate(TRIALS):
                trials[m * len(TRIALS) + j] = (m, at(d.x + d.reach * t * way))
        found = trial_losses(rows, kernel, trials)
        taken: dict[int, tuple[np.ndarray, Slopes]] = {}
        for m in sorted(live):
            d, way = state[m], ways[m]
            fall = way @ d.slope
            good = [(found[m * len(TRIALS) + j].loss, j) for j, t in enumerate(TRIALS) if found[m * len(TRIALS) + j].loss <= d.loss + 1e-4 * d.reach * t * fall]
            if good:
                _, j = min(good)
                taken[m] = (d.x + d.reach * TRIALS[j] * way, found[m * len(TRIALS) + j])
                continue
            d.steps, d.changes, d.reach, d.failed = [], [], d.reach / 64, d.failed + 1
            if d.failed > 2:
                live.discard(m)
        if not taken:
            continue
        for m, new in slopes_of(taken).items():
            d, (x, s) = state[m], taken[m]
            step, change = x - d.x, new - d.slope
            if step @ change > 1e-10 * (change @ change):
                d.steps, d.changes = [*d.steps, step][-HISTORY:], [*d.changes, change][-HISTORY:]
            small = d.loss - s.loss <= gain * max(abs(d.loss), abs(s.loss), 1.0)
            d.x, d.loss, d.slope, d.reach, d.failed = x, s.loss, new, 1.0, 0
            if small or np.abs(new).max() <= flat:
                live.discard(m)
    return {m: (d.loss, at(d.x)) for m, d in state.items()}


def _chosen(found: dict[int, tuple[float, Point]]) -> dict[int, Choice]:
    ten = math.log(10)
    return {m: Choice(m, p.logs[0] / ten, p.logs[1] / ten, p.logs[2] / ten, loss, p.z) for m, (loss, p) in found.items()}


def _start(rows, z, initial: float) -> dict[int, Point]:
    """Unit variance and noise for every mode."""
    return {m: Point(np.array([0.0, math.log(max(initial, 1e-6)), 0.0]), z.copy()) for m in range(len(rows.select("y").first()["y"]))}


def search_lbfgs(rows, kernel, z, initial: float, max_iter: int = 100, seed: int = 0) -> dict[int, Choice]:
    """Limited-memory BFGS on all parameters together. Parameters are logarithms, so that none needs a bound."""
    return _chosen(_bfgs(rows, kernel, _start(rows, z, initial), max_iter, True, True))


def search_three_stage(rows, kernel, z, initial: float, max_iter: int = 100, seed: int = 0, rate: float = 0.001) -> dict[int, Choice]:
    """Adam on the inducing points, then BFGS on the parameters, then BFGS on both."""
    points = {m: p for m, (_, p) in _climb(rows, kernel, _start(rows, z, initial), max_iter, True, False, "adam", rate).items()}
    points = {m: p for m, (_, p) in _bfgs(rows, kernel, points, max_iter, False, True).items()}
    return _chosen(_bfgs(rows, kernel, points, max_iter, True, True))


def search_random(rows, kernel, z, initial: float, n_starts: int = 40, tune: bool = True, seed: int = 1, polish: int = 0) -> dict[int, Choice]:
    """Random starts over hyper-parameters and inducing points, all in one pass; the lowest loss wins.

    ``polish`` steps of BFGS on all parameters, inducing points too, follow from there.
    """
    rng = np.random.default_rng(seed)
    limits = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = {r["i"]: (r["lo"], r["hi"]) for r in limits.collect()}
    lo = np.array([ends[i][0] for i in sorted(ends)])
    hi = np.array([ends[i][1] for i in sorted(ends)])
    candidates = []
    for slot in range(n_starts):
        v, ls, e = (rng.uniform(*b) for b in LOG_BOUNDS)
        candidates.append(Candidate(slot, 10**ls, rng.uniform(lo, hi, size=z.shape), None, v, e))
    # Starts are tuned within the range they are drawn from.
    best = _evaluate(rows, kernel, candidates, tune, (LOG_BOUNDS[0], LOG_BOUNDS[2]))
    if not polish:
        return best
    ten = math.log(10)
    points = {m: Point(ten * np.array([c.log_variance, c.log_lengthscale, c.log_noise]), np.array(c.z)) for m, c in best.items()}
    return _chosen(_bfgs(rows, kernel, points, polish, True, True))


def search_evolution(
    rows, kernel, z, initial: float, popsize: int = 5, max_iter: int = 20, seed: int = 1, patience: int = 5, tol: float = 1e-5
) -> dict[int, Choice]:
    """Differential evolution over the three log parameters, one pass per generation for all modes and members."""
    rng = np.random.default_rng(seed)
    n_modes = len(rows.select("y").first()["y"])
    lo, hi = (np.array([b[i] for b in LOG_BOUNDS]) for i in (0, 1))
    members = max(5, popsize * 3)
    pop = rng.uniform(lo, hi, size=(n_modes, members, 3))

    def losses(points: np.ndarray) -> np.ndarray:
        candidates = [
            Candidate(mode * members + i, 10 ** float(p[1]), z, (mode,), float(p[0]), float(p[2]))
            for mode in range(n_modes)
            for i, p in enumerate(points[mode])
        ]
        scored = score_pass(gram_pass(rows, kernel, candidates), kernel, candidates, tune=False)
        out = np.full((n_modes, members), math.inf)
        for r in scored.select("slot", "loss").collect():
            out[r["slot"] // members, r["slot"] % members] = r["loss"]
        return out

    cost = losses(pop)
    stale, last = 0, cost.min(axis=1)
    for _ in range(max_iter):
        trial = pop.copy()
        for mode in range(n_modes):
            leader = pop[mode, cost[mode].argmin()]
            for i in range(members):
                a, b = pop[mode, rng.choice([j for j in range(members) if j != i], 2, replace=False)]
                mutant = np.clip(leader + rng.uniform(0.5, 1.0) * (a - b), lo, hi)
                cross = rng.random(3) < 0.7
                cross[rng.integers(3)] = True
                trial[mode, i] = np.where(cross, mutant, pop[mode, i])
        fresh = losses(trial)
        won = fresh < cost
        pop[won], cost[won] = trial[won], fresh[won]
        now = cost.min(axis=1)
        improved = np.any((last - now) / np.maximum(np.abs(now), 1e-12) > tol)
        stale, last = (0, now) if improved else (stale + 1, now)
        if stale >= patience:
            break
    out = {}
    for mode in range(n_modes):
        i = int(cost[mode].argmin())
        v, ls, e = (float(p) for p in pop[mode, i])
        out[mode] = Choice(mode, v, ls, e, float(cost[mode, i]), z)
    return out


SEARCHES = {
    "profile": search_profile,
    "random": search_random,
    "evolution": search_evolution,
    "two-stage": search_gradient,
    "adam": search_adam,
    "adadelta": search_adadelta,
    "l-bfgs": search_lbfgs,
    "three-stage": search_three_stage,
}


# --- fit, predict, persist ------------------------------------------------------------------------


def fit_gpr(
    rows: DataFrame,
    kernel: str = "Matern32",
    n_inducing: int = 50,
    init: str = "kmeans",
    search: str = "profile",
    seed: int = 0,
    **options,
) -> DataFrame:
    """Fit one sparse GP per mode; ``rows`` has ``x`` and ``y`` arrays. Returns the model table."""
    check_kernel(kernel)
    if search not in SEARCHES:
        raise ValueError(f"unknown search {search!r}; use one of {sorted(SEARCHES)}")
    z = inducing_points(rows, n_inducing, init, seed)
    initial = rows.select(F.explode("x").alias("v")).agg(F.avg(F.abs("v"))).first()[0] or 1.0
    chosen = SEARCHES[search](rows, kernel, z, initial, **options)
    return solve_choices(rows, kernel, chosen)


def solve_choices(rows: DataFrame, kernel: str, chosen: dict[int, Choice]) -> DataFrame:
    """One more pass at the chosen parameters, then the factors every prediction needs."""
    modes = sorted(chosen)
    candidates = [
        Candidate(m, 10 ** chosen[m].log_lengthscale, chosen[m].z, (m,), chosen[m].log_variance, chosen[m].log_noise)
        for m in modes
    ]
    by_slot = {c.slot: c for c in candidates}
    losses = {m: chosen[m].loss for m in modes}

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        cand = by_slot[int(group["slot"].iloc[0])]
        phi, b, yy, n = _assemble(group, len(cand.z))
        s = Sums(phi, b[:, cand.slot], float(yy[cand.slot]), n)
        kuu = correlation(kernel, cand.z, cand.z, cand.lengthscale)
        variance, noise = 10**cand.log_variance, 10**cand.log_noise
        # The sums of this pass differ from those of the search in their last digits.
        linv, _, lb, c = _factors(kuu, s, variance, noise, settle=True)
        loss = loss_of(kuu, s, variance, cand.lengthscale, noise)
        if not math.isfinite(loss):
            loss = losses[cand.slot]
        return pd.DataFrame(
            {
                "mode": [cand.slot], "kernel": [kernel], "variance": [variance], "lengthscale": [cand.lengthscale],
                "noise": [noise], "loss": [loss], "z": [cand.z.tolist()], "c": [c.tolist()],
                "linv": [linv.tobytes()], "pinv": [np.linalg.solve(lb, linv).tobytes()],
            }
        )

    return cut_lineage(gram_pass(rows, kernel, candidates).groupBy("slot").applyInPandas(solve, MODEL))


def predict_gpr(x: DataFrame, model: DataFrame, noise: bool = True) -> DataFrame:
    """Mean and variance per mode for rows with an ``x`` array, as long rows ``(run, t, mode, mean, var)``."""
    m = len(model.select("c").first()["c"])
    if model.count() * m * m * 16 > MODEL_BYTES:
        raise ValueError("model too large to send to the tasks; fit fewer modes per table")
    parts = []
    for r in model.orderBy("mode").collect():
        shape = (len(r["c"]), len(r["c"]))
        parts.append(
            (
                r["mode"], r["kernel"], r["variance"], r["lengthscale"], r["noise"], np.array(r["z"]), np.array(r["c"]),
                np.frombuffer(bytes(r["linv"])).reshape(shape), np.frombuffer(bytes(r["pinv"])).reshape(shape),
            )
        )
    shared = x.sparkSession.sparkContext.broadcast(parts)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            points = np.array(batch["x"].tolist(), dtype=np.float64)
            for mode, kernel, variance, lengthscale, s2, z, c, linv, pinv in shared.value:
                k = variance * correlation(kernel, z, points, lengthscale)
                low, post = linv @ k, pinv @ k
                var = variance + (post * post).sum(0) - (low * low).sum(0) + (s2 if noise else 0.0)
                yield pd.DataFrame(
                    {"run": batch["run"], "t": batch["t"], "mode": mode, "mean": post.T @ c, "var": np.maximum(var, 0.0)}
                )

    return x.select("run", "t", "x").mapInPandas(predict, "run string, t int, mode int, mean double, var double")


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
