"""Exact measures between simple polygons, concave and with holes, for whole batches at once.

A shape is a list of rings: the outer one first, then its holes, each a list of
points without the closing one, in either direction. A batch of shapes becomes
flat coordinate arrays (Arrow's own buffers), and a batch of pairs becomes all
pairs of their edges; every measure is a sum, a minimum or a parity over the
edge pairs of a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<array<struct<x: double, y: double>>>"
# Edge pairs that a task holds at once.
BLOCK = 1 << 20


def parts_of(df: DataFrame) -> Column:
    """Rings of a row: ``ring`` and, where the table has them, ``holes`` (array of rings)."""
    outer = F.array("ring")
    whole = F.concat(outer, F.coalesce(F.col("holes"), F.array().cast(df.schema["holes"].dataType))) if "holes" in df.columns else outer
    return F.transform(whole, lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).cast(PARTS)


@dataclass
class Edges:
    """Edges of many shapes one after the other; shape k has those from ``at[k]`` to ``at[k + 1]``.

    ``turn`` is 1 where the shape lies left of the edge as it is given, else -1.
    """

    px: np.ndarray
    py: np.ndarray
    qx: np.ndarray
    qy: np.ndarray
    turn: np.ndarray
    at: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)


def edges_of(shapes: pa.Array) -> Edges:
    """Edges of an Arrow column of ``PARTS``; a null shape has none."""
    shapes = pa.concat_arrays([shapes]) if shapes.offset == 0 else pa.array(shapes.to_pylist(), shapes.type)
    outer = shapes.offsets.to_numpy().astype(np.int64)
    rings = shapes.values
    inner = rings.offsets.to_numpy().astype(np.int64)
    points = rings.values
    x, y = (points.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1))
    lo, hi = inner[outer[0]], inner[outer[-1]]
    after = np.arange(1, len(x) + 1)
    first, last = inner[:-1], inner[1:]
    full = last > first
    after[last[full] - 1] = first[full]
    qx, qy = x[after], y[after]
    # Twice the area of each ring, about its first point so that far-off coordinates lose nothing.
    owner = np.repeat(np.arange(len(first)), last - first)
    ox, oy = x[first[owner]], y[first[owner]]
    doubled = np.bincount(owner, (x[first[0] : last[-1]] - ox) * (qy[first[0] : last[-1]] - oy) - (qx[first[0] : last[-1]] - ox) * (y[first[0] : last[-1]] - oy), len(first)) if len(first) else np.zeros(0)
    want = np.full(len(first), -1.0)
    starts = outer[:-1][outer[1:] > outer[:-1]]
    want[starts] = 1.0
    turn = np.where(doubled < 0, -want, want)[owner]
    base = first[0] if len(first) else 0
    return Edges(x[lo:hi], y[lo:hi], qx[lo:hi], qy[lo:hi], turn[lo - base : hi - base], inner[outer] - lo)


def _blocks(a: Edges, b: Edges) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of pairs with about ``BLOCK`` edge pairs: (pairs, edges of a, edges of b, where each pair begins).

    Pair k has shape k of both; every pair must have edges on both sides.
    """
    na, nb = a.sizes(), b.sizes()
    count = na * nb
    upto = np.concatenate(([0], np.cumsum(count)))
    k = 0
    while k < len(count):
        end = max(k + 1, int(np.searchsorted(upto, upto[k] + BLOCK, side="right")) - 1)
        own = count[k:end]
        pair = np.repeat(np.arange(k, end), own)
        begin = upto[k:end] - upto[k]
        local = np.arange(int(own.sum())) - np.repeat(begin, own)
        i, j = local // nb[pair], local % nb[pair]
        yield slice(k, end), a.at[pair] + i, b.at[pair] + j, begin
        k = end


def _measured(a: Edges, b: Edges, empty: float, measure: Callable[[Edges, Edges, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    out = np.full(len(a.at) - 1, empty)
    good = np.flatnonzero((a.sizes() > 0) & (b.sizes() > 0))
    if len(good) < len(out):
        a, b = _taken(a, good), _taken(b, good)
    for pairs, i, j, begin in _blocks(a, b):
        out[good[pairs]] = measure(a, b, i, j, begin)
    return out


def _taken(e: Edges, rows: np.ndarray) -> Edges:
    n = e.sizes()[rows]
    at = np.concatenate(([0], np.cumsum(n)))
    flat = np.repeat(e.at[rows] - at[:-1], n) + np.arange(at[-1])
    return Edges(e.px[flat], e.py[flat], e.qx[flat], e.qy[flat], e.turn[flat], at)


def areas(a: Edges, b: Edges) -> np.ndarray:
    """Area that the shapes of each pair have in common.

    Each edge bounds the half-infinite trapezoid right of it; with a sign for
    its direction, a shape is the sum of its trapezoids. Two trapezoids share
    the strip of heights both have, from the farther of the two edges on. All
    that depends on one edge alone cancels along the other shape, which leaves
    minus half the signed sum of the areas between the two edges.
    """

    def measure(a: Edges, b: Edges, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        lo = np.maximum(np.minimum(a.py[i], a.qy[i]), np.minimum(b.py[j], b.qy[j]))
        hi = np.minimum(np.maximum(a.py[i], a.qy[i]), np.maximum(b.py[j], b.qy[j]))
        some = hi > lo
        lo, hi = np.where(some, lo, 0.0), np.where(some, hi, 0.0)

        def x_at(e: Edges, k: np.ndarray, y: np.ndarray) -> np.ndarray:
            rise = e.qy[k] - e.py[k]
            return e.px[k] + (e.qx[k] - e.px[k]) * np.divide(y - e.py[k], rise, out=np.zeros_like(y), where=rise != 0)

        d0, d1 = x_at(a, i, lo) - x_at(b, j, lo), x_at(a, i, hi) - x_at(b, j, hi)
        both = np.abs(d0) + np.abs(d1)
        # Edges that cross leave two triangles between them.
        mean = np.where(d0 * d1 >= 0, both / 2, np.divide(d0 * d0 + d1 * d1, 2 * both, out=np.zeros_like(both), where=both > 0))
        sign = a.turn[i] * b.turn[j] * np.sign(a.py[i] - a.qy[i]) * np.sign(b.py[j] - b.qy[j])
        return -0.5 * np.add.reduceat(np.where(some, sign * mean * (hi - lo), 0.0), begin)

    return np.maximum(_measured(a, b, 0.0, measure), 0.0)


def _side(px, py, qx, qy, x, y):
    return (qx - px) * (y - py) - (qy - py) * (x - px)


def _meets(a: Edges, b: Edges, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two edges share a point."""
    apx, apy, aqx, aqy = a.px[i], a.py[i], a.qx[i], a.qy[i]
    bpx, bpy, bqx, bqy = b.px[j], b.py[j], b.qx[j], b.qy[j]
    near = (np.minimum(apx, aqx) <= np.maximum(bpx, bqx)) & (np.minimum(bpx, bqx) <= np.maximum(apx, aqx))
    near &= (np.minimum(apy, aqy) <= np.maximum(bpy, bqy)) & (np.minimum(bpy, bqy) <= np.maximum(apy, aqy))
    s1, s2 = np.sign(_side(apx, apy, aqx, aqy, bpx, bpy)), np.sign(_side(apx, apy, aqx, aqy, bqx, bqy))
    s3, s4 = np.sign(_side(bpx, bpy, bqx, bqy, apx, apy)), np.sign(_side(bpx, bpy, bqx, bqy, aqx, aqy))
    return near & (s1 * s2 <= 0) & (s3 * s4 <= 0)


def _odd(e: Edges, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the ray from a point to the right crosses an edge."""
    over = (e.py[k] > y) != (e.qy[k] > y)
    rise = e.qy[k] - e.py[k]
    at = e.px[k] + (e.qx[k] - e.px[k]) * np.divide(y - e.py[k], rise, out=np.zeros_like(y), where=rise != 0)
    return over & (x < at)


def _touching(a: Edges, b: Edges, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
    pair = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(i))))
    ai, bj = i[begin][pair], j[begin][pair]
    # The first point of one in the other: crossings of all its edges, each once.
    inside_b = _odd(b, j, a.px[ai], a.py[ai]) & (i == ai)
    inside_a = _odd(a, i, b.px[bj], b.py[bj]) & (j == bj)
    odd = (np.add.reduceat(inside_b.astype(np.int64), begin) % 2 == 1) | (np.add.reduceat(inside_a.astype(np.int64), begin) % 2 == 1)
    return odd | np.logical_or.reduceat(_meets(a, b, i, j), begin)


def touching(a: Edges, b: Edges) -> np.ndarray:
    """Whether the shapes of each pair share any point."""
    return _measured(a, b, 0.0, lambda *args: _touching(*args).astype(float)) > 0


def distances(a: Edges, b: Edges) -> np.ndarray:
    """Smallest distance between the shapes of each pair, 0 where they touch; infinite for an empty shape."""

    def to_edge(e: Edges, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ux, uy = e.qx[k] - e.px[k], e.qy[k] - e.py[k]
        long = ux * ux + uy * uy
        along = np.divide((x - e.px[k]) * ux + (y - e.py[k]) * uy, long, out=np.zeros_like(x), where=long > 0)
        along = np.clip(along, 0.0, 1.0)
        return np.hypot(x - e.px[k] - along * ux, y - e.py[k] - along * uy)

    def measure(a: Edges, b: Edges, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        # Edges that do not meet are nearest at an end of one of them; every point is the start of an edge.
        least = np.minimum(to_edge(b, j, a.px[i], a.py[i]), to_edge(a, i, b.px[j], b.py[j]))
        return np.where(_touching(a, b, i, j, begin), 0.0, np.minimum.reduceat(least, begin))

    return _measured(a, b, np.inf, measure)


# ---------------------------------------------------------------- as columns


def _pairwise(measure: Callable[[Edges, Edges], np.ndarray]):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(measure(edges_of(a), edges_of(b)).astype(np.float64))

    return run


def common_area(a: Column, b: Column) -> Column:
    """Common area of two columns of ``PARTS``."""
    return _pairwise(areas)(a, b)


def distance(a: Column, b: Column) -> Column:
    """Distance of two columns of ``PARTS``."""
    return _pairwise(distances)(a, b)


def touch(a: Column, b: Column) -> Column:
    """Whether two columns of ``PARTS`` share a point; a ring of two points is a segment."""

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(touching(edges_of(a), edges_of(b)))

    return run(a, b)


def touches(parts: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a column of ``PARTS`` shares a point with one given ring."""
    area = edges_of(pa.array([[[{"x": float(x), "y": float(y)} for x, y in ring]]], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))

    @F.arrow_udf("boolean")
    def run(a: pa.Array) -> pa.Array:
        own = edges_of(a)
        n, m = len(own.at) - 1, len(area.px)
        out = np.zeros(n, dtype=bool)
        # The ring is laid beside as many shapes as a block holds.
        step = max(1, BLOCK // max(1, m * 8))
        for lo in range(0, n, step):
            rows = np.arange(lo, min(n, lo + step))
            cut = _taken(own, rows)
            out[rows] = touching(cut, _taken(area, np.zeros(len(rows), dtype=np.int64)))
        return pa.array(out)

    return run(parts)
