"""Spatial joins without a geometry library.

Shapes carry a bounding box ``x0, y0, x1, y1`` and, unless they are axis-aligned
rectangles, a ``ring``: array of ``struct<x, y>`` without the closing point, and
if they have any, ``holes``: an array of such rings. Rings may be concave but
must not cross themselves. All tables share one coordinate system.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import scan
from freshet.functions.exprs import floor_to_ground
from freshet.operators import polygons
from freshet.operators.joins import pair_up
from freshet.session import cut_lineage

BOX = ("x0", "y0", "x1", "y1")


def with_box(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the bounding box of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return df.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def rectangle_ring(df: DataFrame) -> DataFrame:
    """Ring of the four corners of a box, counter-clockwise."""

    def corner(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    return df.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


# --- candidate pairs ------------------------------------------------------------------------------


def _own_level() -> Column:
    """Power of two that is at least as large as the box."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    return F.ceil(F.log2(size)).cast("int")


def _binned(df: DataFrame, other_levels: Sequence[int], own_kind: str, far_kind: str) -> DataFrame:
    """Rows per grid bin: at the box's own level, and at every larger level the other side has."""
    own = F.col("_own")
    coarser = F.filter(F.array(*[F.lit(v) for v in other_levels]), lambda v: v > own)
    at_own = F.filter(
        F.array(
            F.struct(own.alias("level"), F.lit("both").alias("kind")),
            F.struct(own.alias("level"), F.lit(own_kind).alias("kind")),
        ),
        lambda s: F.when(s["kind"] == "both", own.isin(*other_levels)).otherwise(own > min(other_levels)),
    )
    at_coarser = F.transform(coarser, lambda v: F.struct(v.alias("level"), F.lit(far_kind).alias("kind")))

    def bins(s: Column) -> Column:
        size = F.pow(F.lit(2.0), s["level"])

        def span(lo: str, hi: str) -> Column:
            return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

        def place(bx: Column, by: Column) -> Column:
            return F.struct(s["level"].alias("_level"), s["kind"].alias("_kind"), bx.alias("_bx"), by.alias("_by"))

        return F.flatten(F.transform(span("_x0", "_x1"), lambda bx: F.transform(span("_y0", "_y1"), lambda by: place(bx, by))))

    return df.select("*", F.inline(F.flatten(F.transform(F.concat(at_own, at_coarser), bins))))


def box_pairs(left: DataFrame, right: DataFrame, left_name: str = "l", right_name: str = "r") -> DataFrame:
    """Pairs of rows whose boxes touch or overlap, each once, as two structs.

    Every box is filed in a grid whose bins are about its own size, so a bin
    holds few boxes even where one mesh is much finer than the other. A pair
    meets at the level of the larger box, in the bin that holds the lower left
    corner of the common part.
    """

    def prepared(df: DataFrame, name: str) -> DataFrame:
        named = [F.col(c).alias(f"{name}__{c}") for c in df.columns]
        return df.select(*named, *[F.col(c).alias(f"_{c}") for c in BOX], _own_level().alias("_own"))

    a, b = prepared(left, left_name), prepared(right, right_name)
    # Sizes differ by at most a few dozen powers of two.
    a_levels = [r[0] for r in a.select("_own").distinct().collect()]
    b_levels = [r[0] for r in b.select("_own").distinct().collect()]
    key = ["_level", "_kind", "_bx", "_by"]

    def filed(df: DataFrame, levels: list[int], own_kind: str, far_kind: str, name: str) -> DataFrame:
        rows = _binned(df, levels or [0], own_kind, far_kind)
        return rows.select(*key, *[c for c in rows.columns if c.startswith(f"{name}__")])

    # Filed rows are many times the rows they come from, which estimates of a side's size do not see: they are never broadcast.
    joined = filed(a, b_levels, "left", "right", left_name).join(filed(b, a_levels, "right", "left", right_name).hint("merge"), key)

    def p(c: str) -> Column:
        return F.col(f"{left_name}__{c}")

    def q(c: str) -> Column:
        return F.col(f"{right_name}__{c}")

    size = F.pow(F.lit(2.0), F.col("_level"))
    overlap = (p("x0") <= q("x1")) & (q("x0") <= p("x1")) & (p("y0") <= q("y1")) & (q("y0") <= p("y1"))
    here = (F.floor(F.greatest(p("x0"), q("x0")) / size) == F.col("_bx")) & (
        F.floor(F.greatest(p("y0"), q("y0")) / size) == F.col("_by")
    )
    return joined.where(overlap & here).select(
        F.struct(*[p(c).alias(c) for c in left.columns]).alias(left_name),
        F.struct(*[q(c).alias(c) for c in right.columns]).alias(right_name),
    )


# --- largest overlap ------------------------------------------------------------------------------


def clip_area(subject: np.ndarray, window: np.ndarray) -> float:
    """Area two simple rings have in common."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    one, two = (polygons.edges_of(pa.array([[[{"x": float(x), "y": float(y)} for x, y in ring]]], kind)) for ring in (subject, window))
    return float(polygons.areas(one, two)[0])


def with_parts(df: DataFrame) -> DataFrame:
    """Add ``_parts``: all rings of a shape, those of its box if it has none of its own."""
    shaped = df if "ring" in df.columns else rectangle_ring(df)
    return shaped.withColumn("_parts", polygons.parts_of(shaped)).select(*df.columns, "_parts")


def overlap_areas(hf_mesh: DataFrame, lf_mesh: DataFrame) -> DataFrame:
    """Common area of every overlapping pair ``(cell_id, lf_cell_id, area)``."""
    rings = "ring" in hf_mesh.columns or "ring" in lf_mesh.columns
    left, right = hf_mesh.select("cell_id", *BOX), lf_mesh.select("lf_cell_id", *BOX)
    if rings:
        left, right = (with_parts(df).select(key, *BOX, "_parts") for df, key in ((hf_mesh, "cell_id"), (lf_mesh, "lf_cell_id")))
    pairs = box_pairs(left, right)
    p, q = F.col("l"), F.col("r")
    width = F.least(p["x1"], q["x1"]) - F.greatest(p["x0"], q["x0"])
    height = F.least(p["y1"], q["y1"]) - F.greatest(p["y0"], q["y0"])
    inner = pairs.where((width > 0) & (height > 0))
    area = polygons.common_area(p["_parts"], q["_parts"]) if rings else width * height
    found = inner.select(p["cell_id"].alias("cell_id"), q["lf_cell_id"].alias("lf_cell_id"), area.alias("area"), (width * height).alias("_box"))
    # What rounding leaves of shapes that only touch is no overlap.
    return found.where(F.col("area") > F.col("_box") * 1e-12).drop("_box")


def largest_overlap(hf_mesh: DataFrame, lf_mesh: DataFrame, require_all: bool = True) -> DataFrame:
    """Low-fidelity cell that covers most of each high-fidelity cell; the lowest id wins a tie.

    A cell without any overlap is an error unless ``require_all`` is off.
    """
    best = overlap_areas(hf_mesh, lf_mesh).groupBy("cell_id").agg(
        F.max_by("lf_cell_id", F.struct(F.col("area"), -F.col("lf_cell_id"))).alias("lf_cell_id"),
        F.max("area").alias("area"),
    )
    if not require_all:
        return best
    missing = F.raise_error(F.concat(F.lit("no low-fidelity cell under cell "), F.col("cell_id").cast("string")))
    return hf_mesh.select("cell_id").join(best, "cell_id", "left").select(
        "cell_id", F.when(F.col("lf_cell_id").isNull(), missing.cast("int")).otherwise(F.col("lf_cell_id")).alias("lf_cell_id"),
        "area",
    )


# --- area of interest -----------------------------------------------------------------------------


def within_aoi(mesh: DataFrame, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """Cells that share any point with the area of interest.

    The box test reaches the scan; rectangles need no more for a rectangular
    area. Other areas are tested exactly, batch by batch.
    """
    area = np.array(ring, dtype=float)
    (lo_x, lo_y), (hi_x, hi_y) = area.min(axis=0).tolist(), area.max(axis=0).tolist()
    near = mesh.where(
        (F.col("x0") <= hi_x) & (F.col("x1") >= lo_x) & (F.col("y0") <= hi_y) & (F.col("y1") >= lo_y)
    )
    is_box = len(area) == 4 and {tuple(p) for p in area.tolist()} == {
        (lo_x, lo_y), (hi_x, lo_y), (hi_x, hi_y), (lo_x, hi_y)
    }
    if is_box and "ring" not in mesh.columns:
        return near

    return with_parts(near).where(polygons.touches(F.col("_parts"), ring)).select(*mesh.columns)


# --- nearest --------------------------------------------------------------------------------------


def box_distance(p: Column, q: Column) -> Column:
    """Distance between two boxes, 0 when they touch."""
    gap_x = F.greatest(F.lit(0.0), p["x0"] - q["x1"], q["x0"] - p["x1"])
    gap_y = F.greatest(F.lit(0.0), p["y0"] - q["y1"], q["y0"] - p["y1"])
    return F.sqrt(gap_x * gap_x + gap_y * gap_y)


BRANCH = 8  # children of a node along each axis
LEAF_ROWS = 8  # right rows of a leaf, about
DEEPEST = 6


def _boxes(df: DataFrame, prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def _farthest(point: Column, box: Column) -> Column:
    """Distance of the corner of a box that is farthest from a point."""
    dx = F.greatest(F.abs(point["x"] - box["x0"]), F.abs(point["x"] - box["x1"]))
    dy = F.greatest(F.abs(point["y"] - box["y0"]), F.abs(point["y"] - box["y1"]))
    return F.sqrt(dx * dx + dy * dy)


def _depth(bins: DataFrame) -> int:
    """Levels of a tree whose leaves hold few rows each, from the rows' bins at the deepest level.

    What counts is how many rows a row finds in its leaf, not the rows a bin of
    the whole square would hold: boxes along a line need more levels. Where
    more levels do not help, as with copies, fewer are taken.
    """
    up = F.pow(F.lit(float(BRANCH)), F.lit(DEEPEST) - F.col("_level"))
    levels = bins.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(DEEPEST))))
    sizes = levels.groupBy("_level", F.floor(F.col("_bx") / up), F.floor(F.col("_by") / up)).agg(F.count("*").cast("double").alias("n"))
    crowd = {r["_level"]: r["c"] for r in sizes.groupBy("_level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("c")).collect()}
    enough = max(2.0 * LEAF_ROWS, 1.05 * crowd[DEEPEST])
    return min(level for level, c in crowd.items() if c <= enough)


def nearest_candidates(left: DataFrame, right: DataFrame, left_id: str = "cell_id", right_id: str = "near_id") -> DataFrame:
    """Pairs ``(left_id, right_id, _low)`` among which the nearest partner of every left box is; ``_low`` is the boxes' distance.

    The right boxes are filed in a tree of bins, 64 children a node, whose
    nodes know the box around all below them. Left rows go down level by level.
    The farthest corner of a child's box bounds the distance of the nearest
    partner from above, the nearest point of its box from below, so a row keeps
    the children whose lower bound is within the least upper bound it has seen.
    Neither the distance nor the crowding of the right boxes near a row makes
    it look at more than the bins around its nearest ones.
    """
    finite = F.forall(F.array(*BOX), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    bad = left.select(finite.alias("ok")).unionByName(right.select(finite.alias("ok"))).where(~F.col("ok"))
    if not bad.isEmpty():
        raise ValueError("boxes need finite coordinates")
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    whole = right.agg(F.count("*").alias("n"), F.min(mid_x).alias("x"), F.min(mid_y).alias("y"), F.max(mid_x).alias("x1"), F.max(mid_y).alias("y1")).first()
    if not whole["n"]:
        raise ValueError("nothing to be near to")
    side = max(whole["x1"] - whole["x"], whole["y1"] - whole["y"]) or 1.0

    def placed(depth: int) -> list[Column]:
        cells = BRANCH**depth
        at = [F.least(F.floor((mid - whole[c]) / side * cells), F.lit(cells - 1)) for mid, c in ((mid_x, "x"), (mid_y, "y"))]
        return [at[0].alias("_bx"), at[1].alias("_by")]

    depth = _depth(right.select(*placed(DEEPEST)))
    filed = cut_lineage(right.select(right_id, *BOX, *placed(depth)))
    nodes = filed.groupBy("_bx", "_by").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    tree = []
    for _ in range(depth):
        up = nodes.groupBy(F.floor(F.col("_bx") / BRANCH).alias("_px"), F.floor(F.col("_by") / BRANCH).alias("_py"))
        nodes = up.agg(
            F.collect_list(F.struct("_bx", "_by", _boxes(nodes).alias("box"))).alias("_children"),
            *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
        ).withColumnsRenamed({"_px": "_bx", "_py": "_by"})
        tree.append(nodes.select("_bx", "_by", "_children"))

    zero = F.lit(0).cast("long")
    rows = left.select(F.col(left_id), _boxes(left).alias("_box"), zero.alias("_bx"), zero.alias("_by"))
    for at, level in enumerate(reversed(tree)):
        # The top has one node and the next level at most 64; a shuffle by node would put all rows in so many tasks.
        level = F.broadcast(level) if at < 2 else level
        box = F.col("_box")
        middle = F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))
        seen = rows.join(level, ["_bx", "_by"]).select(
            left_id, "_box",
            F.transform(
                "_children", lambda c: F.struct(box_distance(F.col("_box"), c["box"]).alias("low"), _farthest(middle, c["box"]).alias("high"), c["_bx"].alias("bx"), c["_by"].alias("by"))
            ).alias("_c"),
        )
        seen = seen.withColumn("_high", F.array_min(F.transform("_c", lambda c: c["high"])))
        # The bounds are rounded; a little slack keeps the true nearest.
        seen = seen.withColumn("_c", F.filter("_c", lambda c: c["low"] <= F.col("_high") * (1 + 1e-12)))
        one = seen.groupBy(left_id).agg(F.first("_box").alias("_box"), F.min("_high").alias("_high"), F.flatten(F.collect_list("_c")).alias("_c"))
        kept = F.filter("_c", lambda c: c["low"] <= F.col("_high") * (1 + 1e-12))
        rows = one.select(left_id, "_box", "_high", F.explode(F.transform(kept, lambda c: F.struct(c["bx"].alias("bx"), c["by"].alias("by")))).alias("_at"))
        rows = rows.select(left_id, "_box", "_high", F.col("_at.bx").alias("_bx"), F.col("_at.by").alias("_by"))
    pairs = rows.join(filed, ["_bx", "_by"])
    low = box_distance(F.col("_box"), _boxes(pairs))
    return pairs.select(left_id, right_id, low.alias("_low"), "_high").where(F.col("_low") <= F.col("_high") * (1 + 1e-12)).drop("_high")


def _ends(parts: str) -> Column:
    """The outermost points of a shape along both axes."""
    ring = F.get(parts, 0)
    turned = F.transform(ring, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    found = [F.array_min(ring), F.array_max(ring), F.array_min(turned), F.array_max(turned)]
    return F.array(*[F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in found])


def nearest(left: DataFrame, right: DataFrame, left_id: str = "cell_id", right_id: str = "near_id") -> DataFrame:
    """Closest right shape of every left shape; the lowest id wins a tie.

    Tables without rings are measured by their boxes. With rings on either
    side, the distance is that of the polygons, 0 where they touch or one lies
    in the other (but not in its holes); a row's candidates are first cut by
    the least distance between outermost points of its shape and of one of them.
    """
    pairs = nearest_candidates(left, right, left_id, right_id)
    best = F.min(F.struct(F.col("dist"), F.col(right_id))).alias("_m")
    if "ring" not in left.columns and "ring" not in right.columns:
        found = pairs.withColumnRenamed("_low", "dist").groupBy(left_id).agg(best)
        return found.select(left_id, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.dist").alias("dist"))
    a, b = with_parts(left).select(left_id, F.col("_parts").alias("_a")), with_parts(right).select(right_id, F.col("_parts").alias("_b"))
    ends = pairs.join(a.select(left_id, _ends("_a").alias("_p")), left_id).join(b.select(right_id, _ends("_b").alias("_q")), right_id)
    # Shapes are no farther apart than any two of their points.
    apart = F.flatten(F.transform("_p", lambda p: F.transform("_q", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    ends = ends.select(left_id, right_id, "_low", F.coalesce(F.array_min(apart), F.lit(math.inf)).alias("_most"))
    near = ends.groupBy(left_id).agg(F.min("_most").alias("_least"), F.collect_list(F.struct("_low", F.col(right_id).alias("id"))).alias("_c"))
    near = near.select(left_id, F.explode(F.filter("_c", lambda c: c["_low"] <= F.col("_least") * (1 + 1e-12))).alias("_c"))
    asked = near.select(left_id, F.col("_c.id").alias(right_id)).join(a.select(left_id, "_a"), left_id).join(b.select(right_id, "_b"), right_id)
    found = asked.select(left_id, right_id, polygons.distance(F.col("_a"), F.col("_b")).alias("dist")).groupBy(left_id).agg(best)
    return found.select(left_id, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.dist").alias("dist"))


# --- rasters --------------------------------------------------------------------------------------


def rasterize(shapes: DataFrame, spec: dict) -> DataFrame:
    """Pixels ``(row, col)`` of a north-up raster whose area any of the shapes reaches into.

    Scan lines: every edge of a shape is cut by the pixel rows it passes, which
    gives the columns it runs through there and where it crosses the middle of
    the row. The columns between the odd and the even crossings of a row are
    inside. So a row of a shape is one small group, whatever the shape's size,
    and pixels are only made from a row's runs of columns.
    """
    cell = float(spec["cell"])
    left, top, n_rows, n_cols = float(spec["left"]), float(spec["top"]), int(spec["nrows"]), int(spec["ncols"])
    shaped = with_parts(shapes).select(F.monotonically_increasing_id().alias("_shape"), "_parts").select("_shape", F.explode("_parts").alias("ring"))
    # In units of pixels: columns to the right, rows downwards.
    at = F.transform("ring", lambda p: F.struct(((p["x"] - left) / cell).alias("x"), ((F.lit(top) - p["y"]) / cell).alias("y")))
    n = F.size("ring")
    after = F.concat(F.slice("ring", 2, F.greatest(n - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = shaped.select("_shape", at.alias("ring")).select("_shape", F.inline(F.arrays_zip(F.col("ring").alias("p"), after.alias("q"))))
    edges = edges.select("_shape", *[F.col(f"{e}.{c}").alias(e + c) for e in "pq" for c in "xy"])
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    first, last = F.greatest(F.floor(low), F.lit(0)), F.least(F.floor(high), F.lit(n_rows - 1))
    lines = edges.withColumns({"_lo": low, "_hi": high}).withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last))))

    def x_at(y: Column) -> Column:
        return F.col("px") + (F.col("qx") - F.col("px")) * (y - F.col("py")) / F.nullif(F.col("qy") - F.col("py"), F.lit(0.0))

    top_y, bottom_y, middle = F.greatest(F.col("_lo"), F.col("row")), F.least(F.col("_hi"), F.col("row") + 1), F.col("row") + 0.5
    flat = F.col("_lo") == F.col("_hi")
    a, b = F.when(flat, F.col("px")).otherwise(x_at(top_y)), F.when(flat, F.col("qx")).otherwise(x_at(bottom_y))
    # Only what lies between the borders of the row counts; an edge along a border has no pixel of its own.
    within = F.when(flat, F.col("_lo") > F.col("row")).otherwise(bottom_y > top_y)
    crossing = F.when((F.col("_lo") <= middle) & (middle < F.col("_hi")), x_at(middle))
    lines = lines.select("_shape", "row", F.when(within, F.least(a, b)).alias("_from"), F.when(within, F.greatest(a, b)).alias("_to"), crossing.alias("_x"))
    passed = F.struct(
        F.floor("_from").alias("a"),
        # A stretch without width stands in the pixel it is inside of, on a border in none.
        F.when(F.col("_from") == F.col("_to"), F.ceil("_from") - 1).otherwise(F.greatest(F.ceil("_to") - 1, F.floor("_from"))).alias("b"),
    )
    rows = lines.groupBy("_shape", "row").agg(
        F.array_distinct(F.collect_list(F.when(F.col("_from").isNotNull(), passed))).alias("_runs"), F.sort_array(F.collect_list("_x")).alias("_x")
    )
    pairs = F.when(F.size("_x") > 1, F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)))
    # Pixels whose middle lies between two crossings.
    inside = F.transform(pairs, lambda k: F.struct(F.ceil(F.get("_x", k) - 0.5).alias("a"), (F.ceil(F.get("_x", k + 1) - 0.5) - 1).alias("b")))
    runs = rows.select("row", F.explode(F.concat("_runs", F.coalesce(inside, F.array().cast("array<struct<a:bigint,b:bigint>>")))).alias("run"))
    runs = runs.select("row", F.greatest(F.col("run.a"), F.lit(0)).alias("a"), F.least(F.col("run.b"), F.lit(n_cols - 1)).alias("b")).where("a <= b")
    pixels = runs.select("row", F.explode(F.sequence("a", "b")).alias("col"))
    return pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()


# --- interpolation on a triangulation -------------------------------------------------------------


def triangle_weights(triangles: DataFrame, points: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Static weights ``(cell_id, lf_cell_id, w)``: barycentric coordinates of points in their triangle.

    ``triangles``: ``tri_id, a_id, ax, ay, b_id, bx, by, c_id, cx, cy``; ``points``: ``cell_id, x, y``.
    A point on an edge belongs to the triangle with the lowest id; one outside gets no row.
    """
    boxed = triangles.withColumns(
        {
            "x0": F.least("ax", "bx", "cx"), "x1": F.greatest("ax", "bx", "cx"),
            "y0": F.least("ay", "by", "cy"), "y1": F.greatest("ay", "by", "cy"),
        }
    )
    spots = points.select("cell_id", "x", "y", *[F.col(c[0]).alias(c) for c in BOX])
    pairs = box_pairs(spots, boxed).select(
        F.col("l.cell_id").alias("cell_id"), F.col("l.x").alias("x"), F.col("l.y").alias("y"), "r.*"
    )
    double_area = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (
        F.col("ay") - F.col("cy")
    )
    wa = F.try_divide(
        (F.col("by") - F.col("cy")) * (F.col("x") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("y") - F.col("cy")),
        double_area,
    )
    wb = F.try_divide(
        (F.col("cy") - F.col("ay")) * (F.col("x") - F.col("cx")) + (F.col("ax") - F.col("cx")) * (F.col("y") - F.col("cy")),
        double_area,
    )
    inside = (
        pairs.withColumns({"wa": wa, "wb": wb})
        .withColumn("wc", 1 - F.col("wa") - F.col("wb"))
        .where((F.col("wa") >= -slack) & (F.col("wb") >= -slack) & (F.col("wc") >= -slack))
    )
    corners = F.array(
        *[F.struct(F.col(f"{c}_id").alias("lf_cell_id"), F.col(f"w{c}").alias("w")) for c in ("a", "b", "c")]
    )
    one = inside.groupBy("cell_id").agg(F.min_by(corners, F.col("tri_id")).alias("_corners"))
    return one.select("cell_id", F.inline("_corners"))


def interpolate_surface(lf: DataFrame, weights: DataFrame, cells: DataFrame) -> DataFrame:
    """Interpolated level of every cell per run and step, never below ground; ground outside the hull.

    ``cells``: ``cell_id, elevation``. A cell with a corner that has no level at
    a step (no row, NULL or NaN) is at ground there.
    """
    mapped = weights.join(cells.select("cell_id", "elevation"), "cell_id")
    spread = lf.withColumnRenamed("cell_id", "lf_cell_id").join(mapped, "lf_cell_id")
    level = F.when(~F.isnan("value"), F.col("w") * F.col("value"))
    summed = spread.groupBy("run", "t", "cell_id").agg(
        F.when(F.count(level) == 3, F.sum(level)).alias("value"), F.first("elevation").alias("elevation")
    )
    inside = summed.select("run", "t", "cell_id", floor_to_ground("value", "elevation").alias("value"))
    outside = cells.join(weights.select("cell_id").distinct(), "cell_id", "left_anti").select("cell_id", "elevation")
    dry = pair_up(lf.select("run", "t").distinct(), outside)
    return inside.unionByName(dry.select("run", "t", "cell_id", F.col("elevation").alias("value")))


# --- stations along a line ------------------------------------------------------------------------


def line_segments(line: DataFrame) -> DataFrame:
    """Segments of a polyline (``ord, x, y``, ``ord`` dense from 0) with the distance at which each starts."""
    led = scan.look_ahead(line, [], "ord", ["x", "y"], 1).where(F.col("x_1").isNotNull())
    length = F.hypot(F.col("x_1") - F.col("x"), F.col("y_1") - F.col("y"))
    measured = scan.running_sum(led.withColumn("length", length), [], ["ord"], scan.chunk_of("ord"), {"upto": "length"})
    return measured.select(
        F.col("ord").alias("segment"), F.col("x").alias("px"), F.col("y").alias("py"),
        F.col("x_1").alias("qx"), F.col("y_1").alias("qy"), (F.col("upto") - F.col("length")).alias("start"), "length",
        F.least("x", "x_1").alias("x0"), F.least("y", "y_1").alias("y0"),
        F.greatest("x", "x_1").alias("x1"), F.greatest("y", "y_1").alias("y1"),
    )


def ring_edges(mesh: DataFrame) -> DataFrame:
    """Edges of every ring with their boxes."""
    n = F.size("ring")
    following = F.concat(F.slice("ring", 2, F.greatest(n - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = mesh.select("cell_id", F.inline(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))))
    return edges.select(
        "cell_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"),
        F.least("p.x", "q.x").alias("x0"), F.least("p.y", "q.y").alias("y0"),
        F.greatest("p.x", "q.x").alias("x1"), F.greatest("p.y", "q.y").alias("y1"),
    )


def cell_stations(mesh: DataFrame, line: DataFrame) -> DataFrame:
    """Mean distance along the line of the points where it crosses each cell's boundary.

    Crossings at a shared corner count once; stretches that run along an edge do not count.
    """
    shaped = mesh if "ring" in mesh.columns else rectangle_ring(mesh)
    pairs = box_pairs(ring_edges(shaped), line_segments(line))
    e, s = F.col("l"), F.col("r")
    rx, ry = s["qx"] - s["px"], s["qy"] - s["py"]
    ux, uy = e["qx"] - e["px"], e["qy"] - e["py"]
    cross = rx * uy - ry * ux
    dx, dy = e["px"] - s["px"], e["py"] - s["py"]
    along = F.try_divide(dx * uy - dy * ux, cross)
    on_edge = F.try_divide(dx * ry - dy * rx, cross)
    hits = pairs.select(
        e["cell_id"].alias("cell_id"), along.alias("_a"), on_edge.alias("_b"), s["start"].alias("_start"), s["length"].alias("_len")
    ).where(F.col("_a").between(0, 1) & F.col("_b").between(0, 1))
    stations = hits.select("cell_id", (F.col("_start") + F.col("_a") * F.col("_len")).alias("station"))
    distinct = stations.groupBy("cell_id", F.round("station", 9)).agg(F.min("station").alias("station"))
    return distinct.groupBy("cell_id").agg(F.avg("station").alias("station"))


# --- cells along a line ---------------------------------------------------------------------------


def _passed_bins(size: float) -> Column:
    """Bins of a grid that a segment ``px, py, qx, qy`` passes, column by column, those it only touches included."""
    first, last = F.floor(F.least("px", "qx") / size), F.floor(F.greatest("px", "qx") / size)
    run = F.nullif(F.col("qx") - F.col("px"), F.lit(0.0))

    def span(bx: Column) -> Column:
        def y_at(x: Column) -> Column:
            inside = F.greatest(F.least("px", "qx"), F.least(F.greatest("px", "qx"), x))
            return F.coalesce(F.col("py") + (F.col("qy") - F.col("py")) * (inside - F.col("px")) / run, F.col("py"))

        one, two = y_at(bx * size), y_at((bx + 1) * size)
        lo = F.when(run.isNull(), F.least("py", "qy")).otherwise(F.least(one, two))
        hi = F.when(run.isNull(), F.greatest("py", "qy")).otherwise(F.greatest(one, two))
        # A little more on both sides, so that rounding loses no bin.
        slack = F.lit(size * 1e-9)
        return F.transform(F.sequence(F.floor((lo - slack) / size), F.floor((hi + slack) / size)), lambda by: F.struct(bx.alias("_bx"), by.alias("_by")))

    return F.flatten(F.transform(F.sequence(first, last), span))


def line_cells(mesh: DataFrame, line: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of ``mesh`` that share any point with a polyline (``ord, x, y``, ``ord`` dense from 0).

    Segments are filed in the grid bins they pass and not in all that their box
    covers, cells in those of their box; what meets in a bin is tested exactly.
    A segment is split first where it would pass very many bins.
    """
    size = mesh.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    if not size:
        size = 1.0
    size = 2.0 ** math.ceil(math.log2(size))
    segments = line_segments(line).select("px", "py", "qx", "qy")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("qx") - F.col("px")), F.abs(F.col("qy") - F.col("py"))) / (size * 256))).cast("int")
    part = F.explode(F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.struct((k / steps).alias("a"), ((k + 1) / steps).alias("b"))))
    cut = segments.select("px", "py", "qx", "qy", part.alias("s"))

    def between(share: Column, c: str) -> Column:
        return F.when(share == 1, F.col(f"q{c}")).otherwise(F.col(f"p{c}") + (F.col(f"q{c}") - F.col(f"p{c}")) * share)

    cut = cut.select(*[between(F.col(f"s.{e}"), c).alias(n + c) for n, e in (("p", "a"), ("q", "b")) for c in "xy"])
    # The bins follow the parts; the exact test takes a part's own ends.
    bins = cut.select(F.struct("px", "py", "qx", "qy").alias("seg"), F.inline(_passed_bins(size)))

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    shaped = with_parts(mesh).select(key, "_parts", _boxes(mesh).alias("box"), *BOX)
    filed = shaped.select(key, "_parts", "box", F.explode(span("x0", "x1")).alias("_bx"), *BOX).select(key, "_parts", "box", "_bx", F.explode(span("y0", "y1")).alias("_by"))
    # As in ``box_pairs``, filed rows are never broadcast.
    met = filed.join(bins.hint("merge"), ["_bx", "_by"])
    s, box = F.col("seg"), F.col("box")
    near = (F.least(s["px"], s["qx"]) <= box["x1"]) & (F.greatest(s["px"], s["qx"]) >= box["x0"]) & (F.least(s["py"], s["qy"]) <= box["y1"]) & (F.greatest(s["py"], s["qy"]) >= box["y0"])
    thread = F.array(F.array(F.struct(s["px"].alias("x"), s["py"].alias("y")), F.struct(s["qx"].alias("x"), s["qy"].alias("y")))).cast(polygons.PARTS)
    hits = met.where(near).where(polygons.touch(F.col("_parts"), thread)).select(key).distinct()
    return mesh.join(hits, key, "left_semi")
