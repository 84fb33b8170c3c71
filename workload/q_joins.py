"""Joins, spatial joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import joins, sets, spatial
from freshet.session import cut_lineage
from workload.registry import query, rnd
from workload.views import run_sql, table, view


def side(spark, sf, name, cond):
    return view(spark, sf, "cells").where(cond).select("run", "t", "cell_id", F.col(name).alias("value"))


@query(
    "align",
    "SELECT run, t, cell_id, round(CASE WHEN t<100 THEN hf END,6) AS hf, round(CASE WHEN t>=20 THEN lf END,6) AS lf FROM cells",
)
def _align(spark, sf):
    return rnd(joins.align(side(spark, sf, "hf", F.col("t") < 100), side(spark, sf, "lf", F.col("t") >= 20)))


@query("pair", "SELECT run, t, cell_id, round(x,6) AS x, round(y,6) AS y, round(s,6) AS s FROM pairs")
def _pair(spark, sf):
    from workload.q_metrics import pairs

    return rnd(pairs(spark, sf))


@query(
    "resample_cells",
    "SELECT m.cell_id, c.run, c.t, round(c.lf,6) AS value FROM cells c JOIN (SELECT cell_id, CAST(floor(cell_id/3.0) AS INT) AS lf_cell_id FROM cell_info) m ON m.lf_cell_id=c.cell_id",
)
def _resample(spark, sf):
    mapping = view(spark, sf, "cell_info").select("cell_id", F.floor(F.col("cell_id") / 3).cast("int").alias("lf_cell_id"))
    return rnd(joins.resample_cells(side(spark, sf, "lf", F.lit(True)), mapping))


OVERLAPS = """
    SELECT h.cell_id, l.lf_cell_id, (least(h.x1,l.x1)-greatest(h.x0,l.x0))*(least(h.y1,l.y1)-greatest(h.y0,l.y0)) AS area
    FROM hf_mesh h JOIN lf_mesh l ON h.x0<l.x1 AND l.x0<h.x1 AND h.y0<l.y1 AND l.y0<h.y1"""
LARGEST = f"""
    SELECT cell_id, lf_cell_id, area FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY area DESC, lf_cell_id) AS rn FROM ({OVERLAPS}) o) q WHERE rn=1"""


@query("largest_overlap", f"SELECT cell_id, lf_cell_id, round(area,6) AS area FROM ({LARGEST}) q")
def _largest(spark, sf):
    return rnd(spatial.largest_overlap(view(spark, sf, "hf_mesh"), view(spark, sf, "lf_mesh"), require_all=False))


@query("largest_overlap_rings", f"SELECT cell_id, lf_cell_id, round(area,6) AS area FROM ({LARGEST}) q")
def _largest_rings(spark, sf):
    hf, lf = (spatial.rectangle_ring(view(spark, sf, n)) for n in ("hf_mesh", "lf_mesh"))
    return rnd(spatial.largest_overlap(hf, lf, require_all=False))


AOI = [(10.5, 1.25), (40.5, 1.25), (40.5, 1000000.0), (10.5, 1000000.0)]


@query("within_aoi", "SELECT cell_id, x0, y0 FROM hf_mesh WHERE x0<=40.5 AND x1>=10.5 AND y1>=1.25")
def _aoi(spark, sf):
    return spatial.within_aoi(view(spark, sf, "hf_mesh"), AOI).select("cell_id", "x0", "y0")


@query("within_aoi_rings", "SELECT cell_id, x0, y0 FROM hf_mesh WHERE x0<=40.5 AND x1>=10.5 AND y1>=1.25")
def _aoi_rings(spark, sf):
    return spatial.within_aoi(spatial.rectangle_ring(view(spark, sf, "hf_mesh")), AOI).select("cell_id", "x0", "y0")


NEAREST = """
    SELECT cell_id, near_id, dist FROM (SELECT h.cell_id, c.near_id, d.dist, row_number() OVER (PARTITION BY h.cell_id ORDER BY d.dist, c.near_id) AS rn
      FROM hf_mesh h JOIN centreline c ON true
      JOIN LATERAL (SELECT sqrt(pow(greatest(0.0E0,h.x0-c.x1,c.x0-h.x1),2)+pow(greatest(0.0E0,h.y0-c.y1,c.y0-h.y1),2)) AS dist) d ON true) q WHERE rn=1"""


@query("nearest", f"SELECT cell_id, near_id, round(dist,6) AS dist FROM ({NEAREST}) q")
def _nearest(spark, sf):
    return rnd(spatial.nearest(view(spark, sf, "hf_mesh"), view(spark, sf, "centreline")))


# --- concave shapes: a cell without its upper right quarter, and one with a notch from above and a hole ---

ELLS = """SELECT cell_id, x0, y0, x1, y1, array(named_struct('x',x0,'y',y0), named_struct('x',x1,'y',y0), named_struct('x',x1,'y',y0+0.5E0),
    named_struct('x',x0+0.5E0,'y',y0+0.5E0), named_struct('x',x0+0.5E0,'y',y1), named_struct('x',x0,'y',y1)) AS ring FROM hf_mesh"""


def notched(spark, sf):
    c = view(spark, sf, "centreline")
    x, y = F.col("x0"), F.col("y0")

    def ring(*points):
        return F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in points])

    outer = ring((0, 0), (1, 0), (1, 1), (0.75, 1), (0.75, 0.5), (0.25, 0.5), (0.25, 1), (0, 1))
    return c.withColumns({"ring": outer, "holes": F.array(ring((0.3, 0.1), (0.7, 0.1), (0.7, 0.4), (0.3, 0.4)))})


def _strokes(points) -> str:
    """Edges of a shape as boxes without width: all run along an axis."""
    out = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        out.append(f"({min(ax, bx)}E0,{min(ay, by)}E0,{max(ax, bx)}E0,{max(ay, by)}E0)")
    return ", ".join(out)


ELL_EDGES = _strokes([(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)])
NOTCH_EDGES = ", ".join([
    _strokes([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.75, 1.0), (0.75, 0.5), (0.25, 0.5), (0.25, 1.0), (0.0, 1.0)]),
    _strokes([(0.3, 0.1), (0.7, 0.1), (0.7, 0.4), (0.3, 0.4)]),
])


@query(
    "nearest_rings",
    f"""WITH e AS (SELECT h.cell_id, h.x0+a AS x0, h.y0+b AS y0, h.x0+c AS x1, h.y0+d AS y1 FROM hf_mesh h JOIN (VALUES {ELL_EDGES}) v(a,b,c,d) ON true),
       f AS (SELECT k.near_id, k.x0+a AS x0, k.y0+b AS y0, k.x0+c AS x1, k.y0+d AS y1 FROM centreline k JOIN (VALUES {NOTCH_EDGES}) v(a,b,c,d) ON true),
       p AS (SELECT e.cell_id, f.near_id, min(sqrt(pow(greatest(0.0E0,e.x0-f.x1,f.x0-e.x1),2)+pow(greatest(0.0E0,e.y0-f.y1,f.y0-e.y1),2))) AS dist
         FROM e JOIN f ON abs(e.y0-f.y0)<60 GROUP BY e.cell_id, f.near_id)
       SELECT cell_id, near_id, round(dist,6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(dist,9), near_id) AS rn FROM p) q WHERE rn=1""",
)
def _nearest_rings(spark, sf):
    return rnd(spatial.nearest(run_sql(spark, sf, ELLS), notched(spark, sf)))


@query(
    "overlap_concave",
    """SELECT cell_id, lf_cell_id, round(area,6) AS area FROM (
         SELECT h.cell_id, l.lf_cell_id,
           greatest(0.0E0, least(h.x1,l.x1)-greatest(h.x0,l.x0))*greatest(0.0E0, least(h.y1,l.y1)-greatest(h.y0,l.y0))
           -greatest(0.0E0, least(h.x1,l.x1)-greatest(h.x0+0.5E0,l.x0))*greatest(0.0E0, least(h.y1,l.y1)-greatest(h.y0+0.5E0,l.y0)) AS area
         FROM hf_mesh h JOIN lf_mesh l ON h.x0<l.x1 AND l.x0<h.x1 AND h.y0<l.y1 AND l.y0<h.y1) q WHERE area>1.0E-9""",
)
def _overlap_concave(spark, sf):
    return rnd(spatial.overlap_areas(run_sql(spark, sf, ELLS), view(spark, sf, "lf_mesh")))


@query(
    "centreline_cells",
    """WITH s AS (SELECT * FROM (SELECT x AS px, y AS py, lead(x) OVER (ORDER BY ord) AS qx, lead(y) OVER (ORDER BY ord) AS qy FROM river) l WHERE qx IS NOT NULL),
       c AS (SELECT h.cell_id, h.x0, h.y0,
           greatest(0.0E0, least((h.x0-px)/(qx-px), (h.x1-px)/(qx-px)), least((h.y0-py)/(qy-py), (h.y1-py)/(qy-py))) AS a,
           least(1.0E0, greatest((h.x0-px)/(qx-px), (h.x1-px)/(qx-px)), greatest((h.y0-py)/(qy-py), (h.y1-py)/(qy-py))) AS b
         FROM hf_mesh h JOIN s ON h.x0<=greatest(px,qx) AND h.x1>=least(px,qx) AND h.y0<=greatest(py,qy) AND h.y1>=least(py,qy))
       SELECT DISTINCT cell_id, x0, y0 FROM c WHERE a<=b""",
)
def _centreline_cells(spark, sf):
    return spatial.line_cells(view(spark, sf, "hf_mesh"), view(spark, sf, "river")).select("cell_id", "x0", "y0")


SPEC = {"left": -3.0, "top": 1000.0, "cell": 1.75, "nrows": 600, "ncols": 40}
SHAPES = "SELECT cell_id, x0+0.2E0 AS x0, y0+0.1E0 AS y0, x1+0.3E0 AS x1, y1+0.15E0 AS y1 FROM hf_mesh WHERE cell_id%4<>0"


@query(
    "rasterize",
    f"""SELECT DISTINCT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT unnest(range(
         CAST(floor((1000-y1)/1.75E0) AS INT), CAST(ceil((1000-y0)/1.75E0) AS INT))) AS r, c FROM
         (SELECT y0, y1, unnest(range(CAST(floor((x0+3)/1.75E0) AS INT), CAST(ceil((x1+3)/1.75E0) AS INT))) AS c FROM ({SHAPES}) s) q) p
       WHERE r BETWEEN 0 AND 599 AND c BETWEEN 0 AND 39""",
)
def _rasterize(spark, sf):
    return spatial.rasterize(run_sql(spark, sf, SHAPES), SPEC)


@query(
    "rasterize_rings",
    """SELECT DISTINCT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT unnest(range(
         CAST(floor((1000-y1)/0.35E0) AS INT), CAST(ceil((1000-y0)/0.35E0) AS INT))) AS r, c FROM
         (SELECT y0, y1, unnest(range(CAST(floor((x0+3)/0.35E0) AS INT), CAST(ceil((x1+3)/0.35E0) AS INT))) AS c FROM
           (SELECT x0+0.02E0 AS x0, y0+0.01E0 AS y0, x1+0.02E0 AS x1, y0+0.51E0 AS y1 FROM hf_mesh WHERE cell_id%3=0
            UNION ALL SELECT x0+0.02E0, y0+0.01E0, x0+0.52E0, y1+0.01E0 FROM hf_mesh WHERE cell_id%3=0) s) q) p
       WHERE r BETWEEN 0 AND 2999 AND c BETWEEN 0 AND 199""",
)
def _rasterize_rings(spark, sf):
    moved = "transform(ring, p -> named_struct('x', p.x+0.02E0, 'y', p.y+0.01E0)) AS ring"
    shapes = run_sql(spark, sf, f"SELECT {moved} FROM ({ELLS}) e WHERE cell_id%3=0")
    return spatial.rasterize(shapes, {"left": -3.0, "top": 1000.0, "cell": 0.35, "nrows": 3000, "ncols": 200})


POINTS = "SELECT cell_id, x0+0.51E0 AS x, y0+0.47E0 AS y, elevation/3 AS elevation FROM hf_mesh"
WEIGHTS = f"""
    SELECT cell_id, tri_id, a_id, b_id, c_id, wa, wb, 1-wa-wb AS wc FROM (
      SELECT p.cell_id, t.tri_id, t.a_id, t.b_id, t.c_id,
        ((t.by-t.cy)*(p.x-t.cx)+(t.cx-t.bx)*(p.y-t.cy))/((t.by-t.cy)*(t.ax-t.cx)+(t.cx-t.bx)*(t.ay-t.cy)) AS wa,
        ((t.cy-t.ay)*(p.x-t.cx)+(t.ax-t.cx)*(p.y-t.cy))/((t.by-t.cy)*(t.ax-t.cx)+(t.cx-t.bx)*(t.ay-t.cy)) AS wb
      FROM ({POINTS}) p JOIN triangles t ON p.x BETWEEN least(t.ax,t.bx,t.cx) AND greatest(t.ax,t.bx,t.cx)
        AND p.y BETWEEN least(t.ay,t.by,t.cy) AND greatest(t.ay,t.by,t.cy)) q
    WHERE wa>=-1.0E-9 AND wb>=-1.0E-9 AND 1-wa-wb>=-1.0E-9"""
FIRST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY tri_id) AS rn FROM ({WEIGHTS}) w) f WHERE rn=1"
LONG = f"""SELECT cell_id, a_id AS lf_cell_id, wa AS w FROM ({FIRST}) a UNION ALL SELECT cell_id, b_id, wb FROM ({FIRST}) b
    UNION ALL SELECT cell_id, c_id, wc FROM ({FIRST}) c"""


@query("triangle_weights", f"SELECT cell_id, lf_cell_id, round(w,6)+0.0E0 AS w FROM ({LONG}) l")
def _weights(spark, sf):
    return rnd(spatial.triangle_weights(view(spark, sf, "triangles"), run_sql(spark, sf, POINTS)))


@query(
    "interpolate_surface",
    f"""WITH s AS (SELECT v.run, v.t, l.cell_id, CASE WHEN count(v.value)=3 THEN sum(l.w*v.value) END AS z FROM ({LONG}) l JOIN lf_levels v ON v.cell_id=l.lf_cell_id GROUP BY 1,2,3)
       SELECT s.run, s.t, s.cell_id, round(greatest(coalesce(s.z,p.elevation),p.elevation),6) AS value FROM s JOIN ({POINTS}) p ON p.cell_id=s.cell_id
       UNION ALL SELECT g.run, g.t, p.cell_id, round(p.elevation,6) FROM ({POINTS}) p JOIN (SELECT DISTINCT run, t FROM lf_levels) g ON true
       WHERE p.cell_id NOT IN (SELECT cell_id FROM ({LONG}) l)""",
)
def _interpolate(spark, sf):
    points = run_sql(spark, sf, POINTS)
    # Weights do not depend on time: they are made once and kept.
    weights = cut_lineage(spatial.triangle_weights(view(spark, sf, "triangles"), points))
    return rnd(spatial.interpolate_surface(view(spark, sf, "lf_levels"), weights, points.select("cell_id", "elevation")))


@query(
    "link_boundaries",
    """WITH w AS (SELECT id, CASE WHEN trim(bc_line_id)<>'' THEN regexp_replace(regexp_replace(trim(bc_line_id),'^bc_',''),'_base$','') ELSE area_id END AS element,
         CASE WHEN trim(bc_line_id)<>'' THEN 'FLOW-BASE' ELSE 'FLOW' END AS param FROM boundaries WHERE trim(bc_line_id)<>'' OR area_id<>''),
       f AS (SELECT * FROM (SELECT event_id, element, param, path, row_number() OVER (PARTITION BY event_id, element, param ORDER BY ord, path) AS rn
         FROM records WHERE event_id%50=7) q WHERE rn=1)
       SELECT f.event_id, w.id, w.element, w.param, f.path FROM w JOIN f ON f.element=w.element AND f.param=w.param""".replace(" WHERE event_id%50=7", ""),
)
def _link(spark, sf):
    return joins.link_boundaries(view(spark, sf, "boundaries"), view(spark, sf, "records"))


@query(
    "metric_map",
    """WITH m AS (SELECT k.event, k.cell_id, CASE WHEN k.cell_id%13=0 THEN 0.0E0 ELSE k.rmse_cell_toi END AS error_value
         FROM cell_metrics k JOIN hf_mesh h ON h.cell_id=k.cell_id)
       SELECT m.event, m.cell_id, h.x0, h.y0, m.error_value, v.vmin, v.vmax FROM m JOIN hf_mesh h ON h.cell_id=m.cell_id
       JOIN (SELECT min(error_value) AS vmin, max(error_value) AS vmax FROM m) v ON true""",
)
def _metric_map(spark, sf):
    m = view(spark, sf, "cell_metrics").withColumn(
        "rmse_cell_toi", F.when(F.col("cell_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("rmse_cell_toi"))
    )
    mesh = view(spark, sf, "hf_mesh").select("cell_id", "x0", "y0")
    return joins.metric_map(mesh, m, "rmse_cell_toi")


@query(
    "metric_map_filled",
    """SELECT e.event, h.cell_id, h.x0, coalesce(k.rmse_cell_toi, 0.0E0) AS error_value, v.vmin, v.vmax
       FROM hf_mesh h JOIN (SELECT DISTINCT event FROM cell_metrics) e ON true LEFT JOIN cell_metrics k ON k.event=e.event AND k.cell_id=h.cell_id
       JOIN (SELECT min(rmse_cell_toi) AS vmin, max(rmse_cell_toi) AS vmax FROM cell_metrics) v ON true""",
)
def _metric_map_filled(spark, sf):
    mesh = view(spark, sf, "hf_mesh").select("cell_id", "x0")
    return joins.metric_map(mesh, view(spark, sf, "cell_metrics"), "rmse_cell_toi", fill_unmatched=True)


STATIONS = """
    WITH p AS (SELECT ord, x, y, lead(x) OVER (ORDER BY ord) AS nx, lead(y) OVER (ORDER BY ord) AS ny FROM river),
    s AS (SELECT x AS px, y AS py, nx-x AS rx, ny-y AS ry, sqrt(pow(nx-x,2)+pow(ny-y,2)) AS len,
      sum(sqrt(pow(nx-x,2)+pow(ny-y,2))) OVER (ORDER BY ord)-sqrt(pow(nx-x,2)+pow(ny-y,2)) AS start FROM p WHERE nx IS NOT NULL),
    e AS (SELECT cell_id, x0 AS px, y0 AS py, x1-x0 AS ux, 0.0E0 AS uy FROM hf_mesh UNION ALL SELECT cell_id, x1, y0, 0.0E0, y1-y0 FROM hf_mesh
      UNION ALL SELECT cell_id, x1, y1, x0-x1, 0.0E0 FROM hf_mesh UNION ALL SELECT cell_id, x0, y1, 0.0E0, y0-y1 FROM hf_mesh),
    h AS (SELECT e.cell_id, s.start, s.len, ((e.px-s.px)*e.uy-(e.py-s.py)*e.ux)/(s.rx*e.uy-s.ry*e.ux) AS a,
      ((e.px-s.px)*s.ry-(e.py-s.py)*s.rx)/(s.rx*e.uy-s.ry*e.ux) AS b
      FROM e JOIN s ON e.px<=greatest(s.px,s.px+s.rx) AND e.px+e.ux>=least(s.px,s.px+s.rx) - 1 AND e.py<=greatest(s.py,s.py+s.ry)+1 AND e.py+e.uy>=least(s.py,s.py+s.ry)-1
      WHERE s.rx*e.uy-s.ry*e.ux<>0)
    SELECT cell_id, avg(st) AS station FROM (SELECT DISTINCT cell_id, round(start+a*len,9) AS st FROM h WHERE a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1) d GROUP BY cell_id"""
STATIONS = STATIONS.replace("e.px<=greatest(s.px,s.px+s.rx) AND", "e.px<=greatest(s.px,s.px+s.rx)+1 AND")


@query("cell_stations", f"SELECT cell_id, round(station,5) AS station FROM ({STATIONS}) q")
def _stations(spark, sf):
    return rnd(spatial.cell_stations(view(spark, sf, "hf_mesh"), view(spark, sf, "river")), 5)


@query(
    "eof_map",
    """SELECT h.cell_id, h.x0, CAST(m.mode AS INT) AS mode, round(coalesce(e.loading,0.0E0),6)+0.0E0 AS loading, round(v.vmax,6) AS vmax
       FROM hf_mesh h JOIN (SELECT unnest([0,1]) AS mode) m ON true LEFT JOIN eof e ON e.mode=m.mode AND e.cell_id=h.cell_id
       JOIN (SELECT max(abs(loading)) AS vmax FROM eof WHERE mode<2) v ON true""",
)
def _eof_map(spark, sf):
    return rnd(joins.eof_map(view(spark, sf, "hf_mesh").select("cell_id", "x0"), view(spark, sf, "eof"), 2))


@query("exclude", "SELECT event_id, round(inflow,6) AS inflow FROM maxima WHERE event_id NOT IN (SELECT event_id FROM periods WHERE rp_precip>60)")
def _exclude(spark, sf):
    picked = view(spark, sf, "periods").where(F.col("rp_precip") > 60)
    return rnd(joins.exclude(view(spark, sf, "maxima"), picked).select("event_id", "inflow"))


@query("restrict", "SELECT event_id, round(inflow,6) AS inflow FROM maxima WHERE event_id IN (SELECT event_id FROM periods WHERE rp_precip>60)")
def _restrict(spark, sf):
    picked = view(spark, sf, "periods").where(F.col("rp_precip") > 60)
    return rnd(joins.restrict(view(spark, sf, "maxima"), picked).select("event_id", "inflow"))


@query(
    "cell_info",
    f"""SELECT h.cell_id, h.x0, h.y0, h.elevation, (h.x1-h.x0)*(h.y1-h.y0) AS area, m.lf_cell_id FROM hf_mesh h
       JOIN ({LARGEST}) m ON m.cell_id=h.cell_id WHERE h.x0<=40.5 AND h.x1>=10.5 AND h.y1>=1.25""",
)
def _cell_info(spark, sf):
    mesh = view(spark, sf, "hf_mesh")
    inside = spatial.within_aoi(mesh, AOI).select("cell_id", "x0", "y0")
    areas = mesh.select("cell_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    mapping = spatial.largest_overlap(mesh, view(spark, sf, "lf_mesh"), require_all=False)
    return joins.cell_info(inside, mesh, areas, mapping)


# --- top-k, set operations, samples ---------------------------------------------------------------


@query(
    "argmax_row",
    "SELECT event_id, round(precip_cum,6) AS precip_cum, round(inflow,6) AS inflow FROM maxima ORDER BY inflow DESC, event_id LIMIT 1",
)
def _argmax(spark, sf):
    return rnd(sets.argmax_row(view(spark, sf, "maxima"), "inflow").select("event_id", "precip_cum", "inflow"))


@query("take_modes", "SELECT run, t, mode, round(z,6)+0.0E0 AS z FROM scores WHERE mode<2")
def _take(spark, sf):
    return rnd(sets.take_modes(view(spark, sf, "scores"), 2).select("run", "t", "mode", "z"))


TARGETS = (10, 20, 30, 50)
SLOTS = ", ".join(f"({2 * i},{rp}.0E0,'rp_precip'),({2 * i + 1},{rp}.0E0,'rp_inflow')" for i, rp in enumerate(TARGETS))


@query(
    "rank_candidates",
    f"""SELECT slot, rp, field, event_id, round(log_dist,6) AS log_dist, CAST(rank AS INT) AS rank FROM
       (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY log_dist, event_id) AS rank FROM
        (SELECT s.slot, s.rp, s.field, p.event_id, sqrt(pow(log10(p.rp_precip/s.rp),2)+pow(log10(p.rp_inflow/s.rp),2)) AS log_dist
         FROM periods p JOIN (SELECT * FROM (VALUES {SLOTS}) v(slot,rp,field)) s
         ON CASE WHEN s.field='rp_precip' THEN p.rp_precip ELSE p.rp_inflow END BETWEEN s.rp*0.8E0 AND s.rp*1.2E0) q) r WHERE rank<=10""",
)
def _rank(spark, sf):
    found = sets.rank_candidates(view(spark, sf, "periods"), TARGETS, 0.2, top=10)
    return rnd(found.select("slot", "rp", "field", "event_id", "log_dist", "rank"))


@query("ordered", "SELECT event_id, datetime, round(inflow,6) AS inflow FROM storm_ts")
def _ordered(spark, sf):
    return rnd(sets.ordered(view(spark, sf, "storm_ts").select("event_id", "datetime", "inflow")))


STEPS = """SELECT CAST(run AS INT) AS event_id, t, value AS v, CAST('2024-03-01 00:00:00' AS TIMESTAMP_NTZ) AS start_time
    FROM (SELECT pos*4+t%4 AS run, CAST(floor(t/4.0) AS INT) AS t, v AS value FROM grid) g"""


@query(
    "tail_steps",
    """WITH g AS (SELECT CAST(pos*4+t%4 AS INT) AS event_id, CAST(floor(t/4.0) AS INT) AS t, v FROM grid),
       e AS (SELECT event_id, greatest(max(t)-71, 0) AS lo FROM g GROUP BY event_id)
       SELECT g.event_id, g.t, round(g.v,6)+0.0E0 AS v, CAST(g.t-e.lo AS INT) AS step, TIMESTAMP '2024-03-01 00:00:00'+to_hours(g.t-e.lo) AS stamp
       FROM g JOIN e ON e.event_id=g.event_id WHERE g.t>=e.lo""",
)
def _tail(spark, sf):
    return rnd(sets.tail_steps(run_sql(spark, sf, STEPS), 72).select("event_id", "t", "v", "step", "stamp"))


@query("union_runs", "SELECT run, t, cell_id, round(hf,6) AS value FROM cells")
def _union(spark, sf):
    return rnd(sets.union_runs(side(spark, sf, "hf", F.col("t") < 40), side(spark, sf, "hf", F.col("t") >= 40)))


@query(
    "union_ids",
    "SELECT event_id FROM periods WHERE rp_precip>50 UNION SELECT event_id FROM periods WHERE rp_inflow>50",
)
def _union_ids(spark, sf):
    p = view(spark, sf, "periods")
    return sets.union_ids(p.where(F.col("rp_precip") > 50), p.where(F.col("rp_inflow") > 50))


@query("minus", "SELECT event_id FROM periods EXCEPT SELECT event_id FROM periods WHERE rp_inflow>50")
def _minus(spark, sf):
    p = view(spark, sf, "periods")
    return sets.minus(p, p.where(F.col("rp_inflow") > 50)).select("event_id")


EDGES = sets.log_edges(5, 400, 7)
BINS = ", ".join(f"({i},{a!r}::DOUBLE,{b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
SAMPLE = f"""SELECT bin, event_id FROM (SELECT b.bin, p.event_id, row_number() OVER (PARTITION BY b.bin ORDER BY md5(concat('42:', p.event_id)), p.event_id) AS rn
    FROM periods p JOIN (SELECT * FROM (VALUES {BINS}) v(bin,a,b)) b ON p.rp_precip BETWEEN b.a AND b.b) q WHERE rn=1"""


@query("sample_log_bins", SAMPLE)
def _sample(spark, sf):
    return sets.sample_log_bins(view(spark, sf, "periods"), "rp_precip", 5, 400, 7)


@query(
    "fill_sample",
    f"""SELECT p.event_id FROM periods p WHERE p.event_id NOT IN (SELECT event_id FROM ({SAMPLE}) s)
       ORDER BY md5(concat('42:', p.event_id)), p.event_id LIMIT (14-(SELECT count(*) FROM ({SAMPLE}) s))""",
)
def _fill(spark, sf):
    p = view(spark, sf, "periods")
    return sets.fill_sample(p, sets.sample_log_bins(p, "rp_precip", 5, 400, 7), 14).select("event_id")
