"""Operators over ordered steps, events and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import diagnostics, windows
from freshet.operators.stats import centreline_fraction
from freshet.operators.spatial import cell_stations
from workload.q_joins import STATIONS
from workload.q_metrics import FRACTION
from workload.registry import query, rnd
from workload.views import run_sql, view

SERIES = """SELECT run, concat('hf_',CAST(cell_id AS STRING)) AS series, t, hf AS value FROM cells
    UNION ALL SELECT run, concat('lf_',CAST(cell_id AS STRING)), t, CASE WHEN run='click' AND t>=110 AND cell_id=1 THEN CAST('NaN' AS DOUBLE) ELSE lf END FROM cells"""
TRIMMED = f"""SELECT s.* FROM ({SERIES}) s JOIN (SELECT run, min(CASE WHEN isnan(value) THEN t END) AS z FROM ({SERIES}) q GROUP BY run) e ON e.run=s.run
    WHERE e.z IS NULL OR s.t<e.z"""
DELTAS = f"""SELECT run, series, t, d, sum(d) OVER (PARTITION BY run, series) AS total FROM
    (SELECT run, series, t, abs(lead(value) OVER (PARTITION BY run, series ORDER BY t)-value) AS d FROM ({TRIMMED}) x) y WHERE d IS NOT NULL"""
CHANGE = f"SELECT run, series, t, CASE WHEN total=0 THEN 0.0E0 ELSE d/total END AS change FROM ({DELTAS}) z"
CUMULATIVE = f"""SELECT run, t, sum(c) OVER (PARTITION BY run ORDER BY t)/nullif(sum(c) OVER (PARTITION BY run),0) AS cum
    FROM (SELECT run, t, sum(change) AS c FROM ({CHANGE}) a GROUP BY run, t) b"""
CUTOFFS = f"""SELECT run, CAST(coalesce(min(CASE WHEN cum>0.001E0 THEN t END),0) AS INT) AS start,
    CAST(coalesce(min(CASE WHEN cum>0.95E0 THEN t END),0) AS INT) AS stop FROM ({CUMULATIVE}) c GROUP BY run"""


def hf_lf(spark, sf):
    c = view(spark, sf, "cells")
    nan = (F.col("run") == "click") & (F.col("t") >= 110) & (F.col("cell_id") == 1)
    return (
        c.select("run", "t", "cell_id", F.col("hf").alias("value")),
        c.select("run", "t", "cell_id", F.when(nan, F.lit(float("nan"))).otherwise(F.col("lf")).alias("value")),
    )


@query("step_change", f"SELECT run, series, t, round(change,6) AS change FROM ({CHANGE}) q")
def _step_change(spark, sf):
    return rnd(windows.step_change(windows.trim_at_nan(windows.all_series(*hf_lf(spark, sf)))))


@query("cutoffs", CUTOFFS)
def _cutoffs(spark, sf):
    return windows.cutoffs(*hf_lf(spark, sf))


@query(
    "clip",
    f"SELECT c.run, CAST(c.t-k.start AS INT) AS t, c.cell_id, round(c.hf,6) AS value FROM cells c JOIN ({CUTOFFS}) k ON k.run=c.run WHERE c.t>=k.start AND c.t<k.stop",
)
def _clip(spark, sf):
    hf, lf = hf_lf(spark, sf)
    return rnd(windows.clip(hf, windows.cutoffs(hf, lf)))


@query(
    "event_hour",
    "SELECT event_id, datetime, round(inflow,6) AS inflow, CAST(row_number() OVER (PARTITION BY event_id ORDER BY datetime)-1 AS INT) AS hour FROM storm_ts",
)
def _hour(spark, sf):
    return rnd(windows.event_hour(view(spark, sf, "storm_ts").select("event_id", "datetime", "inflow")))


@query(
    "peak_step",
    "SELECT run, cell_id, t AS peak_t FROM (SELECT run, cell_id, t, row_number() OVER (PARTITION BY run, cell_id ORDER BY hf DESC, t) AS rn FROM cells) q WHERE rn=1",
)
def _peak_step(spark, sf):
    return windows.peak_step(view(spark, sf, "cells"), "hf")


BLOCKS = """SELECT CAST(floor((rn-1)/10.0) AS INT) AS block, max(precip_cum) AS precip_cum, max(inflow) AS inflow
    FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM maxima) m GROUP BY 1"""
CURVE = f"""SELECT value, max(rp) AS rp FROM (SELECT precip_cum AS value, (count(*) OVER ()+1.0E0)/row_number() OVER (ORDER BY precip_cum DESC) AS rp
    FROM ({BLOCKS}) b) q GROUP BY value"""


def interpolated(curve, x):
    return f"""SELECT m.event_id, s.y0+(s.y1-s.y0)/(s.x1-s.x0)*(m.{x}-s.x0) AS rp FROM maxima m JOIN
      (SELECT CASE WHEN rn=1 THEN -1.0E300 ELSE x0 END AS lo, CASE WHEN rn=total-1 THEN 1.0E300 ELSE x1 END AS hi, x0, y0, x1, y1 FROM
        (SELECT value AS x0, rp AS y0, lead(value) OVER (ORDER BY value) AS x1, lead(rp) OVER (ORDER BY value) AS y1,
          row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS total FROM ({curve}) c) k WHERE x1 IS NOT NULL) s
      ON m.{x}>=s.lo AND m.{x}<s.hi"""


@query("block_maxima", f"SELECT block, round(precip_cum,6) AS precip_cum, round(inflow,6) AS inflow FROM ({BLOCKS}) b")
def _blocks(spark, sf):
    return rnd(windows.block_maxima(view(spark, sf, "maxima"), 10))


@query("return_period_curve", f"SELECT round(value,6) AS value, round(rp,6) AS rp FROM ({CURVE}) c")
def _curve(spark, sf):
    return rnd(windows.return_period_curve(windows.block_maxima(view(spark, sf, "maxima"), 10), "precip_cum"))


@query("interp_linear", f"SELECT event_id, round(rp,6)+0.0E0 AS rp FROM ({interpolated(CURVE, 'precip_cum')}) q")
def _interp(spark, sf):
    maxima = view(spark, sf, "maxima")
    curve = windows.return_period_curve(windows.block_maxima(maxima, 10), "precip_cum")
    return rnd(windows.interp_linear(maxima, curve, "precip_cum", "rp").select("event_id", "rp"))


@query(
    "return_periods",
    f"""SELECT a.event_id, round(a.rp,6)+0.0E0 AS rp_precip, round(b.rp,6)+0.0E0 AS rp_inflow FROM ({interpolated(CURVE, 'precip_cum')}) a
       JOIN ({interpolated(CURVE.replace('precip_cum', 'inflow').replace('max(inflow) AS inflow, max(inflow) AS inflow', 'max(inflow) AS inflow'), 'inflow')}) b ON b.event_id=a.event_id""",
)
def _periods(spark, sf):
    return rnd(windows.return_periods(view(spark, sf, "maxima")).select("event_id", "rp_precip", "rp_inflow"))


RAIN = "SELECT run, t, avg(value) AS rain FROM forcing WHERE feature LIKE 'precip%' GROUP BY run, t"


def decayed(k, limit=""):
    return f"SELECT a.run, a.t, round(a.rain,6)+0.0E0 AS rain, round(sum(b.rain*pow({k},a.t-b.t)),6)+0.0E0 AS api FROM ({RAIN}) a JOIN ({RAIN}) b ON b.run=a.run AND b.t<=a.t {limit} GROUP BY a.run, a.t, a.rain"


@query("api", decayed("0.85E0"))
def _api(spark, sf):
    return rnd(windows.api(run_sql(spark, sf, RAIN), 0.85))


@query("api_chunked", decayed("0.85E0"))
def _api_chunked(spark, sf):
    return rnd(windows.api(run_sql(spark, sf, RAIN), 0.85, width=16))


@query("api_sum", decayed("1.0E0"))
def _api_sum(spark, sf):
    return rnd(windows.api(run_sql(spark, sf, RAIN), 1))


@query("api_window", decayed("0.85E0", "AND b.t>a.t-24"))
def _api_window(spark, sf):
    return rnd(windows.api(run_sql(spark, sf, RAIN), 0.85, window=24))


@query(
    "api_carry_over",
    f"""WITH p AS (SELECT run, t, rain, row_number() OVER (ORDER BY run, t) AS i FROM ({RAIN}) r)
       SELECT a.run, a.t, round(a.rain,6)+0.0E0 AS rain, round(sum(b.rain*pow(0.85E0,a.i-b.i)),6)+0.0E0 AS api FROM p a JOIN p b ON b.i<=a.i GROUP BY a.run, a.t, a.rain""",
)
def _api_stacked(spark, sf):
    return rnd(windows.api(run_sql(spark, sf, RAIN), 0.85, carry_over=True))


@query(
    "mode_series",
    """SELECT a.run, a.mode, a.t, round(a.z,6)+0.0E0 AS lf, round(a.z*2+1,6)+0.0E0 AS hf, round(a.z,6)+0.0E0 AS mean, round(a.z-1.959963984540054E0*sqrt(a.var),6)+0.0E0 AS low,
       round(a.z+1.959963984540054E0*sqrt(a.var),6)+0.0E0 AS high FROM scores a WHERE a.mode<2""",
)
def _mode_series(spark, sf):
    from freshet.functions.exprs import confidence_band

    lf = view(spark, sf, "scores")
    band = confidence_band(lf.withColumn("mean", F.col("z")))
    return rnd(windows.mode_series(lf, lf.withColumn("z", F.col("z") * 2 + 1), 2, band))


# --- diagnostics ----------------------------------------------------------------------------------


@query(
    "mode_pairs",
    "SELECT a.run, a.t, a.mode AS i, round(a.z,6)+0.0E0 AS lf, b.mode AS j, round(b.z*2,6)+0.0E0 AS hf FROM scores a JOIN scores b ON b.run=a.run AND b.t=a.t WHERE a.mode<2 AND b.mode<2",
)
def _mode_pairs(spark, sf):
    s = view(spark, sf, "scores")
    return rnd(diagnostics.mode_pairs(s, s.withColumn("z", F.col("z") * 2), 2))


@query(
    "mode_pair_limits",
    "SELECT mode, round(min(least(z,z*2)),6)+0.0E0 AS lo, round(max(greatest(z,z*2)),6)+0.0E0 AS hi FROM scores WHERE mode<2 GROUP BY mode",
)
def _mode_limits(spark, sf):
    s = view(spark, sf, "scores")
    return rnd(diagnostics.mode_pair_limits(s, s.withColumn("z", F.col("z") * 2), 2))


@query(
    "scatter_bins",
    """SELECT model, CAST(floor(est/0.7531E0) AS BIGINT) AS est_bin, CAST(floor(hf/0.7531E0) AS BIGINT) AS hf_bin, count(*) AS n, round(sum((est-hf)*(est-hf)),4) AS sse FROM
       (SELECT 'lf' AS model, lf AS est, hf FROM cells UNION ALL SELECT 'upskill', 0.7123457E0*lf+0.2876543E0*elevation, hf FROM cells) q GROUP BY 1,2,3""",
)
def _scatter(spark, sf):
    c, keys = view(spark, sf, "cells"), ["run", "t", "cell_id"]
    up = F.lit(0.7123457) * F.col("lf") + F.lit(0.2876543) * F.col("elevation")
    out = diagnostics.scatter_bins(
        c.select(*keys, F.col("lf").alias("value")), c.select(*keys, F.col("hf").alias("value")), c.select(*keys, up.alias("value")), 0.7531
    )
    return rnd(out, 4)


@query(
    "clipping_trace",
    f"""WITH z AS (SELECT * FROM ({CHANGE}) q), n AS (SELECT run, count(*) AS n FROM (SELECT run, series FROM z GROUP BY run, series HAVING max(change)>0) m GROUP BY run),
       s AS (SELECT run, t, sum(change) AS c FROM z GROUP BY run, t), k AS (SELECT * FROM ({CUTOFFS}) c)
       SELECT s.run, s.t, round(s.c/n.n,6) AS mean_change, round(sum(s.c) OVER (PARTITION BY s.run ORDER BY s.t)/n.n,6) AS mean_cumulative,
         CAST(k.start-floor((k.stop-k.start)/10.0) AS INT) AS zoom_from, CAST(k.stop+floor((k.stop-k.start)/10.0) AS INT) AS zoom_to
       FROM s JOIN n ON n.run=s.run JOIN k ON k.run=s.run""",
)
def _clipping(spark, sf):
    hf, lf = hf_lf(spark, sf)
    return rnd(diagnostics.clipping_trace(windows.all_series(hf, lf), windows.cutoffs(hf, lf)))


@query(
    "profile_by_station",
    f"SELECT s.cell_id, round(s.station,5) AS station, round(f.frac*100,5)+0.0E0 AS pct_drop FROM ({STATIONS}) s JOIN ({FRACTION}) f ON f.cell_id=s.cell_id",
)
def _profile(spark, sf):
    stations = cell_stations(view(spark, sf, "hf_mesh"), view(spark, sf, "river"))
    frac = centreline_fraction(view(spark, sf, "ref_lines"), view(spark, sf, "bank"), "us", "ds")
    return rnd(diagnostics.profile_by_station(stations, frac), 5)
