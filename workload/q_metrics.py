"""Metrics and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.exprs import depth
from freshet.operators import metrics, stats
from workload.registry import query, rnd
from workload.views import run_sql, view

THRESHOLD = 12.0
T_TOL, V_TOL = 2, 0.7531


def truth_pred_conf(spark, sf):
    """Truth, prediction and spread tables of depths."""
    keys = ["run", "t", "cell_id"]
    cells = view(spark, sf, "cells")
    spread = F.lit(0.1) + F.lit(0.0513717) * F.abs(F.col("lf") - F.col("elevation"))
    return (
        cells.select(*keys, depth("hf", "elevation").alias("value")),
        cells.select(*keys, depth("lf", "elevation").alias("value")),
        cells.select(*keys, spread.alias("value")),
    )


def pairs(spark, sf):
    return metrics.pair(*truth_pred_conf(spark, sf))


PLAIN = {
    "rmse_aoi_toi": ("run", "sqrt(avg((x-y)*(x-y)))"),
    "mae_aoi_toi": ("run", "avg(abs(x-y))"),
    "conf_aoi_toi": ("run", "avg(s)"),
    "err_aoi_toi": ("run", "avg(x-y)"),
    "rmse_aoi_ts": ("run, t", "sqrt(avg((x-y)*(x-y)))"),
    "err_aoi_ts": ("run, t", "avg(x-y)"),
    "conf_aoi_ts": ("run, t", "avg(s)"),
    "rmse_cell_toi": ("run, cell_id", "sqrt(avg((x-y)*(x-y)))"),
    "err_cell_mts": ("run, cell_id", "max(x)-max(y)"),
    "err_cell_toi": ("run, cell_id", "avg(x-y)"),
    "conf_cell_toi": ("run, cell_id", "avg(s)"),
}
for _name, (_by, _expr) in PLAIN.items():

    def _plain(spark, sf, name=_name):
        return rnd(getattr(metrics, name)(pairs(spark, sf)))

    query(_name, f"SELECT {_by}, round({_expr},6)+0.0E0 AS {_name} FROM pairs GROUP BY {_by}")(_plain)

A = f"count(*) FILTER (WHERE px>={THRESHOLD} AND py>={THRESHOLD})"
B = f"count(*) FILTER (WHERE px<{THRESHOLD} AND py>={THRESHOLD})"
C = f"count(*) FILTER (WHERE px>={THRESHOLD} AND py<{THRESHOLD})"
PEAK = {
    "rmse_aoi_mts": "sqrt(avg((px-py)*(px-py)))",
    "err_aoi_mts": "avg(px-py)",
    "nse_aoi_mts": "1-sum((px-py)*(px-py))/nullif(var_pop(px)*count(*),0)",
    "pod_mts": f"{A}*1.0E0/nullif({A}+{C},0)",
    "rfa_mts": f"{B}*1.0E0/nullif({A}+{B},0)",
    "csi_mts": f"{A}*1.0E0/nullif({A}+{B}+{C},0)",
    "f2_mts": f"coalesce(({A}-{C})*1.0E0/nullif({A}+{B}+{C},0),1.0E0)",
    "f3_mts": f"coalesce(({A}-{B})*1.0E0/nullif({A}+{B}+{C},0),1.0E0)",
}
for _name, _expr in PEAK.items():

    def _peak(spark, sf, name=_name):
        return rnd(getattr(metrics, name)(pairs(spark, sf), threshold=THRESHOLD))

    query(_name, f"SELECT run, round({_expr},6)+0.0E0 AS {_name} FROM peaks GROUP BY run")(_peak)

MATCHED = f"""
    SELECT p.run, p.t, p.cell_id, p.x, p.y, p.s,
      CASE WHEN abs(p.x-p.y)<={V_TOL} OR coalesce(abs(p.y-a.x)<={V_TOL} OR abs(p.x-a.y)<={V_TOL}, false)
        OR coalesce(abs(p.y-b.x)<={V_TOL} OR abs(p.x-b.y)<={V_TOL}, false) THEN 1.0E0 ELSE 0.0E0 END AS m
    FROM pairs p LEFT JOIN pairs a ON a.run=p.run AND a.cell_id=p.cell_id AND a.t=p.t+1
      LEFT JOIN pairs b ON b.run=p.run AND b.cell_id=p.cell_id AND b.t=p.t+2"""


@query("fi_aoi_toi", f"SELECT run, round(avg(m),6) AS fi_aoi_toi FROM ({MATCHED}) q GROUP BY run")
def _fi(spark, sf):
    return rnd(metrics.fi_aoi_toi(pairs(spark, sf), t_tol=T_TOL, v_tol=V_TOL))


def suite(spark, sf, **options):
    """Scores with the spread carried by the prediction table, as experiments do."""
    options = {"threshold": THRESHOLD, "t_tol": T_TOL, "v_tol": V_TOL, "cache": False, **options}
    keys = ["run", "t", "cell_id"]
    cells = view(spark, sf, "cells")
    spread = F.lit(0.1) + F.lit(0.0513717) * F.abs(F.col("lf") - F.col("elevation"))
    truth = cells.select(*keys, depth("hf", "elevation").alias("value"))
    pred = cells.select(*keys, depth("lf", "elevation").alias("value"), spread.alias("sd"))
    return metrics.metric_suite(truth, pred, None, **options)


@query(
    "metric_suite_scalar",
    "SELECT a.*, " + ", ".join(f"p.{n}" for n in PEAK) + f""" FROM
      (SELECT run AS event, round(sqrt(avg((x-y)*(x-y))),6) AS rmse_aoi_toi, round(avg(abs(x-y)),6) AS mae_aoi_toi,
         round(avg(s),6) AS conf_aoi_toi, round(avg(x-y),6)+0.0E0 AS err_aoi_toi, round(avg(m),6) AS fi_aoi_toi
       FROM ({MATCHED}) q GROUP BY run) a
      JOIN (SELECT run, """ + ", ".join(f"round({e},6)+0.0E0 AS {n}" for n, e in PEAK.items()) + " FROM peaks GROUP BY run) p ON p.run=a.event",
)
def _suite_scalar(spark, sf):
    return rnd(suite(spark, sf).scalar)


@query(
    "metric_suite_timeseries",
    """SELECT run AS event, t AS timestep, round(sqrt(avg((x-y)*(x-y))),6) AS rmse_aoi_ts, round(avg(x-y),6)+0.0E0 AS err_aoi_ts,
       round(avg(s),6) AS conf_aoi_ts FROM pairs GROUP BY run, t""",
)
def _suite_ts(spark, sf):
    return rnd(suite(spark, sf).timeseries)


@query(
    "metric_suite_cell",
    """SELECT run AS event, cell_id, round(sqrt(avg((x-y)*(x-y))),6) AS rmse_cell_toi, round(max(x)-max(y),6)+0.0E0 AS err_cell_mts,
       round(avg(x-y),6)+0.0E0 AS err_cell_toi, round(avg(s),6) AS conf_cell_toi FROM pairs GROUP BY run, cell_id""",
)
def _suite_cell(spark, sf):
    return rnd(suite(spark, sf).cell)


@query(
    "metric_suite_velocity",
    "SELECT run AS event, CAST(NULL AS DOUBLE) AS pod_mts, CAST(NULL AS DOUBLE) AS csi_mts, round(" + PEAK["f2_mts"] + ",6)+0.0E0 AS f2_mts FROM peaks GROUP BY run",
)
def _suite_velocity(spark, sf):
    return rnd(suite(spark, sf, parameter="velocity").scalar.select("event", "pod_mts", "csi_mts", "f2_mts"))


@query(
    "detection_categories",
    f"""SELECT run, cell_id, CASE WHEN px>={THRESHOLD} AND py>={THRESHOLD} THEN 'Detected' WHEN px>={THRESHOLD} THEN 'Miss'
       WHEN py>={THRESHOLD} THEN 'False Alarm' ELSE 'Correct Negative' END AS detection_category FROM peaks""",
)
def _detection(spark, sf):
    return metrics.detection_categories(pairs(spark, sf), THRESHOLD, include_negative=True)


@query(
    "overall_rmse",
    """SELECT round(sqrt(avg((lf-hf)*(lf-hf))),6) AS lf_rmse, round(sqrt(avg((0.7123457E0*lf+0.2876543E0*elevation-hf)*(0.7123457E0*lf+0.2876543E0*elevation-hf))),6) AS upskill_rmse
       FROM cells""",
)
def _overall(spark, sf):
    c, keys = view(spark, sf, "cells"), ["run", "t", "cell_id"]
    up = F.lit(0.7123457) * F.col("lf") + F.lit(0.2876543) * F.col("elevation")
    return rnd(
        metrics.overall_rmse(
            c.select(*keys, F.col("lf").alias("value")), c.select(*keys, F.col("hf").alias("value")), c.select(*keys, up.alias("value"))
        )
    )


# --- other aggregates -----------------------------------------------------------------------------


@query(
    "wetness_class",
    """SELECT cell_id, CASE WHEN min(hf-elevation)>0.03E0 THEN 'AF' WHEN max(hf-elevation)>0.03E0 THEN 'TF'
       WHEN max(hf-elevation)<0.03E0 THEN 'AD' ELSE '' END AS wetness FROM cells GROUP BY cell_id""",
)
def _wetness(spark, sf):
    return stats.wetness_class(view(spark, sf, "cells").withColumnRenamed("hf", "value"), 0.03)


@query("event_maxima", "SELECT event_id, round(precip_cum,6) AS precip_cum, round(inflow,6) AS inflow FROM maxima")
def _maxima(spark, sf):
    return rnd(stats.event_maxima(view(spark, sf, "storm_ts")))


@query(
    "extreme_events",
    """WITH lim AS (SELECT min(precip_cum) p0, max(precip_cum) p1, min(inflow) i0, max(inflow) i1 FROM periods),
       j AS (SELECT p.*, (precip_cum-p0)/(p1-p0)+(inflow-i0)/(i1-i0) AS joint FROM periods p JOIN lim ON true),
       pick AS (SELECT event_id, 0 AS rank, row_number() OVER (ORDER BY rp_precip DESC, event_id) AS rn FROM j
         UNION ALL SELECT event_id, 1, row_number() OVER (ORDER BY rp_inflow DESC, event_id) FROM j
         UNION ALL SELECT event_id, 2, row_number() OVER (ORDER BY joint DESC, event_id) FROM j)
       SELECT event_id, CAST(min(rank) AS INT) AS rank, 'Max' AS "set" FROM pick WHERE rn=1 GROUP BY event_id""",
)
def _extremes(spark, sf):
    return stats.extreme_events(view(spark, sf, "periods"))


@query("feature_stats", "SELECT feature, round(avg(value),6)+0.0E0 AS mean, round(stddev_pop(value),6) AS std FROM forcing GROUP BY feature")
def _feature_stats(spark, sf):
    return rnd(stats.feature_stats(view(spark, sf, "forcing")))


@query(
    "nonzero_std",
    "SELECT feature, round(stddev_pop(CASE WHEN value<>0 THEN value END),6) AS std FROM forcing GROUP BY feature",
)
def _nonzero(spark, sf):
    return rnd(stats.nonzero_std(view(spark, sf, "forcing")))


@query(
    "mean_rainfall",
    "SELECT run, t, round(avg(value),6)+0.0E0 AS rain FROM forcing WHERE feature LIKE 'precip%' GROUP BY run, t",
)
def _rain(spark, sf):
    return rnd(stats.mean_rainfall(view(spark, sf, "forcing")))


WIDE = """
    SELECT run, t, max(CASE WHEN line='us' THEN flow END) AS us_flow, max(CASE WHEN line='us' THEN wse END) AS us_wse,
      max(CASE WHEN line='ds' THEN flow END) AS ds_flow, max(CASE WHEN line='ds' THEN wse END) AS ds_wse
    FROM ref_lines GROUP BY run, t"""
FRACTION = f"""
    SELECT b.cell_id, quantile_cont((w.us_wse-b.value)/nullif(w.us_wse-w.ds_wse,0), 0.5) AS frac
    FROM bank b JOIN ({WIDE}) w ON w.run=b.run AND w.t=b.t WHERE w.us_flow>0 OR w.ds_flow>0 GROUP BY b.cell_id"""


@query("centreline_fraction", f"SELECT cell_id, round(frac,6)+0.0E0 AS frac FROM ({FRACTION}) f")
def _fraction(spark, sf):
    return rnd(stats.centreline_fraction(view(spark, sf, "ref_lines"), view(spark, sf, "bank"), "us", "ds"))


KNOTS = 7


@query(
    "quantile_knots",
    "SELECT site, " + ", ".join(f"round(quantile_cont(flow, CAST({i}.0E0/8 AS DOUBLE)),6) AS k{i}" for i in range(1, KNOTS + 1))
    + " FROM (SELECT line AS site, flow*1.00123457E0 AS flow FROM ref_lines) r GROUP BY site",
)
def _knots(spark, sf):
    obs = view(spark, sf, "ref_lines").select(F.col("line").alias("site"), (F.col("flow") * 1.00123457).alias("flow"))
    found = stats.quantile_knots(obs, KNOTS)
    return rnd(found.select("site", *[F.col("knots")[i - 1].alias(f"k{i}") for i in range(1, KNOTS + 1)]))


@query(
    "fit_stats",
    """SELECT site, round(sqrt(avg((fitted-wse)*(fitted-wse))),6) AS rmse, round(avg(abs(fitted-wse)),6) AS mae
       FROM (SELECT line AS site, wse, 110+flow/50 AS fitted FROM ref_lines) r GROUP BY site""",
)
def _fit_stats(spark, sf):
    obs = view(spark, sf, "ref_lines").withColumnRenamed("line", "site").withColumn("fitted", F.lit(110) + F.col("flow") / 50)
    return rnd(stats.fit_stats(obs))


@query(
    "inducing_grid",
    """SELECT feature, CAST(i AS INT) AS point, round(lo+(hi-lo)*i/11.0E0,6)+0.0E0 AS z FROM
       (SELECT feature, min(value) AS lo, max(value) AS hi FROM forcing GROUP BY feature) f JOIN (SELECT unnest(range(12)) AS i) r ON true""",
)
def _grid_points(spark, sf):
    return rnd(stats.inducing_grid(view(spark, sf, "forcing"), 12))


@query("initial_lengthscale", "SELECT round(avg(abs(value)),6) AS lengthscale FROM forcing")
def _lengthscale(spark, sf):
    return rnd(stats.initial_lengthscale(view(spark, sf, "forcing")))


ERRORS = """
    SELECT 'lf' AS model, round(abs(lf-hf)*1.0012345E0,4) AS abs_error FROM cells
    UNION ALL SELECT 'upskill', round(abs(0.7123457E0*lf+0.2876543E0*elevation-hf)*1.0012345E0,4) FROM cells"""


def errors(spark, sf):
    c = view(spark, sf, "cells")
    up = F.lit(0.7123457) * F.col("lf") + F.lit(0.2876543) * F.col("elevation")
    return c.select(
        F.inline(F.array(
            F.struct(F.lit("lf").alias("model"), F.round(F.abs(F.col("lf") - F.col("hf")) * 1.0012345, 4).alias("abs_error")),
            F.struct(F.lit("upskill").alias("model"), F.round(F.abs(up - F.col("hf")) * 1.0012345, 4).alias("abs_error")),
        ))
    )


@query(
    "error_cdf",
    f"""SELECT model, abs_error, count(*) AS n, round(100.0E0*(min(rn)-1)/(max(total)-1),6) AS pct_first, round(100.0E0*(max(rn)-1)/(max(total)-1),6) AS pct_last
       FROM (SELECT model, abs_error, row_number() OVER (PARTITION BY model ORDER BY abs_error) AS rn, count(*) OVER (PARTITION BY model) AS total
             FROM ({ERRORS}) e) q GROUP BY model, abs_error""",
)
def _cdf(spark, sf):
    return rnd(stats.error_cdf(errors(spark, sf)))


@query(
    "error_cdf_points",
    f"""SELECT model, pct, round(v,6) AS abs_error FROM
       (SELECT model, unnest([0.0E0,25.0E0,50.0E0,90.0E0,99.0E0,100.0E0]) AS pct, unnest(quantile_cont(abs_error,[0.0,0.25,0.5,0.9,0.99,1.0])) AS v
        FROM ({ERRORS}) e GROUP BY model) q""",
)
def _cdf_points(spark, sf):
    return rnd(stats.error_cdf(errors(spark, sf), points=[0, 25, 50, 90, 99, 100]))


@query(
    "box_summary",
    """SELECT event, count(*) AS n, round(min(rmse_cell_toi),6) AS lo, round(quantile_cont(rmse_cell_toi,0.25),6) AS q1,
       round(quantile_cont(rmse_cell_toi,0.5),6) AS median, round(quantile_cont(rmse_cell_toi,0.75),6) AS q3, round(max(rmse_cell_toi),6) AS hi
       FROM (SELECT event, rmse_cell_toi*1.00123457E0 AS rmse_cell_toi FROM cell_metrics WHERE cell_id%13<>0) m GROUP BY event""",
)
def _box(spark, sf):
    gaps = view(spark, sf, "cell_metrics").withColumn(
        "rmse_cell_toi", F.when(F.col("cell_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("rmse_cell_toi") * 1.00123457)
    )
    return rnd(stats.box_summary(gaps, "rmse_cell_toi"))


@query("steps_per_event", "SELECT run AS event, count(DISTINCT t) AS n_steps FROM pairs GROUP BY run")
def _steps(spark, sf):
    return stats.steps_per_event(suite(spark, sf).timeseries)


@query("event_bounds", "SELECT event_id, min(datetime) AS start_time, max(datetime) AS end_time FROM storm_ts GROUP BY event_id")
def _bounds(spark, sf):
    return stats.event_bounds(view(spark, sf, "storm_ts"))


@query(
    "role_counts",
    "SELECT count(*) FILTER (WHERE type='Train') AS train_event_count, count(*) FILTER (WHERE type='Test') AS test_event_count FROM periods",
)
def _roles(spark, sf):
    return stats.role_counts(view(spark, sf, "periods"))


@query(
    "axis_limits",
    "SELECT floor(least(min(rmse_cell_toi),min(err_cell_toi))) AS lo, ceil(greatest(max(rmse_cell_toi),max(err_cell_toi))) AS hi FROM cell_metrics",
)
def _limits(spark, sf):
    return stats.axis_limits(view(spark, sf, "cell_metrics"), ["rmse_cell_toi", "err_cell_toi"])


EIGEN = "SELECT pos AS mode, stddev_pop(v)*20 AS eigenvalue FROM grid GROUP BY pos"


def eigen(spark, sf):
    return run_sql(spark, sf, EIGEN)


@query(
    "eigen_summary",
    f"""SELECT mode, round(eigenvalue,6) AS eigenvalue, round(sqrt(2.0E0/500)*eigenvalue,6) AS stderr, round(eigenvalue-sqrt(2.0E0/500)*eigenvalue,6) AS low,
       round(eigenvalue+sqrt(2.0E0/500)*eigenvalue,6) AS high, mode<7 AS selected FROM ({EIGEN}) e""",
)
def _eigen_summary(spark, sf):
    return rnd(stats.eigen_summary(eigen(spark, sf), 500, 7))


@query(
    "norths_rule",
    f"""WITH e AS (SELECT mode, eigenvalue, row_number() OVER (ORDER BY eigenvalue DESC, mode)-1 AS pos, lead(eigenvalue) OVER (ORDER BY eigenvalue DESC, mode) AS nxt
       FROM ({EIGEN}) q WHERE eigenvalue>1),
       g AS (SELECT count(*) AS kept, min(CASE WHEN abs(nxt-eigenvalue)<=sqrt(2.0E0/1000000)*eigenvalue THEN pos END) AS gap FROM e)
       SELECT CAST(CASE WHEN coalesce(gap,0)=0 THEN kept ELSE gap END AS INT) AS modes FROM g""",
)
def _north(spark, sf):
    return stats.norths_rule(eigen(spark, sf), 1_000_000)
