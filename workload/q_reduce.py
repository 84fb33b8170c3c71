"""Mode reduction, forcing features and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import features, reduce, surfaces
from freshet.operators.reduce import EofModel
from freshet.operators.stats import centreline_fraction
from workload.q_metrics import FRACTION, WIDE
from workload.registry import query, rnd
from workload.views import run_sql, view

# --- principal components -------------------------------------------------------------------------


@query(
    "covariance",
    """WITH g AS (SELECT run, t, pos, v FROM grid) SELECT i, j, round(covar_samp,6)+0.0E0 AS cov FROM
       (SELECT a.pos AS i, b.pos AS j, covar_samp(a.v, b.v) AS covar_samp FROM g a JOIN g b ON b.run=a.run AND b.t=a.t AND b.pos>=a.pos GROUP BY a.pos, b.pos) q""",
)
def _covariance(spark, sf):
    return rnd(reduce.covariance(view(spark, sf, "grid"), "pos", "v"))


@query(
    "principal_modes_total",
    "SELECT round(sum(var_samp),6) AS total FROM (SELECT pos, var_samp(v) AS var_samp FROM grid GROUP BY pos) q",
)
def _modes_total(spark, sf):
    found = reduce.principal_modes(view(spark, sf, "grid"), ["run", "t"], "pos", "v")
    return rnd(found.eigen.agg(F.sum("eigenvalue").alias("total")))


def hf_series(spark, sf):
    return view(spark, sf, "cells").select("run", "t", "cell_id", F.col("hf").alias("value"))


@query(
    "fit_eof_cells",
    """SELECT c.cell_id, CASE WHEN min(c.hf-c.elevation)>0.03E0 THEN 'AF' WHEN max(c.hf-c.elevation)>0.03E0 THEN 'TF' WHEN max(c.hf-c.elevation)<0.03E0 THEN 'AD' ELSE '' END AS wetness,
       min(c.elevation) AS elevation, round(avg(c.elevation+(c.hf-c.elevation)*1.00123457E0),6) AS mean, min(i.area) AS weight FROM cells c JOIN cell_info i ON i.cell_id=c.cell_id GROUP BY c.cell_id""",
)
def _cell_statistics(spark, sf):
    series = view(spark, sf, "cells").withColumn("value", F.col("elevation") + (F.col("hf") - F.col("elevation")) * 1.00123457)
    return rnd(reduce.cell_statistics(series, view(spark, sf, "cell_info")))


@query("fit_eof")
def _fit_eof(spark, sf):
    model = reduce.fit_eof(hf_series(spark, sf), view(spark, sf, "cell_info"), k=5)
    return rnd(model.eigen.join(model.mode_stats, "mode"))


@query(
    "fit_eof_roundtrip",
    """SELECT c.run, c.t, c.cell_id, round(CASE WHEN s.wetness='AD' THEN c.elevation ELSE c.hf END,5) AS value
       FROM cells c JOIN cell_stats s ON s.cell_id=c.cell_id""",
)
def _roundtrip(spark, sf):
    """With every mode kept, the way back gives the levels again."""
    series = hf_series(spark, sf)
    info = view(spark, sf, "cell_info")
    wet = view(spark, sf, "cell_stats").where(F.col("wetness") != "AD").count()
    model = reduce.fit_eof(series, info, k=wet)
    back = reduce.to_cells(reduce.to_modes(series, model), model)
    return rnd(back, 5)


def given_model(spark, sf, parameter="wse") -> EofModel:
    """Reduction with given loadings, so that both engines can apply it."""
    return EofModel(
        view(spark, sf, "cell_stats"), view(spark, sf, "eof"), view(spark, sf, "mode_stats").select("mode", F.lit(1.0).alias("eigenvalue")),
        view(spark, sf, "mode_stats"), 1, 3, parameter,
    )


@query(
    "to_modes",
    """SELECT c.run, c.t, e.mode, round((sum((c.hf-s.mean)*s.weight*e.loading)-min(m.mean))/min(m.std),6)+0.0E0 AS z
       FROM cells c JOIN cell_stats s ON s.cell_id=c.cell_id JOIN eof e ON e.cell_id=c.cell_id JOIN mode_stats m ON m.mode=e.mode GROUP BY 1,2,3""",
)
def _to_modes(spark, sf):
    return rnd(reduce.to_modes(hf_series(spark, sf), given_model(spark, sf)))


BACK = """
    SELECT z.run, z.t, s.cell_id, CASE WHEN s.wetness='AD' THEN min(s.elevation) ELSE min(s.mean)+sum((z.z*m.std+m.mean)*e.loading)/min(s.weight) END AS value,
      CASE WHEN s.wetness='AD' THEN 0.0E0 ELSE sum(z.var*pow(m.std*e.loading/s.weight,2)) END AS var
    FROM step_scores z JOIN mode_stats m ON m.mode=z.mode JOIN cell_stats s ON true LEFT JOIN eof e ON e.mode=z.mode AND e.cell_id=s.cell_id
    GROUP BY z.run, z.t, s.cell_id, s.wetness"""


@query("to_cells", f"SELECT run, t, cell_id, round(value,6) AS value, round(var,6)+0.0E0 AS var FROM ({BACK}) b")
def _to_cells(spark, sf):
    return rnd(reduce.to_cells(view(spark, sf, "step_scores"), given_model(spark, sf), salts=4))


@query("var_to_cells", f"SELECT run, t, cell_id, round(var,6)+0.0E0 AS var FROM ({BACK}) b")
def _var_to_cells(spark, sf):
    return rnd(reduce.var_to_cells(view(spark, sf, "step_scores").drop("z"), given_model(spark, sf)))


# --- forcing --------------------------------------------------------------------------------------

INFLOW = "SELECT run, t, feature, value FROM forcing WHERE feature LIKE 'inflow%' AND t%5<>0"
PRECIP = "SELECT run, t, feature, value FROM forcing WHERE feature LIKE 'precip%' AND t%7<>0"


@query(
    "forcing_table",
    f"""WITH b AS ({INFLOW} UNION ALL {PRECIP})
       SELECT s.run, s.t, f.feature, round(coalesce(b.value,0.0E0),6)+0.0E0 AS value FROM (SELECT DISTINCT run, t FROM b) s
       JOIN (SELECT DISTINCT feature FROM b) f ON true LEFT JOIN b ON b.run=s.run AND b.t=s.t AND b.feature=f.feature""",
)
def _forcing(spark, sf):
    return rnd(features.forcing_table(run_sql(spark, sf, INFLOW), run_sql(spark, sf, PRECIP)))


DERIVED = """
    WITH c AS (SELECT f.run, f.t, f.feature, f.value-m.mean AS value FROM forcing f JOIN (SELECT feature, avg(value) AS mean FROM forcing GROUP BY feature) m ON m.feature=f.feature),
    r AS (SELECT run, t, avg(value) AS rain FROM c WHERE feature LIKE 'precip%' GROUP BY run, t)
    SELECT run, t, feature, value FROM c WHERE feature LIKE 'inflow%'
    UNION ALL SELECT run, t, 'rain_mean', rain FROM r
    UNION ALL SELECT a.run, a.t, 'rain_api', sum(b.rain*pow(0.85E0,a.t-b.t)) FROM r a JOIN r b ON b.run=a.run AND b.t<=a.t GROUP BY a.run, a.t
    UNION ALL SELECT a.run, a.t, 'rain_sum', sum(b.rain) FROM r a JOIN r b ON b.run=a.run AND b.t<=a.t GROUP BY a.run, a.t"""


@query("forcing_features", f"SELECT run, t, feature, round(value,6)+0.0E0 AS value FROM ({DERIVED}) d")
def _derived(spark, sf):
    f = view(spark, sf, "forcing")
    means = f.groupBy("feature").agg(F.avg("value").alias("mean"))
    return rnd(features.derived_features(features.centre(f, means), None, 0))


@query(
    "transform_forcing",
    f"""WITH d AS ({DERIVED}), s AS (SELECT feature, avg(value) AS mean, stddev_pop(CASE WHEN value<>0 THEN value END) AS std FROM d GROUP BY feature)
       SELECT d.run, d.t, d.feature, round((d.value-s.mean)/s.std,5)+0.0E0 AS z FROM d JOIN s ON s.feature=d.feature""",
)
def _transform_forcing(spark, sf):
    f = view(spark, sf, "forcing")
    model = features.fit_forcing_features(f, k=3)
    out = features.transform_forcing(f, model)
    return rnd(out.where(~F.col("feature").startswith("rain_pc_")), 5)


@query("fit_forcing_features")
def _fit_forcing(spark, sf):
    model = features.fit_forcing_features(view(spark, sf, "forcing"), k=3)
    return rnd(model.stats)


# --- rating curves and surfaces -------------------------------------------------------------------


def rating_obs(spark, sf):
    return view(spark, sf, "ref_lines").select(F.col("line").alias("site"), "run", "t", "flow", "wse")


@query(
    "rating_gram",
    """WITH o AS (SELECT line AS site, flow, wse FROM ref_lines WHERE flow>10),
       k AS (SELECT site, quantile_cont(flow, [0.25,0.5,0.75]) AS q, min(flow) AS a, max(flow) AS z FROM o GROUP BY site),
       j AS (SELECT o.*, k.a, k.z, k.q, CASE WHEN flow>=q[3] THEN 3 WHEN flow>=q[2] THEN 2 WHEN flow>=q[1] THEN 1 ELSE 0 END AS j FROM o JOIN k ON k.site=o.site)
       SELECT site, j AS interval, count(*) AS n, round(sum(pow(CASE j WHEN 0 THEN pow((q[1]-flow)/(q[1]-a),3) WHEN 1 THEN pow(q[2]-flow,3)/((q[2]-q[1])*(q[2]-a)*(q[2]-a))
         WHEN 2 THEN pow(q[3]-flow,3)/((q[3]-q[2])*(q[3]-q[1])*(q[3]-a)) ELSE pow(z-flow,3)/((z-q[3])*(z-q[2])*(z-q[1])) END,2)),6) AS g00
       FROM j GROUP BY site, j""",
)
def _rating_gram(spark, sf):
    from freshet.operators.filters import rating_filter

    obs = rating_filter(rating_obs(spark, sf)).select("site", "flow", "wse")
    knots = surfaces.site_knots(obs, ["site"], 3)
    sums = surfaces.rating_gram(obs.join(knots, "site"), ["site"])
    return rnd(sums.select("site", F.col("_j").alias("interval"), "n", "g00"))


@query("fit_rating")
def _fit_rating(spark, sf):
    model = surfaces.fit_rating(rating_obs(spark, sf))
    return rnd(model.select("site", "q_min", "q_max", F.posexplode("coefs").alias("i", "coef")))


@query("apply_rating")
def _apply_rating(spark, sf):
    obs = rating_obs(spark, sf)
    return rnd(surfaces.apply_rating(obs, surfaces.fit_rating(obs)))


@query("rating_trace")
def _trace(spark, sf):
    return rnd(surfaces.rating_trace(surfaces.fit_rating(rating_obs(spark, sf)), 1000))


def levels(spark, sf):
    return run_sql(spark, sf, f"SELECT run, t, us_wse, ds_wse FROM ({WIDE}) w")


@query(
    "centreline_profile",
    f"SELECT w.run, w.t, f.cell_id, round(w.us_wse-(w.us_wse-w.ds_wse)*f.frac,6) AS value FROM ({WIDE}) w JOIN ({FRACTION}) f ON true",
)
def _profile(spark, sf):
    frac = centreline_fraction(view(spark, sf, "ref_lines"), view(spark, sf, "bank"), "us", "ds")
    return rnd(surfaces.centreline_profile(levels(spark, sf), frac))


SOURCE = "SELECT run, t, cell_id, hf AS value FROM cells"
SPREAD_MAP = "SELECT cell_id, CAST(floor(cell_id/3.0) AS INT) AS near_id FROM cell_info"


@query(
    "spread_to_cells",
    f"SELECT m.cell_id, s.run, s.t, round(s.value,6) AS value FROM ({SOURCE}) s JOIN ({SPREAD_MAP}) m ON m.near_id=s.cell_id",
)
def _spread(spark, sf):
    return rnd(surfaces.spread_to_cells(run_sql(spark, sf, SOURCE), run_sql(spark, sf, SPREAD_MAP)))


FLOWS = f"SELECT run, t, us_flow, ds_flow FROM ({WIDE}) w"
SURFACE_MAP = "SELECT n_nationkey AS cell_id, CAST(n_nationkey%20 AS INT) AS near_id, 100.0E0+n_regionkey*2 AS elevation FROM {nation}"


@query(
    "pseudo_surface",
    f"""SELECT w.run, w.t, m.cell_id, round(greatest(u.fit-(u.fit-d.fit)*f.frac, m.elevation, m.elevation+m.cell_id/10.0E0),6) AS value FROM ({FLOWS}) w
       JOIN LATERAL (SELECT 100+2*w.us_flow/9 AS fit) u ON true JOIN LATERAL (SELECT 90+2*w.ds_flow/9 AS fit) d ON true
       JOIN ({SURFACE_MAP}) m ON true JOIN ({FRACTION}) f ON f.cell_id=m.near_id""",
)
def _pseudo(spark, sf):
    """Straight-line ratings written as cubic splines, so that the check can use the line."""
    ends, knots = (0.0, 450.0), [0.0] * 4 + [150.0, 300.0] + [450.0] * 4
    # Coefficients of a straight line are its values at the knot averages.
    at = [sum(knots[i + 1 : i + 4]) / 3 for i in range(6)]
    ratings = spark.createDataFrame(
        [("us", *ends, knots, [100 + 2 * q / 9 for q in at]), ("ds", *ends, knots, [90 + 2 * q / 9 for q in at])],
        "site string, q_min double, q_max double, knots array<double>, coefs array<double>",
    )
    frac = centreline_fraction(view(spark, sf, "ref_lines"), view(spark, sf, "bank"), "us", "ds")
    cells = run_sql(spark, sf, SURFACE_MAP)
    from freshet.operators.joins import deal_steps, pair_up

    flows = deal_steps(run_sql(spark, sf, FLOWS), cells.count())
    other = pair_up(flows.select("run", "t"), cells.select("cell_id", (F.col("elevation") + F.col("cell_id") / 10).alias("value")))
    return rnd(surfaces.pseudo_surface(flows, ratings, frac, cells.select("cell_id", "near_id"), cells, other))
