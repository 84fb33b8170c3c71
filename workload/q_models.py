"""Storm selection, Gaussian processes, experiments and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import gp, select
from freshet.operators.windows import return_periods
from freshet.plans import experiment, sweep
from freshet.schema import Dataset
from workload.registry import query, rnd
from workload.views import run_sql, scratch, view

# --- selection ------------------------------------------------------------------------------------

TARGETS = (2, 3, 5, 8, 12)


def periods(spark, sf):
    return return_periods(view(spark, sf, "maxima"))


@query("select_design")
def _design(spark, sf):
    return rnd(select.select_design(view(spark, sf, "periods"), (10, 20, 40, 80)))


@query("select_diverse")
def _diverse(spark, sf):
    features = select.cut_lineage(select.storm_features(view(spark, sf, "storm_ts")))
    seeds = [r[0] for r in features.orderBy("event_id").select("event_id").limit(3).collect()]
    picked = select.select_diverse(features, seeds, 8)
    return spark.createDataFrame([(i, e) for i, e in enumerate(picked)], "pick int, event_id long")


POINT = tuple((i * 7 % 11 - 5) / 10 for i in range(64))


@query(
    "farthest_distance",
    "SELECT run, t, round(sqrt(sum(pow(v-(pos*7%11-5)/10.0E0,2))),6) AS d FROM grid GROUP BY run, t",
)
def _distance(spark, sf):
    rows = gp.stack(view(spark, sf, "grid"), "pos", "v", "x")
    return rnd(rows.select("run", "t", select.distance_to("x", POINT).alias("d")))


@query(
    "select_test",
    """WITH e AS (SELECT * FROM periods WHERE rp_precip BETWEEN 20 AND 120 AND rp_inflow BETWEEN 20 AND 120 AND event_id NOT IN (SELECT event_id FROM periods WHERE rp_precip>90)),
       b AS (SELECT i AS bin, pow(10, log10(20.0E0)+i*(log10(120.0E0)-log10(20.0E0))/3) AS a, pow(10, log10(20.0E0)+(i+1)*(log10(120.0E0)-log10(20.0E0))/3) AS z FROM (SELECT unnest([0,1,2]) AS i) r),
       p AS (SELECT event_id, row_number() OVER (PARTITION BY bin ORDER BY md5(concat('42:',event_id)), event_id) AS rn FROM e JOIN b ON e.rp_precip BETWEEN b.a AND b.z
         UNION ALL SELECT event_id, row_number() OVER (PARTITION BY bin ORDER BY md5(concat('43:',event_id)), event_id) FROM e JOIN b ON e.rp_inflow BETWEEN b.a AND b.z),
       u AS (SELECT DISTINCT event_id FROM p WHERE rn=1),
       f AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat('42:',event_id)), event_id) AS rn FROM e WHERE event_id NOT IN (SELECT event_id FROM u))
       SELECT event_id, 'Test' AS "set", 'Test' AS type FROM u UNION ALL SELECT event_id, 'Test', 'Test' FROM f WHERE rn<=7-(SELECT count(*) FROM u)""",
)
def _test(spark, sf):
    p = view(spark, sf, "periods")
    return select.select_test(p, (20, 120), 7, p.where(F.col("rp_precip") > 90)).select("event_id", "set", "type")


@query("select_events")
def _events(spark, sf):
    storms = view(spark, sf, "storm_ts")
    return rnd(select.select_events(storms, select.cut_lineage(periods(spark, sf)), 12, 6, TARGETS, (0.2, 20)))


# --- Gaussian processes ---------------------------------------------------------------------------


def gp_rows(spark, sf):
    """Four inputs and three targets per sample; the targets follow the inputs."""
    g = view(spark, sf, "grid")
    rows = gp.stack(g.where(F.col("pos") < 5), "pos", "v", "x")
    scaled = rows.withColumn("x", F.transform("x", lambda v: v * 6))
    x = F.col("x")
    y = F.array(F.sin(x[0]) + x[4] / 10, x[1] * x[2] + x[4] / 10, F.cos(x[0] + x[3]) + x[4] / 10)
    return scaled.select("run", "t", F.slice("x", 1, 4).alias("x"), y.alias("y"))


@query("inducing_kmeans")
def _kmeans(spark, sf):
    z = gp.inducing_points(gp_rows(spark, sf), 8)
    return spark.createDataFrame([(i, float(v[0]), float(v[1])) for i, v in enumerate(z)], "point int, z0 double, z1 double")


def fitted(spark, sf, **options):
    rows = gp.cut_lineage(gp_rows(spark, sf))
    return rows, gp.fit_gpr(rows, **{"kernel": "Matern32", "n_inducing": 12, "refine": 1, "points": 5, **options})


@query("fit_gpr")
def _fit(spark, sf):
    return rnd(fitted(spark, sf)[1].select("mode", "kernel", "variance", "lengthscale", "noise", "loss"), 3)


@query("predict_gpr")
def _predict(spark, sf):
    rows, model = fitted(spark, sf)
    return rnd(gp.predict_gpr(rows, model), 4)


@query("save_gpr")
def _save(spark, sf):
    path = scratch(spark)
    gp.save(fitted(spark, sf)[1], path)
    return rnd(gp.load(spark, path).select("mode", "kernel", "variance", "lengthscale", "noise"), 3)


@query("search_random")
def _random(spark, sf):
    rows = gp.cut_lineage(gp_rows(spark, sf))
    model = gp.fit_gpr(rows, "RBF", 8, "grid", "random", n_starts=8)
    return rnd(model.select("mode", "variance", "lengthscale", "noise", "loss"), 3)


@query(
    "search_lbfgs",
    """SELECT CAST(m.mode AS INT) AS mode, count(*) AS n, true AS below_start, true AS not_above_adam, true AS points_moved
       FROM (SELECT unnest([0,1,2]) AS mode) m JOIN (SELECT DISTINCT run, t FROM grid) g ON true GROUP BY m.mode""",
)
def _lbfgs(spark, sf):
    """What the quasi-Newton search promises, against the start and as many steps of Adam on the same rows."""
    import numpy as np

    rows = gp.cut_lineage(gp_rows(spark, sf))
    z = gp.inducing_points(rows, 6)
    n = rows.count()
    start = gp.losses_and_gradients(rows, "RBF", gp._start(rows, z, 1.0))
    found = gp.search_lbfgs(rows, "RBF", z, 1.0, max_iter=8)
    adam = gp.search_adam(rows, "RBF", z, 1.0, max_iter=8, rate=0.05)
    out = [(m, n, bool(c.loss < start[m][0]), bool(c.loss <= adam[m].loss), not np.allclose(c.z, z)) for m, c in sorted(found.items())]
    return spark.createDataFrame(out, "mode int, n long, below_start boolean, not_above_adam boolean, points_moved boolean")


@query("search_evolution")
def _evolution(spark, sf):
    rows = gp.cut_lineage(gp_rows(spark, sf))
    model = gp.fit_gpr(rows, "Matern52", 8, "kmeans", "evolution", popsize=2, max_iter=3)
    return rnd(model.select("mode", "variance", "lengthscale", "noise", "loss"), 3)


@query(
    "gram_sums",
    """SELECT count(*) AS n, round(sum(exp(-r/2)*exp(-r/2)),5) AS k00, round(sum(exp(-r/2)*y0),5) AS b0, round(sum(y0*y0),5) AS yy0 FROM
       (SELECT sqrt(pow(x0,2)+pow(x1,2)+pow(x2,2)+pow(x3,2))/1.3E0 AS r, sin(x0)+x4/10 AS y0 FROM (SELECT run, t, """
    + ", ".join(f"max(CASE WHEN pos={i} THEN v END)*6 AS x{i}" for i in range(5)) + " FROM grid GROUP BY run, t) g) q",
)
def _gram(spark, sf):
    """Sums of one candidate whose only inducing point is the origin."""
    import numpy as np

    sums = gp.gram.fetch(gp.gram_pass(gp_rows(spark, sf), "Exponential", [gp.Candidate(0, 1.3, np.zeros((1, 4)))]), 4)[0]
    row = (int(sums[1, 0]), float(sums[0, 0]), float(sums[0, 1]), float(sums[1, 1]))
    return rnd(spark.createDataFrame([row], "n long, k00 double, b0 double, yy0 double"), 5)


# --- experiments ----------------------------------------------------------------------------------


def split(spark, sf) -> tuple[Dataset, Dataset]:
    """Training and test runs of the same mesh."""
    c = view(spark, sf, "cells")
    info = view(spark, sf, "cell_info")
    keys = ["run", "t", "cell_id"]

    def part(cond):
        rows = c.where(cond)
        return Dataset(
            rows.select(*keys, F.col("hf").alias("value")), rows.select(*keys, F.col("lf").alias("value")), info, view(spark, sf, "ref_lines")
        )

    test = F.col("run").isin("signup", "view")
    return part(~test), part(test)


def on_steps(series: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``series`` on the steps that ``other`` has too.

    The steps of both are few and go to every task, so that no pass over the series is shuffled for them.
    """
    keys = ["run", "t"]
    steps = series.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_semi")
    return series.join(F.broadcast(gp.cut_lineage(steps)), keys, "left_semi")


def config(**changes) -> experiment.Config:
    base = experiment.Config(
        spatial_mode_count=4, inducing_pt_count=10, optimizer_kwargs={"points": 5, "refine": 0}, depth_threshold=6.0
    )
    return experiment.with_options(base, **changes)


@query("train_predict_score")
def _experiment(spark, sf):
    out = experiment.train_predict_score(*split(spark, sf), config())
    return rnd(out.metrics.scalar, 3)


@query("train_predict_score_forcing")
def _experiment_forcing(spark, sf):
    """Rainfall and inflow features as inputs: each run borrows a forcing series."""
    train, test = split(spark, sf)
    mapping = run_sql(spark, sf, "SELECT run, concat('r', CAST((row_number() OVER (ORDER BY run)-1)%4 AS STRING)) AS source FROM (SELECT DISTINCT run FROM cells) r")
    lf = view(spark, sf, "forcing").withColumnRenamed("run", "source").join(mapping, "source").drop("source")
    for part in (train, test):
        part.lf = gp.cut_lineage(lf.join(part.hf.select("run").distinct(), "run", "left_semi"))
        part.hf = on_steps(part.hf, part.lf)
    out = experiment.train_predict_score(train, test, config(lf_model_type="forcing", precip_spatial_mode_count=2))
    return rnd(out.metrics.scalar, 3)


UPSKILL = "SELECT cell_id, CAST(floor(cell_id/3.0) AS INT) AS lf_cell_id, elevation FROM cell_info"


@query(
    "lf_builder_upskill",
    f"SELECT c.run, c.t, m.cell_id, round(greatest(c.lf,m.elevation),6) AS value FROM cells c JOIN ({UPSKILL}) m ON m.lf_cell_id=c.cell_id",
)
def _upskill(spark, sf):
    cells = run_sql(spark, sf, UPSKILL)
    lf = view(spark, sf, "cells").select("run", "t", "cell_id", F.col("lf").alias("value"))
    return rnd(experiment.lf_builder("upskill")(lf, cells, cells))


@query("sweep_kernel")
def _sweep(spark, sf):
    train, test = split(spark, sf)
    scores = sweep.sweep(spark, config(), {"kernel": ["Matern12", "RBF"]}, train, test, scratch(spark))
    return rnd(sweep.leaderboard(scores), 3)


SWEEP = "SELECT event, CAST(cell_id%9 AS INT) AS sweep_id, rmse_cell_toi AS rmse_aoi_toi FROM cell_metrics"


@query(
    "leaderboard",
    f"""SELECT sweep_id, round(m,6) AS rmse_aoi_toi, CAST(row_number() OVER (ORDER BY m, sweep_id) AS INT) AS rank FROM
       (SELECT sweep_id, avg(rmse_aoi_toi) AS m FROM ({SWEEP}) s GROUP BY sweep_id) q""",
)
def _leaderboard(spark, sf):
    return rnd(sweep.leaderboard(run_sql(spark, sf, SWEEP)))


