"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import exprs
from freshet.operators import filters
from workload.registry import query, rnd
from workload.views import run_sql, table, view


@query("depth", "SELECT run, t, cell_id, round(greatest(hf-elevation-1,0.0E0),6) AS depth FROM cells")
def _depth(spark, sf):
    c = view(spark, sf, "cells")
    return rnd(c.select("run", "t", "cell_id", exprs.depth(F.col("hf") - 1, "elevation").alias("depth")))


@query("raw_depth", "SELECT run, t, cell_id, round(hf,6) AS value, round(hf-elevation,6)+0.0E0 AS raw_depth FROM cells")
def _raw_depth(spark, sf):
    c = view(spark, sf, "cells")
    series = c.select("run", "t", "cell_id", F.col("hf").alias("value"))
    return rnd(exprs.raw_depth(series, view(spark, sf, "cell_info")))


@query(
    "speed",
    """SELECT l_orderkey, l_partkey, round(sum(sqrt(l_quantity*l_quantity+l_tax*l_tax*10000)),6) AS speed FROM lineitem GROUP BY 1,2""",
)
def _speed(spark, sf):
    li = table(spark, sf, "lineitem")
    v = exprs.speed("l_quantity", F.col("l_tax") * 100)
    return rnd(li.select("l_orderkey", "l_partkey", v.alias("speed")).groupBy("l_orderkey", "l_partkey").agg(F.sum("speed").alias("speed")))


HOLES = "SELECT run, t, cell_id, elevation, CASE WHEN (t+cell_id)%7=0 THEN CAST('NaN' AS DOUBLE) ELSE hf-2 END AS v FROM cells"


@query(
    "floor_to_ground",
    f"SELECT run, t, cell_id, round(CASE WHEN isnan(v) OR v<elevation THEN elevation ELSE v END,6) AS level FROM ({HOLES}) h",
)
def _floor(spark, sf):
    h = run_sql(spark, sf, HOLES)
    return rnd(h.select("run", "t", "cell_id", exprs.floor_to_ground("v", "elevation").alias("level")))


@query("max_surface", "SELECT run, t, cell_id, round(greatest(hf,lf,elevation+3),6) AS level FROM cells")
def _max_surface(spark, sf):
    c = view(spark, sf, "cells")
    return rnd(c.select("run", "t", "cell_id", exprs.max_surface("hf", "lf", F.col("elevation") + 3).alias("level")))


HYDRAULIC = "SELECT run, t, cell_id, elevation, hf-1 AS wse, hf-elevation AS vx, lf-elevation AS vy FROM cells"


@query(
    "hydraulic_value",
    f"""SELECT 'wse' AS parameter, run, t, cell_id, round(wse,6) AS value FROM ({HYDRAULIC}) h
       UNION ALL SELECT 'depth', run, t, cell_id, round(greatest(wse-elevation,0.0E0),6) FROM ({HYDRAULIC}) h
       UNION ALL SELECT 'velocity', run, t, cell_id, round(sqrt(vx*vx+vy*vy),6) FROM ({HYDRAULIC}) h""",
)
def _hydraulic(spark, sf):
    h = run_sql(spark, sf, HYDRAULIC)
    parts = [
        exprs.hydraulic_value(h, p).select(F.lit(p).alias("parameter"), "run", "t", "cell_id", "value")
        for p in exprs.HYDRAULIC_PARAMETERS
    ]
    return rnd(parts[0].unionByName(parts[1]).unionByName(parts[2]))


MESH = """SELECT cell_id, CASE WHEN cell_id%9=0 THEN CAST('NaN' AS DOUBLE) WHEN cell_id%11=0 THEN NULL ELSE elevation END AS elevation,
    CASE WHEN cell_id%5=0 THEN 1.0E-9 WHEN cell_id%7=0 THEN CAST('NaN' AS DOUBLE) ELSE elevation*1.0E-6 END AS area FROM hf_mesh"""


@query("valid_elevation", f"SELECT cell_id, elevation FROM ({MESH}) m WHERE elevation IS NOT NULL AND NOT isnan(elevation)")
def _valid_elevation(spark, sf):
    return filters.valid_elevation(run_sql(spark, sf, MESH)).select("cell_id", "elevation")


@query("valid_area", f"SELECT cell_id, area FROM ({MESH}) m WHERE abs(area)>1.0E-8 AND NOT isnan(area)")
def _valid_area(spark, sf):
    return filters.valid_area(run_sql(spark, sf, MESH)).select("cell_id", "area")


@query(
    "drop_dry",
    "SELECT run, t, cell_id, round(hf,6) AS hf FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM cell_stats WHERE wetness='AD')",
)
def _drop_dry(spark, sf):
    kept = filters.drop_dry(view(spark, sf, "cells"), view(spark, sf, "cell_stats"))
    return rnd(kept.select("run", "t", "cell_id", "hf"))


OBS = """SELECT run, t, line, CASE WHEN t%17=0 THEN CAST('Infinity' AS DOUBLE) WHEN t%19=0 THEN CAST('NaN' AS DOUBLE) ELSE flow END AS flow,
    CASE WHEN t%23=0 THEN NULL ELSE wse END AS wse FROM ref_lines"""


@query(
    "rating_filter",
    f"""SELECT run, t, line, round(flow,6) AS flow, round(wse,6) AS wse FROM ({OBS}) o
       WHERE flow>10 AND flow<1.0E11 AND NOT isnan(flow) AND wse IS NOT NULL AND NOT isnan(wse)""",
)
def _rating_filter(spark, sf):
    return rnd(filters.rating_filter(run_sql(spark, sf, OBS)))


@query("rp_window", "SELECT event_id, round(rp_precip,6) AS rp_precip FROM periods WHERE rp_precip BETWEEN 24.0E0 AND 36.0E0")
def _rp_window(spark, sf):
    return rnd(filters.rp_window(view(spark, sf, "periods"), "rp_precip", 30, 0.2).select("event_id", "rp_precip"))


@query(
    "joint_range",
    "SELECT event_id, round(rp_precip,6) AS rp_precip, round(rp_inflow,6) AS rp_inflow FROM periods WHERE rp_precip BETWEEN 20 AND 60 AND rp_inflow BETWEEN 20 AND 60",
)
def _joint_range(spark, sf):
    return rnd(filters.joint_range(view(spark, sf, "periods"), 20, 60).select("event_id", "rp_precip", "rp_inflow"))


RUNS = "SELECT o_orderkey AS run, 'basin' AS geometry, concat('mesh_', CAST(o_custkey%3 AS STRING)) AS mesh_name FROM {orders}"


@query(
    "single_geometry",
    "SELECT o_orderkey AS run, 'basin' AS geometry, 'mesh_1' AS mesh_name FROM orders WHERE o_custkey%3=1",
)
def _single_geometry(spark, sf):
    return filters.single_geometry(run_sql(spark, sf, RUNS), "mesh_1").select("run", "geometry", "mesh_name")


@query(
    "parse_model_time",
    """SELECT event_id, CASE event_id%3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts ELSE date_trunc('minute', ts) END AS model_time FROM events""",
)
def _parse_time(spark, sf):
    e = table(spark, sf, "events")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.upper(F.date_format("ts", "ddMMMyyyy HH:mm:ss")))
        .when(F.col("event_id") % 3 == 1, F.date_format("ts", "ddMMMyyyy HH:mm:ss.SSSSSS"))
        .otherwise(F.concat(F.lit("//SITE/FLOW/"), F.upper(F.date_format("ts", "ddMMMyyyy:HHmm")), F.lit("/1HOUR/")))
    )
    return e.select("event_id", exprs.parse_model_time(text).alias("model_time"))


@query(
    "clean_boundary_id",
    "SELECT id, regexp_replace(regexp_replace(trim(bc_line_id),'^bc_',''),'_base$','') AS element FROM boundaries",
)
def _clean(spark, sf):
    return view(spark, sf, "boundaries").select("id", exprs.clean_boundary_id("bc_line_id").alias("element"))


@query(
    "rewrite_path_dates",
    """SELECT r.event_id, r.ord, r.path AS old_path, concat('//', element, '/', param, '/', strftime(b.a,'%d%b%Y'), '-', strftime(b.z,'%d%b%Y'), '/1HOUR/RUN:SST/') AS path
       FROM (SELECT event_id, ord, path, upper(element) AS element, param FROM records) r
       JOIN (SELECT event_id, min(first_time) AS a, max(first_time) AS z FROM records GROUP BY event_id) b ON b.event_id=r.event_id""",
)
def _rewrite(spark, sf):
    from freshet.operators.stats import event_bounds

    r = view(spark, sf, "records").withColumnRenamed("first_time", "datetime")
    joined = r.join(event_bounds(r), "event_id")
    return joined.select(
        "event_id", "ord", F.col("path").alias("old_path"), exprs.rewrite_path_dates("path", "start_time", "end_time").alias("path")
    )


@query(
    "file_name",
    """SELECT page_id, 'plain' AS kind, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages
       UNION ALL SELECT page_id, 'object', concat('run ', CAST(page_id AS VARCHAR), '+a.p01.hdf') FROM pages""",
)
def _file_name(spark, sf):
    p = table(spark, sf, "pages")
    uri = F.concat(F.lit("s3://store/runs/"), F.col("page_id").cast("string"), F.lit("/run%20"), F.col("page_id").cast("string"), F.lit("+a.p01.hdf"))
    return p.select("page_id", F.lit("plain").alias("kind"), exprs.file_name("url").alias("name")).unionByName(
        p.select("page_id", F.lit("object").alias("kind"), exprs.file_name(uri).alias("name"))
    )


@query(
    "feature_class",
    "SELECT feature, CASE WHEN feature LIKE 'precip\\_%' ESCAPE '\\' THEN 'precip' ELSE 'boundary' END AS class, count(*) AS n FROM forcing GROUP BY feature",
)
def _feature_class(spark, sf):
    f = view(spark, sf, "forcing").withColumn("class", exprs.feature_class("feature"))
    return f.groupBy("feature", "class").agg(F.count(F.lit(1)).alias("n"))


@query("rp_close", "SELECT event_id, abs(rp_precip-rp_inflow)/nullif(greatest(rp_precip,rp_inflow),0)<0.15 AS close FROM periods")
def _rp_close(spark, sf):
    return view(spark, sf, "periods").select("event_id", exprs.rp_close("rp_precip", "rp_inflow", 0.15).alias("close"))


@query(
    "log_dist",
    "SELECT event_id, round(sqrt(pow(log10(rp_precip/25),2)+pow(log10(rp_inflow/25),2)),6) AS dist FROM periods WHERE rp_precip>0 AND rp_inflow>0",
)
def _log_dist(spark, sf):
    p = view(spark, sf, "periods")
    return rnd(p.select("event_id", exprs.log_dist("rp_precip", "rp_inflow", 25.0).alias("dist")).where(F.col("dist").isNotNull()))


@query(
    "confidence_band",
    "SELECT run, t, mode, round(z-1.959963984540054E0*sqrt(var),6)+0.0E0 AS low, round(z+1.959963984540054E0*sqrt(var),6)+0.0E0 AS high FROM scores",
)
def _band(spark, sf):
    return rnd(exprs.confidence_band(view(spark, sf, "scores"), mean="z").select("run", "t", "mode", "low", "high"))


DISTANCES = "SELECT a.t, a.mode, (a.z-b.z)*(a.z-b.z)*9 AS d2 FROM scores a JOIN scores b ON b.run=a.run AND b.t=a.t AND b.mode=(a.mode+1)%64"
SHAPES = {
    "Matern12": "exp(-r)",
    "Matern32": "(1+sqrt(3.0E0)*r)*exp(-sqrt(3.0E0)*r)",
    "Matern52": "(1+sqrt(5.0E0)*r+5.0E0/3*r*r)*exp(-sqrt(5.0E0)*r)",
    "RBF": "exp(-r*r/2)",
    "Exponential": "exp(-r/2)",
}


@query(
    "kernel",
    "SELECT t, mode, " + ", ".join(f"round(1.7E0*{e},6) AS {n.lower()}" for n, e in SHAPES.items()) + f" FROM (SELECT t, mode, sqrt(d2)/0.8E0 AS r FROM ({DISTANCES}) d) q",
)
def _kernel(spark, sf):
    d = run_sql(spark, sf, DISTANCES)
    return rnd(d.select("t", "mode", *[exprs.kernel(n, 1.7, 0.8)("d2").alias(n.lower()) for n in exprs.KERNELS]))
