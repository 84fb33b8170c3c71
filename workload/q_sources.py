"""Sources, sinks and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.schema import Dataset
from freshet.sources import catalogue, dataset, gather, grids, metric_tables
from workload.q_metrics import WIDE, suite
from workload.registry import query, rnd
from workload.views import run_sql, scratch, table, view


def small_dataset(spark, sf) -> Dataset:
    c = view(spark, sf, "cells")
    keys = ["run", "t", "cell_id"]
    info = view(spark, sf, "cell_info").select(
        "cell_id", F.col("cell_id").alias("lf_cell_id"), "elevation", "area", F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring")
    )
    return Dataset(
        c.select(*keys, F.col("hf").alias("value")), c.select(*keys, F.col("lf").alias("value")), info, view(spark, sf, "ref_lines")
    )


@query("read_dataset", "SELECT run, t, cell_id, round(hf,6) AS value FROM cells WHERE run='click'")
def _read(spark, sf):
    path = scratch(spark)
    dataset.write_dataset(small_dataset(spark, sf), path)
    return rnd(dataset.read_dataset(spark, path).hf.where(F.col("run") == "click"))


@query(
    "write_dataset",
    """SELECT 'hf' AS name, run, count(*) AS n, round(sum(hf)*0.0123457E0,4) AS total FROM cells GROUP BY run
       UNION ALL SELECT 'lf', run, count(*), round(sum(lf)*0.0123457E0,4) FROM cells GROUP BY run
       UNION ALL SELECT 'ref_lines', run, count(*), round(sum(flow)*0.0123457E0,4) FROM ref_lines GROUP BY run
       UNION ALL SELECT 'cell_info', '', count(*), round(sum(area)*0.0123457E0,4) FROM cell_info""",
)
def _write(spark, sf):
    path = scratch(spark)
    dataset.write_dataset(small_dataset(spark, sf), path)
    back = dataset.read_dataset(spark, path)

    def totals(name, df, value):
        return df.groupBy("run").agg(F.count(F.lit(1)).alias("n"), (F.sum(value) * 0.0123457).alias("total")).select(
            F.lit(name).alias("name"), "run", "n", "total"
        )

    out = totals("hf", back.hf, "value").unionByName(totals("lf", back.lf, "value"))
    out = out.unionByName(totals("ref_lines", back.ref_lines, "flow"))
    return rnd(out.unionByName(totals("cell_info", back.cell_info.withColumn("run", F.lit("")), "area")), 4)


@query("materialize", "SELECT run, count(*) AS n, round(sum(lf)*0.0123457E0,4) AS total FROM cells GROUP BY run")
def _materialize(spark, sf):
    path = scratch(spark)
    for _ in range(2):  # the second call finds the first one's tables
        back = dataset.materialize(spark, path, lambda: small_dataset(spark, sf))
    return rnd(back.lf.groupBy("run").agg(F.count(F.lit(1)).alias("n"), (F.sum("value") * 0.0123457).alias("total")), 4)


@query("to_long", "SELECT run, t, CAST(cell_id%10 AS INT) AS cell_id, round(sum(hf),6) AS value FROM cells GROUP BY 1,2,3")
def _to_long(spark, sf):
    cells = view(spark, sf, "cells").withColumn("slot", F.col("cell_id") % 10)
    wide = cells.groupBy("run", "t").pivot("slot", list(range(10))).agg(F.sum("hf"))
    return rnd(dataset.to_long(wide))


@query("from_arrays", "SELECT run, t, CAST(pos AS INT) AS cell_id, round(v,6)+0.0E0 AS value FROM grid")
def _from_arrays(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("run"), F.col("vec_id").cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("vals")
    )
    return rnd(dataset.from_arrays(e, "vals"))


MASK = "SELECT DISTINCT CAST(p_size%8 AS INT) AS row, CAST(p_partkey%8 AS INT) AS col FROM {part} WHERE p_size%3=0"


def rasters(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("run"), F.col("vec_id").cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("vals")
    )


@query(
    "explode_grid",
    """SELECT g.run, g.t, m.row, m.col, m.feature, round(g.v,6)+0.0E0 AS value FROM grid g
       JOIN (SELECT row, col, concat('precip_', CAST(row_number() OVER (ORDER BY row, col)-1 AS VARCHAR)) AS feature FROM ("""
    + MASK + ") q) m ON m.row=7-CAST(floor(g.pos/8.0) AS INT) AND m.col=g.pos%8",
)
def _explode_grid(spark, sf):
    mask = run_sql(spark, sf, MASK)
    return rnd(grids.explode_grid(rasters(spark, sf), 8, 8, flip_y=True, mask=mask))


WANTED = {"inflow": ("Supp-1", "FLOW"), "precip_cum": ("supp-2", "flow-base"), "precip_excess": ("SUPP-33", "FLOW")}


@query(
    "gather_event_series",
    """WITH m AS (SELECT event_id, ord, path, first_time, q,
         CASE WHEN lower(path) LIKE '%supp-1%' AND lower(path) LIKE '%flow%' THEN 1 END AS a,
         CASE WHEN lower(path) LIKE '%supp-2%' AND lower(path) LIKE '%flow-base%' THEN 1 END AS b,
         CASE WHEN lower(path) LIKE '%supp-33%' AND lower(path) LIKE '%flow%' THEN 1 END AS c FROM records),
       p AS (SELECT event_id, 'a' AS label, first_time, q, row_number() OVER (PARTITION BY event_id ORDER BY ord, path) AS rn FROM m WHERE a=1
         UNION ALL SELECT event_id, 'b', first_time, q, row_number() OVER (PARTITION BY event_id ORDER BY ord, path) FROM m WHERE b=1
         UNION ALL SELECT event_id, 'c', first_time, q, row_number() OVER (PARTITION BY event_id ORDER BY ord, path) FROM m WHERE c=1),
       s AS (SELECT event_id, label, first_time AS datetime, q AS v FROM p WHERE rn=1
         UNION ALL SELECT event_id, label, first_time + INTERVAL 1 DAY, q*2 FROM p WHERE rn=1)
       SELECT event_id, datetime, round(max(CASE WHEN label='a' THEN v END),6) AS inflow, round(max(CASE WHEN label='b' THEN v END),6) AS precip_cum,
         round(max(CASE WHEN label='c' THEN v END),6) AS precip_excess FROM s GROUP BY event_id, datetime""",
)
def _gather(spark, sf):
    r = view(spark, sf, "records").select(
        "event_id", "ord", "path",
        F.array(F.col("first_time"), F.col("first_time") + F.expr("INTERVAL 1 DAY")).alias("times"),
        F.array(F.col("q"), F.col("q") * 2).alias("vals"),
    )
    return rnd(gather.gather_event_series(r, WANTED))


@query(
    "filter_keys",
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http.*example.*/') AND url LIKE 'http%' AND url LIKE '%5'",
)
def _filter_keys(spark, sf):
    return gather.filter_keys(table(spark, sf, "pages").select("page_id", "url"), "http*example*/", "5", key="url")


@query(
    "reference_lines",
    f"""SELECT run, t, round(us_flow,6)+0.0E0 AS us_flows, round(us_wse,6) AS us_wse, round(ds_flow,6)+0.0E0 AS ds_flows, round(ds_wse,6) AS ds_wse FROM ({WIDE}) w""",
)
def _lines(spark, sf):
    return rnd(dataset.reference_lines(view(spark, sf, "ref_lines"), ["us", "ds"]))


@query(
    "reference_lines_clipped",
    f"""SELECT w.run, CAST(w.t-c.start AS INT) AS t, round(us_flow,6)+0.0E0 AS us_flows, round(us_wse,6) AS us_wse, round(ds_flow,6)+0.0E0 AS ds_flows, round(ds_wse,6) AS ds_wse
       FROM ({WIDE}) w JOIN line_cuts c ON c.run=w.run WHERE w.t>=c.start AND w.t<c.stop""",
)
def _lines_clipped(spark, sf):
    return rnd(dataset.reference_lines(view(spark, sf, "ref_lines"), ["us", "ds"], view(spark, sf, "line_cuts")))


@query(
    "plans",
    """SELECT 'test' AS part, plan_title, event_number FROM plan_list WHERE type='Test'
       UNION ALL SELECT 'fold_train', plan_title, event_number FROM plan_list WHERE type='Train' AND plan_set='AEP'
       UNION ALL SELECT 'fold_test', plan_title, event_number FROM plan_list WHERE type='Train' AND plan_set='Diverse'""",
)
def _plans(spark, sf):
    p = view(spark, sf, "plan_list").withColumnRenamed("plan_set", "set")
    parts = {"test": catalogue.pick_plans(p, "Test"), "fold_train": catalogue.fold(p, "train"), "fold_test": catalogue.fold(p, "test")}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), "plan_title", "event_number")
        out = df if out is None else out.unionByName(df)
    return out


def catalogues(spark, sf):
    """One small catalogue per customer, as JSON text with two assets."""

    def asset(key, role, label):
        return F.struct(
            F.concat(F.lit("s3://store/"), key.cast("string"), F.lit("/SST.dss")).alias("href"), F.lit("x").alias("type"),
            F.array(role).alias("roles"), key.alias("event_id"), F.struct(label.alias("Set")).alias("properties"),
        )

    c = table(spark, sf, "customer")
    first, second = F.col("c_custkey"), F.col("c_custkey") + 1000000
    role = F.when(F.col("c_nationkey") % 3 == 0, F.lit("Test")).otherwise(F.lit("Train"))
    assets = F.create_map(
        first.cast("string"), asset(first, role, F.col("c_mktsegment")), second.cast("string"), asset(second, F.lit("Train"), F.lit("Max"))
    )
    return c.select(F.to_json(assets).alias("assets"))


@query(
    "catalogue_to_plans",
    """SELECT 'gpr1' AS plan_title, c_custkey AS event_number, CASE WHEN c_nationkey%3=0 THEN 'Test' ELSE 'Train' END AS type, c_mktsegment AS "set",
         's3://store/' || c_custkey || '/SST.dss' AS flow_path, 's3://store/' || c_custkey || '/exported-precip_trinity.p01.tmp.hdf' AS precip_path FROM customer
       UNION ALL SELECT 'gpr2', c_custkey+1000000, 'Train', 'Max', 's3://store/' || (c_custkey+1000000) || '/SST.dss',
         's3://store/' || (c_custkey+1000000) || '/exported-precip_trinity.p01.tmp.hdf' FROM customer""",
)
def _catalogue(spark, sf):
    return catalogue.catalogue_to_plans(catalogues(spark, sf))


@query(
    "plans_to_catalogue",
    """SELECT concat('s3://store/', event_id, '/hydrology/SST.dss') AS href, type AS role, event_id,
       round_even(precip_cum*1.0012345E0,2) AS avg_precip_in, round_even(inflow*1.0012345E0,2) AS peak_inflow_cfs,
       round_even(rp_precip*1.0012345E0,2) AS recurrence_interval_precip, round_even(rp_inflow*1.0012345E0,2) AS recurrence_interval_inflow,
       count(*) FILTER (type='Train') OVER () AS n_train, count(*) FILTER (type='Test') OVER () AS n_test FROM periods""",
)
def _to_catalogue(spark, sf):
    p = view(spark, sf, "periods").withColumn("set", F.lit("AEP"))
    p = p.withColumns({c: F.col(c) * 1.0012345 for c in ("precip_cum", "inflow", "rp_precip", "rp_inflow")})
    numbers = ("avg_precip_in", "peak_inflow_cfs", "recurrence_interval_precip", "recurrence_interval_inflow")
    asset = f"struct<href:string,roles:array<string>,event_id:bigint,properties:struct<{','.join(f'{n}:double' for n in numbers)}>>"
    shape = f"struct<properties:struct<train_event_count:bigint,test_event_count:bigint>,assets:map<string,{asset}>>"
    whole = catalogue.plans_to_catalogue(p, "s3://store").select(F.from_json("catalogue", shape).alias("c"))
    rows = whole.select(F.col("c.properties").alias("p"), F.explode("c.assets").alias("key", "a"))
    a = F.col("a")
    return rows.select(
        a["href"].alias("href"), F.get(a["roles"], 0).alias("role"), F.col("key").cast("long").alias("event_id"), *[a["properties"][n].alias(n) for n in numbers],
        F.col("p.train_event_count").alias("n_train"), F.col("p.test_event_count").alias("n_test"),
    )


@query(
    "write_metrics",
    "SELECT run AS event, round(sqrt(avg((x-y)*(x-y))),6) AS rmse_aoi_toi, round(avg(x-y),6)+0.0E0 AS err_aoi_toi FROM pairs GROUP BY run",
)
def _write_metrics(spark, sf):
    path = scratch(spark)
    tables = suite(spark, sf, cache=True)
    metric_tables.write_metrics(tables, path)
    tables.release()
    return rnd(metric_tables.read_metric(spark, path, "scalar_metrics", ["rmse_aoi_toi", "err_aoi_toi"]))


@query(
    "read_metric",
    "SELECT event, cell_id, rmse_cell_toi, err_cell_toi+0.0E0 AS err_cell_toi FROM cell_metrics WHERE cell_id IN (SELECT CAST(s_suppkey AS INT) FROM supplier WHERE s_suppkey%2=0)",
)
def _read_metric(spark, sf):
    path = scratch(spark)
    view(spark, sf, "cell_metrics").write.parquet(f"{path}/cell_metrics")
    wanted = table(spark, sf, "supplier").where(F.col("s_suppkey") % 2 == 0).select(F.col("s_suppkey").cast("int").alias("cell_id"))
    return rnd(metric_tables.read_metric(spark, path, "cell_metrics", ["rmse_cell_toi", "err_cell_toi"], wanted))
