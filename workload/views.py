"""Views that give the test tables the shape of flood data.

One text per view serves Spark and the checking engine; ``{name}`` stands for a
base table. Work grows with the base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from freshet.session import shared_folder, tune
from freshet.sources.dataset import table_exists

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # Levels of both models on every step of a run, for every cell seen in the run.
    "cells": """
        SELECT r.run, r.t, c.cell_id, c.elevation,
          CASE WHEN c.cell_id%10>=8 THEN c.elevation-1 WHEN c.cell_id%10=0 THEN c.elevation+1+coalesce(b.v,0)/10
               ELSE c.elevation+coalesce(b.v,0)/10 END AS hf,
          CASE WHEN c.cell_id%10>=8 THEN c.elevation WHEN c.cell_id%10=0 THEN c.elevation+1+coalesce(b.n,0)*5.0E0+coalesce(b.v,0)/20
               ELSE c.elevation+coalesce(b.n,0)*5.0E0+coalesce(b.v,0)/20 END AS lf
        FROM (SELECT run, q, CAST(row_number() OVER (PARTITION BY run ORDER BY q)-1 AS INT) AS t
              FROM (SELECT DISTINCT event_type AS run, CAST((day(ts)-1)*4+floor(hour(ts)/6.0) AS INT) AS q FROM {events}) s) r
        JOIN (SELECT DISTINCT event_type AS run, CAST(user_id AS INT) AS cell_id, 100.0E0+2*(user_id%10) AS elevation FROM {events}) c
          ON c.run=r.run
        LEFT JOIN (SELECT event_type AS run, CAST(user_id AS INT) AS cell_id,
                     CAST((day(ts)-1)*4+floor(hour(ts)/6.0) AS INT) AS q, avg(value) AS v, count(*) AS n
                   FROM {events} GROUP BY 1,2,3) b
          ON b.run=r.run AND b.q=r.q AND b.cell_id=c.cell_id""",
    "pairs": """
        SELECT run, t, cell_id, greatest(hf-elevation, 0.0E0) AS x, greatest(lf-elevation, 0.0E0) AS y,
          0.1E0+0.0513717E0*abs(lf-elevation) AS s FROM cells""",
    "peaks": "SELECT run, cell_id, max(x) AS px, max(y) AS py FROM pairs GROUP BY run, cell_id",
    "cell_info": """
        SELECT cell_id, min(elevation) AS elevation, 1.0E0+(cell_id%5)*0.5E0 AS area FROM cells GROUP BY cell_id""",
    "storm_ts": """
        SELECT user_id AS event_id, ts AS datetime, value*(1+(user_id%7)/4.0E0) AS inflow,
          (k+value/7)*(1+(user_id%11)/5.0E0) AS precip_cum, k/100 AS precip_excess
        FROM (SELECT *, CAST(regexp_extract(props,'[0-9]+',0) AS DOUBLE) AS k FROM {events}) e""",
    "maxima": "SELECT event_id, max(precip_cum) AS precip_cum, max(inflow) AS inflow FROM storm_ts GROUP BY event_id",
    # Event maxima with return periods in closed form, for operators that take them as given.
    "periods": """
        SELECT event_id, precip_cum, inflow, precip_cum*precip_cum/900 AS rp_precip, inflow*inflow/1500 AS rp_inflow,
          CASE WHEN event_id%3=0 THEN 'Test' ELSE 'Train' END AS type FROM maxima""",
    "hf_mesh": """
        SELECT CAST(p_partkey AS INT) AS cell_id, CAST(p_partkey%50 AS DOUBLE) AS x0, CAST(floor(p_partkey/50.0) AS DOUBLE) AS y0,
          CAST(p_partkey%50 AS DOUBLE)+1 AS x1, CAST(floor(p_partkey/50.0) AS DOUBLE)+1 AS y1, CAST(p_size AS DOUBLE) AS elevation
        FROM {part}""",
    "lf_mesh": """
        SELECT DISTINCT CAST(floor(x0/3)*100000+floor(y0/3) AS INT) AS lf_cell_id, floor(x0/3)*3-0.4E0 AS x0, floor(y0/3)*3-0.3E0 AS y0,
          floor(x0/3)*3+2.6E0 AS x1, floor(y0/3)*3+2.7E0 AS y1 FROM hf_mesh""",
    "centreline": "SELECT cell_id AS near_id, x0, y0, x1, y1 FROM hf_mesh WHERE x0=25",
    "river": """
        SELECT CAST(s_suppkey AS INT) AS ord, (s_suppkey*7)%50+0.37E0 AS x, s_suppkey*0.4E0+0.21E0 AS y FROM {supplier}""",
    "triangles": """
        SELECT a.lf_cell_id*2 AS tri_id, a.lf_cell_id AS a_id, a.x0 AS ax, a.y0 AS ay, b.lf_cell_id AS b_id, b.x0 AS bx, b.y0 AS by,
          c.lf_cell_id AS c_id, c.x0 AS cx, c.y0 AS cy
        FROM lf_mesh a JOIN lf_mesh b ON b.lf_cell_id=a.lf_cell_id+100000 JOIN lf_mesh c ON c.lf_cell_id=a.lf_cell_id+1
        UNION ALL
        SELECT a.lf_cell_id*2+1, a.lf_cell_id, a.x0, a.y0, b.lf_cell_id, b.x0, b.y0, c.lf_cell_id, c.x0, c.y0
        FROM lf_mesh a JOIN lf_mesh b ON b.lf_cell_id=a.lf_cell_id-100000 JOIN lf_mesh c ON c.lf_cell_id=a.lf_cell_id-1""",
    # Low-fidelity levels: line items filed under the mesh cell of their part.
    "lf_levels": """
        SELECT l_returnflag AS run, CAST(month(l_shipdate) AS INT) AS t,
          CAST(floor((l_partkey%50)/3.0)*100000+floor(floor(l_partkey/50.0)/3.0) AS INT) AS cell_id, avg(l_quantity) AS value
        FROM {lineitem} GROUP BY 1,2,3""",
    "ref_lines": """
        SELECT concat('run', CAST((o_orderkey-o_orderkey%2)/2%3 AS INT)) AS run, CAST((o_orderkey-o_orderkey%2)/2 AS INT) AS t,
          CASE WHEN o_orderkey%2=0 THEN 'us' ELSE 'ds' END AS line, o_totalprice/1000-2 AS flow,
          100+sqrt(o_totalprice/1000)+(o_custkey%7)/10.0E0 + CASE WHEN o_orderkey%2=0 THEN 20.0E0 ELSE 0.0E0 END AS wse
        FROM {orders}""",
    "line_cuts": "SELECT run, CAST(min(t)+20 AS INT) AS start, CAST(max(t)-30 AS INT) AS stop FROM ref_lines GROUP BY run",
    "bank": """
        SELECT concat('run', CAST((l_orderkey-l_orderkey%2)/2%3 AS INT)) AS run, CAST((l_orderkey-l_orderkey%2)/2 AS INT) AS t,
          CAST(l_partkey%20 AS INT) AS cell_id, 105+avg(l_quantity)/5 AS value FROM {lineitem} GROUP BY 1,2,3""",
    "records": """
        SELECT l_orderkey AS event_id, CAST(l_linenumber AS INT) AS ord, concat('//SUPP-',CAST(l_suppkey AS VARCHAR(20)),'/',
          CASE WHEN l_returnflag='A' THEN 'FLOW-BASE' ELSE 'FLOW' END,'/01JAN1995-01FEB1995/1HOUR/RUN:SST/') AS path,
          CONCAT('supp-',CAST(l_suppkey AS VARCHAR(20))) AS element, CASE WHEN l_returnflag='A' THEN 'FLOW-BASE' ELSE 'FLOW' END AS param,
          min(l_shipdate) AS first_time, sum(l_quantity) AS q
        FROM {lineitem} GROUP BY 1,2,3,4,5""",
    "boundaries": """
        SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN concat('  bc_supp-',CAST(c_custkey AS VARCHAR(20)),'_base  ') ELSE ' ' END AS bc_line_id,
          CASE WHEN c_custkey%5=0 THEN '' ELSE concat('supp-',CAST(c_custkey AS VARCHAR(20))) END AS area_id FROM {customer}""",
    "plan_list": """
        SELECT concat('gpr',CAST(c_custkey+1 AS VARCHAR(20))) AS plan_title, c_custkey AS event_number,
          CASE WHEN c_nationkey%3=0 THEN 'Test' ELSE 'Train' END AS type,
          CASE c_nationkey%3 WHEN 0 THEN 'Test' WHEN 1 THEN 'AEP' ELSE 'Diverse' END AS plan_set FROM {customer}""",
    "cell_metrics": """
        SELECT run AS event, cell_id, round(sqrt(avg((x-y)*(x-y))),6) AS rmse_cell_toi, round(max(x)-max(y),6) AS err_cell_mts,
          round(avg(x-y),6) AS err_cell_toi, round(avg(s),6) AS conf_cell_toi FROM pairs GROUP BY run, cell_id""",
    # Modes of a made-up reduction: statistics from the data, loadings in closed form.
    "cell_stats": """
        SELECT c.cell_id, CASE WHEN max(c.hf-c.elevation)<0.03E0 THEN 'AD' ELSE 'TF' END AS wetness, min(c.elevation) AS elevation,
          avg(c.hf) AS mean, 1.0E0+(c.cell_id%5)*0.5E0 AS weight FROM cells c GROUP BY c.cell_id""",
    "eof": """
        SELECT mode, cell_id, sin(cell_id*(mode+1)*0.37E0)/10 AS loading
        FROM (SELECT cell_id, 0 AS mode FROM cell_stats WHERE wetness<>'AD' UNION ALL SELECT cell_id, 1 FROM cell_stats WHERE wetness<>'AD'
              UNION ALL SELECT cell_id, 2 FROM cell_stats WHERE wetness<>'AD') m""",
    "mode_stats": """
        SELECT mode, avg(loading) AS mean, stddev_pop(loading) AS std FROM eof GROUP BY mode""",
}

# Views whose text differs between the engines.
SPLIT: dict[str, tuple[str, str]] = {
    "grid": (
        "SELECT CAST(label AS STRING) AS run, CAST(vec_id AS INT) AS t, pos, CAST(v AS DOUBLE) AS v "
        "FROM {embeddings} LATERAL VIEW posexplode(embedding) AS pos, v",
        "SELECT CAST(label AS VARCHAR) AS run, CAST(vec_id AS INT) AS t, CAST(generate_subscripts(embedding,1)-1 AS INT) AS pos, "
        "CAST(unnest(embedding) AS DOUBLE) AS v FROM {embeddings}",
    ),
}
DERIVED: dict[str, str] = {
    # Forcing features on dense steps: two inflows, the other positions are rainfall pixels.
    "forcing": """
        SELECT concat('r', CAST(t%4 AS VARCHAR(9))) AS run, CAST(floor(t/4.0) AS INT) AS t,
          CASE WHEN pos<2 THEN concat('inflow_', CAST(pos AS VARCHAR(9))) ELSE concat('precip_', CAST(pos-2 AS VARCHAR(9))) END AS feature,
          CASE WHEN pos%5=1 AND v<0 THEN 0.0E0 ELSE v END AS value
        FROM grid""",
    "scores": "SELECT run, t, pos AS mode, v AS z, v*v+0.01E0 AS var FROM grid",
    # Mode scores on the steps of the cell table.
    "step_means": "SELECT run, t, avg(hf-elevation) AS a, avg(lf-elevation) AS b FROM cells GROUP BY run, t",
    "step_scores": """
        SELECT run, t, 0 AS mode, a*0.77E0 AS z, a*0.1E0+0.01E0 AS var FROM step_means
        UNION ALL SELECT run, t, 1, b*0.33E0, b*0.1E0+0.02E0 FROM step_means
        UNION ALL SELECT run, t, 2, (a-b)*0.55E0, a*0.05E0+0.03E0 FROM step_means""",
}


# Views that Spark keeps as tables.
STORED = ("cells",)

# The same tables as Spark builds them. Steps are few and go to every task, what a cell has of its own is a
# short map: so no task sorts a whole run, and cells times steps are made where they are written.
STORED_TEXT: dict[str, str] = {
    "cells": """
        WITH e AS (SELECT event_type AS run, CAST(user_id AS INT) AS cell_id, CAST((day(ts)-1)*4+floor(hour(ts)/6.0) AS INT) AS q,
                     avg(value) AS v, count(*) AS n FROM {events} WHERE event_type IS NOT NULL GROUP BY 1,2,3),
             r AS (SELECT run, concat(array_sort(collect_set(q)), if(bool_or(q IS NULL), array(CAST(NULL AS INT)), array())) AS steps
                   FROM (SELECT DISTINCT event_type AS run, CAST((day(ts)-1)*4+floor(hour(ts)/6.0) AS INT) AS q FROM {events}) s GROUP BY run),
             c AS (SELECT run, cell_id, 100.0E0+2*(cell_id%10) AS elevation,
                     map_from_entries(collect_list(CASE WHEN q IS NOT NULL THEN struct(q, struct(v, n)) END)) AS own FROM e GROUP BY run, cell_id),
             x AS (SELECT /*+ BROADCAST(r) */ c.run, c.cell_id, c.elevation, c.own, posexplode(r.steps) AS (t, q) FROM c JOIN r ON r.run=c.run),
             b AS (SELECT run, t, cell_id, elevation, own[q].v AS v, own[q].n AS n FROM x)
        SELECT b.run, b.t, b.cell_id, b.elevation,
          CASE WHEN b.cell_id%10>=8 THEN b.elevation-1 WHEN b.cell_id%10=0 THEN b.elevation+1+coalesce(b.v,0)/10
               ELSE b.elevation+coalesce(b.v,0)/10 END AS hf,
          CASE WHEN b.cell_id%10>=8 THEN b.elevation WHEN b.cell_id%10=0 THEN b.elevation+1+coalesce(b.n,0)*5.0E0+coalesce(b.v,0)/20
               ELSE b.elevation+coalesce(b.n,0)*5.0E0+coalesce(b.v,0)/20 END AS lf
        FROM b""",
}


def _all() -> list[str]:
    return [*VIEWS, *SPLIT, *DERIVED]


def _text(name: str, spark: bool) -> str:
    if name in SPLIT:
        return SPLIT[name][0 if spark else 1]
    text = VIEWS.get(name) or DERIVED[name]
    return text.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING") if spark else text


def _needed(text: str, found: list[str], leaves: tuple[str, ...] = ()) -> list[str]:
    """Views a statement reads, dependencies first; ``leaves`` are not followed."""
    for name in _all():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            if name not in leaves:
                _needed(_text(name, False), found, leaves)
            if name not in found:
                found.append(name)
    return found


def with_views(body: str, spark: bool = False) -> str:
    """Put the views a statement reads in front of it."""
    leaves = STORED if spark else ()
    names = _needed(body, [], leaves)
    ctes = [f"{n} AS ({'SELECT * FROM {' + n + '}' if n in leaves else _text(n, spark)})" for n in names]
    if not ctes:
        return body
    return f"WITH {', '.join(ctes)}, " + body[5:] if body.lstrip().startswith("WITH ") else f"WITH {', '.join(ctes)} {body}"


def oracle(body: str) -> str:
    """Statement for the checking engine."""
    return with_views(body.strip()).replace("AS STRING)", "AS VARCHAR)").format(**{t: t for t in BASE})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PATHS: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """View as a table on disk, written once per session.

    It stands for the aligned data set, which real jobs read from disk as well.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PATHS or not table_exists(spark, _PATHS[key]):
        path = shared_folder(spark)
        _formatted(spark, sf, STORED_TEXT.get(name) or _text(name, True)).write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def _formatted(spark: SparkSession, sf: str, text: str) -> DataFrame:
    used = {t: table(spark, sf, t) for t in BASE if "{" + t + "}" in text}
    used |= {n: stored(spark, sf, n) for n in STORED if "{" + n + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def run_sql(spark: SparkSession, sf: str, body: str) -> DataFrame:
    """Statement over the views and ``{base}`` tables as a DataFrame."""
    tune(spark)
    return _formatted(spark, sf, with_views(body.strip(), spark=True))


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return run_sql(spark, sf, f"SELECT * FROM {name}")


def scratch(spark: SparkSession) -> str:
    """A fresh folder every task can reach."""
    return shared_folder(spark)
