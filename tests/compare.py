"""Run every registered query on Spark and on DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

from workload.views import BASE  # noqa: E402


def normal(value):
    if value is None:
        return ("null",)
    if isinstance(value, float):
        if math.isnan(value):
            return ("null",)
        return ("num", repr(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("num", repr(float(value)))
    return ("other", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def kind(name: str) -> str:
    name = name.lower()
    for token, out in (("bigint", "int64"), ("long", "int64"), ("integer", "int32"), ("int", "int32"), ("double", "double"),
                       ("varchar", "str"), ("string", "str"), ("timestamp", "ts"), ("bool", "bool"), ("hugeint", "huge")):
        if name.startswith(token):
            return out
    return name


def connect(sf: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def check(spark, con, sf, name, fn, sql):
    """None when equal, else a short text."""
    df = fn(spark, sf)
    got = df.collect()
    if sql is None:
        return None if len(got) > 0 else "no rows"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {df.columns} vs {want_cols}"
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if types != want_types:
        return f"types { {k: (types[k], want_types[k]) for k in types if types[k] != want_types[k]} }"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if not a:
        return "both empty"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from freshet.session import local_session

    sf = argv[0]
    only = argv[1:]
    spark = local_session(8, 8)
    con = connect(sf)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.perf_counter()
        try:
            problem = check(spark, con, sf, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            problem = "ERROR " + str(e)[:900] if not only else traceback.format_exc()[-3000:]
        spark.catalog.clearCache()
        took = time.perf_counter() - start
        mark = "ok  " if problem is None else "FAIL"
        tag = "" if name in oracles else " (rows only)"
        print(f"{mark} {took:6.2f}s {name}{tag} {problem or ''}", flush=True)
        bad += problem is not None
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
