"""Manifests against a tree that keeps every level."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import merkle

COLUMNS = ["doc_id", "source", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h(*[field(row[c]) for c in COLUMNS])


def tree(nodes, fanout):
    """All levels and, for each leaf, its (left, right) siblings."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[k : k + fanout]) for k in range(0, len(low), fanout)])
    proofs = []
    for i in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            lo = i // fanout * fanout
            proof.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + fanout])))
            i //= fanout
        proofs.append(proof)
    return levels[-1][0], proofs


def plain(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort()
        subs[g] = tree([x[2] for x in groups[g]], fanout)
    root, tops = tree([subs[g][0] for g in names], fanout)
    return root, sorted((x[1] if x[0] else -1, x[2], subs[g][0], p + top) for g, top in zip(names, tops, strict=True) for x, p in zip(groups[g], subs[g][1], strict=True))


def got(manifest):
    return sorted((-1 if r["order"] is None else r["order"], r["leaf"], r["subroot"], [tuple(s) for s in r["proof"]]) for r in merkle.prove(manifest).collect())


@pytest.mark.parametrize(("fanout", "every"), [(2, 1), (2, 3), (3, 2), (8, 3)])
def test_against_the_whole_tree(spark, fanout, every):
    rng = random.Random(fanout * 10 + every)
    rows = []
    for g, n in (("en", 71), ("de", 9), (None, 3), ("", 1), ("É", 8), ("z", 1), ("Z", 2), ("a", 1), ("b", 1), ("c", 1)):
        for _ in range(n):
            text = rng.choice([None, "", "tëxt", "w" * rng.randint(0, 50)])
            rows.append({"doc_id": rng.choice([None, *range(100)]), "lang": g, "source": rng.choice([None, "s", "=x"]), "text": text, "node": "clash", "_g": 1})
    rows += [rows[3]] * 40
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, node string, _g int").repartition(7)
    m = merkle.build(df, COLUMNS, group="lang", order="doc_id", fanout=fanout, every=every)
    root, want = plain(rows, fanout)
    assert m.root == root
    assert got(m) == want
    # Only every few levels are kept.
    assert len(m.rows.stored) <= 2 + len(want[-1][3]) // every


def test_long_group_has_three_kept_levels(spark):
    rows = [{"doc_id": i, "lang": "en", "source": None, "text": str(i)} for i in range(5000)] + [{"doc_id": 1, "lang": "de", "source": None, "text": "x"}]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(5)
    m = merkle.build(df, COLUMNS, group="lang", order="doc_id")
    assert [level.count() for level in m.rows.stored] == [5001, 10, 1]
    root, want = plain(rows, 8)
    assert m.root == root and got(m) == want
    proofs = merkle.prove(m).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    assert proofs.where("folded = root").count() == 5001
    changed = proofs.withColumn("folded", merkle.fold(F.lit(leaf(rows[7])), F.col("proof")))
    assert [r["order"] for r in changed.where("folded = root").collect()] == [7]
    digests = {r["order"]: r["d"] for r in proofs.where("subroot <> leaf").select("order", merkle.siblings_digest(F.col("proof")).alias("d")).collect()}
    assert digests == {i: h(*[s for pair in p for s in pair]) for i, lf, sub, p in want if sub != lf}


def test_no_group_rows_in_one_task(spark):
    """One hot group: no exchange of the leaves goes by the group alone, none to a single partition."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    m = merkle.build(df, COLUMNS, group="lang", order="doc_id")
    plan = m.rows.blocks(0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_g#" in plan and "_block" in plan
    assert not [line for line in plan.splitlines() if "SinglePartition" in line and "Broadcast" not in line]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    m = merkle.build(df, COLUMNS, group="lang", order="doc_id")
    assert m.root is None and merkle.prove(m).count() == 0
