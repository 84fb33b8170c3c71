"""Connected components of a link table, in rounds of joins that never gather a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import cut_lineage


def _folded(edges: DataFrame) -> DataFrame:
    """Each task replaces its own links by stars of the same connectivity, which shortens long chains.

    A task holds the links it was dealt, not those of one component.
    """

    def fold(batches):
        import pandas as pd

        parent: dict[int, int] = {}

        def root(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent]
        yield pd.DataFrame([(x, r) for x, r in pairs if x != r], columns=["a", "b"], dtype="int64")

    return edges.mapInPandas(fold, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest id reachable from each node that has a link.

    With ``rounds``, no more than so many are made: nodes of one component are
    then still connected, but not all of them may have its number yet.

    ``edges`` has long columns ``a`` and ``b``; links to oneself and links with
    a null end are ignored. Alternates the large-star and small-star steps
    until the links no longer change, so the number of rounds grows with the
    logarithm of the longest path. Every round is kept in the shared folder.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = cut_lineage(_folded(edges).distinct())
    mark = None
    while rounds is None or rounds > 0:
        if rounds is not None:
            rounds -= 1
            now = cut_lineage(_small_star(_large_star(now)))
            continue
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = cut_lineage(_small_star(_large_star(now)))
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))
