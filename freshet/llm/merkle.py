"""Merkle manifests of a data set that keep only every few levels of their trees.

Rows are leaves, ordered inside their group; every ``fanout`` consecutive nodes
make one node of the next level, until one is left for the group (its subroot).
The subroots, in the order of the groups, make a tree of their own up to the
root.

Only the leaves and each ``every``-th level are kept (checkpoints, as tables in
the shared folder). A proof needs the levels between: for each aligned subtree
of ``fanout ** every`` stored nodes (512 with the defaults) they are made again
from the stored nodes below, give their siblings, and are dropped. So building
and proving hold one such subtree a row and a node is hashed twice at most,
while the kept levels above the leaves have a 512th of the leaves' rows.

All work is done by SQL functions. Positions come from a range partitioned
sort: a task's rows are numbered where they lie, and one summary row for each
(group, partition) adds what stands before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import cut_lineage

FANOUT = 8
EVERY = 3
SIBLINGS = "array<struct<left string, right string>>"


# ---------------------------------------------------------------- digests


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' UTF-8 bytes one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: as a lambda's argument it is not copied to where it is used."""
    return F.transform(F.array(value), body)[0]


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("int")


def _joined(nodes: Column, start: Column, n: Column | int) -> Column:
    """Text of ``n`` nodes from a 0-based place on."""
    return F.array_join(F.slice(nodes, start + 1, n if isinstance(n, Column) else F.lit(n)), "")


def _above(nodes: Column, fanout: int) -> Column:
    """The next level."""
    runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, fanout))
    return F.transform(runs, lambda k: F.sha2(_joined(nodes, k * fanout, fanout), 256))


def _siblings(nodes: Column, i: Column, fanout: int) -> Column:
    first = _div(i, fanout) * fanout
    return F.struct(_joined(nodes, first, i - first).alias("left"), _joined(nodes, i + 1, first + fanout - 1 - i).alias("right"))


# ---------------------------------------------------------------- trees


@dataclass
class Forest:
    """Trees of some groups: ``stored[s]`` has (_g, _pos, _of, node) of level ``s * every``, ``_of`` counting the group's nodes there."""

    stored: list[DataFrame]
    fanout: int
    every: int

    @property
    def block(self) -> int:
        return self.fanout**self.every

    def blocks(self, s: int, extra: Sequence[str] = ()) -> DataFrame:
        """Aligned subtrees of a stored level: (_g, _block, _depth, nodes), nodes in order; ``_depth`` levels lie above."""
        rows = self.stored[s].where("_of > 1")
        depth = F.lit(self.every)
        for k in range(self.every - 1, 0, -1):
            depth = F.when(F.col("_of") <= self.fanout**k, k).otherwise(depth)
        rows = rows.select("_g", F.floor(F.col("_pos") / self.block).alias("_block"), depth.alias("_depth"), F.struct("_pos", "node", *extra).alias("n"))
        return rows.groupBy("_g", "_block").agg(F.first("_depth").alias("_depth"), F.sort_array(F.collect_list("n")).alias("nodes"))

    def _levels(self, nodes: Column, use: Callable[[list[Column]], Column]) -> Column:
        """``use`` of the ``every + 1`` levels that start with ``nodes``, each made once."""

        def go(have: list[Column]) -> Column:
            return use(have) if len(have) > self.every else _let(_above(have[-1], self.fanout), lambda up: go([*have, up]))

        return _let(nodes, lambda low: go([low]))

    def grow(self) -> Forest:
        """Store further levels until each group has one node; the loop's length is the logarithm of the rows."""
        while (self.stored[-1].agg(F.max("_of")).first()[0] or 0) > 1:
            s = len(self.stored) - 1
            of = self.stored[s].where("_of > 1 AND _pos = 0").select("_g", F.ceil(F.col("_of") / self.block).alias("_of"))
            low = F.transform("nodes", lambda x: x["node"])
            top = self._levels(low, lambda have: F.element_at(F.array(*[x[0] for x in have[1:]]), F.col("_depth")))
            up = self.blocks(s).select("_g", F.col("_block").alias("_pos"), top.alias("node")).join(of, "_g")
            self.stored.append(cut_lineage(up.select("_g", "_pos", "_of", "node")))
        return self

    def tops(self) -> DataFrame:
        """(_g, node): the one node that each group ends in."""
        out = self.stored[0].where("_of = 1").select("_g", "node")
        for level in self.stored[1:]:
            out = out.unionByName(level.where("_of = 1").select("_g", "node"))
        return out

    def prove(self, start: DataFrame, carry: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
        """(_g, _pos, node, carry, keep, proof) of the leaves; ``start`` has each group's (_g, keep, proof) from its top on."""
        above: DataFrame | None = None
        for s in range(len(self.stored) - 1, -1, -1):
            extra = list(carry) if s == 0 else []
            done = self.stored[s].where("_of = 1").select("_g", "_pos", "node", *extra).join(start, "_g")
            done = done.select("_g", "_pos", "node", *extra, *keep, "proof")
            if above is not None:
                upper = above.select("_g", F.col("_pos").alias("_block"), *keep, F.col("proof").alias("_upper"))
                own = self.blocks(s, extra).join(upper, ["_g", "_block"])

                def siblings(have: list[Column], i: Column) -> Column:
                    steps = [_siblings(level, _div(i, self.fanout**k), self.fanout) for k, level in enumerate(have[:-1])]
                    return F.slice(F.array(*steps), F.lit(1), F.col("_depth"))

                proofs = self._levels(
                    F.transform("nodes", lambda x: x["node"]),
                    lambda have: F.transform(F.sequence(F.lit(0), F.size(have[0]) - 1), lambda i: siblings(have, i)),
                )
                own = own.select("_g", "_upper", *keep, F.inline(F.arrays_zip("nodes", proofs.alias("own"))).alias("n", "own"))
                own = own.select("_g", "n.*", *keep, F.concat("own", "_upper").cast(SIBLINGS).alias("proof"))
                done = done.unionByName(own)
            above = done
        return above


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_pos`` (from 0 inside ``_g``, by ``order``) and ``_of`` (rows of ``_g``)."""
    ranged = rows.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    kept = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_mid", 33))
    # A row for each (group, partition): the rows of a partition lie together, so these are about as many as partitions and groups.
    runs = kept.groupBy("_g", "_part").agg(F.min("_mid").alias("_lo"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_g", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"), F.sum("_n").over(whole).alias("_of"))
    return kept.join(runs, ["_g", "_part"]).withColumn("_pos", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")


@dataclass
class Manifest:
    """``rows``: the groups' trees, leaves with their carried columns; ``groups``: the tree over their subroots."""

    rows: Forest
    groups: Forest
    carry: list[str]
    root: str | None


def build(
    docs: DataFrame,
    columns: Sequence[str],
    *,
    group: str,
    order: str,
    carry: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
    every: int = EVERY,
) -> Manifest:
    """Leaves of ``columns`` in that sequence, their trees' checkpoints and the root.

    Leaves ascend by ``order`` in each group, nulls first, ties by their digest
    (equal rows are equal leaves, so that their order is of no account). Groups
    go by name, null first, in UTF-8 byte order. ``carry`` names short
    expressions that stay with the leaves. Nulls are leaves' values like others;
    texts may be of any length. Further columns play no part. An empty table
    has no root.
    """
    extra = dict(carry or {})
    name = F.col(f"`{group}`").cast("string")
    leaves = docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("_g"),
        F.col(f"`{order}`").alias("_order"),
        leaf_of([F.col(f"`{c}`") for c in columns]).alias("node"),
        *[c.alias(n) for n, c in extra.items()],
    )
    rows = Forest([_numbered(leaves, ["_order", "node"])], fanout, every).grow()
    subroots = rows.tops().select(F.lit("").alias("_g"), F.col("_g").alias("_name"), "node")
    groups = Forest([_numbered(subroots, ["_name"])], fanout, every).grow()
    last = groups.tops().first()
    return Manifest(rows, groups, ["_order", *extra], last["node"] if last else None)


def prove(manifest: Manifest) -> DataFrame:
    """(order, leaf, carried columns, subroot, root, proof) of every leaf.

    ``proof`` has (left, right) for each level from the leaf to the root: the
    siblings before and behind the node in its run, as one text each.
    """
    top = manifest.groups.stored[0].sparkSession.createDataFrame([("", [])], f"_g string, proof {SIBLINGS}")
    start = manifest.groups.prove(top, carry=["_name"]).select(F.col("_name").alias("_g"), F.col("node").alias("subroot"), "proof")
    found = manifest.rows.prove(start, carry=manifest.carry, keep=["subroot"])
    own = [c for c in manifest.carry if c != "_order"]
    return found.select(F.col("_order").alias("order"), F.col("node").alias("leaf"), *own, "subroot", F.lit(manifest.root).cast("string").alias("root"), "proof")
