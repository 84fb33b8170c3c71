"""Prefix trie of conversations by adaptive radix trees over fixed-width turn ids.

A turn's id is the first ``WIDTH`` bytes of a SHA-256 of role and text, so a
conversation is a byte key of ``WIDTH`` bytes a turn, most significant first,
and byte order keeps conversations with a common start together. Equal
conversations are one key (merged before any shuffle by key). Distinct keys are
sorted into ranges; a task builds an adaptive radix tree of each range and
emits only the depths that lie between two turns.

Only the nodes on a range's edge that the neighbouring range has as well are
not complete in one tree: the prefixes common to the last key of one and the
first of the next. Their parts (counts, sums over what is complete below) are
added up afterwards; there are at most as many as ranges times that depth.
A frequent first turn is spread over as many ranges as its conversations need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scan import chunk_of, with_next
from freshet.llm.art import Tree, _common
from freshet.session import cut_lineage

WIDTH = 16
RANGE_BYTES = 1 << 20  # keys of a range, about
CHUNK_IDS = 4096  # ids that are joined into one text at once


# ---------------------------------------------------------------- conversations as keys


def turn_id(role: Column, text: Column) -> Column:
    """Upper-case hex of a turn's id."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.upper(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns as (id, bytes of the text), in order.

    Turns are ordered by turn, null first, ties by id. A null role or text is
    empty, repeated rows are turns of their own, and rows without a ``conv_id``
    belong to no conversation. What one conversation has meets in one row, 40
    bytes a turn; texts do not.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("t"),
    )
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("seq"))


def with_shared_heads(convs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Give each conversation the first h turns of conversation ``c - c % every``, then its own behind its first h.

    ``h`` is the CRC-32 of the id's decimal text modulo ``most``. An absent
    conversation gives no turns.
    """
    c = F.col("conv_id")
    own = convs.select("conv_id", "seq", (F.crc32(c.cast("string").cast("binary")) % most).cast("int").alias("h"), (c - c % every).alias("base"))
    heads = convs.where(c % every == 0).select(c.alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    both = own.join(heads, "base", "left")
    empty = F.expr("CAST(array() AS array<struct<id: string, bytes: bigint>>)")
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty), rest).alias("seq"))


# ---------------------------------------------------------------- the trie


def _ends(rows: DataFrame) -> DataFrame:
    """(kid, ends_sha256): digest of the ids of each key's conversations, ascending, comma-joined.

    Runs of ids are joined into texts first; the last step reads a key's texts
    in order and holds one at a time.
    """
    lo, hi, n = rows.agg(F.min("conv_id"), F.max("conv_id"), F.count("*")).first()
    span = CHUNK_IDS * max(1, (hi - lo + 1) // n) if n else 1
    chunks = rows.groupBy("kid", F.floor(F.col("conv_id") / span).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("kid", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("s"))
    ordered = chunks.repartition("kid").sortWithinPartitions("kid", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kid, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for k, s in zip(batch.column("kid").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if k == kid:
                    state.update(b"," + s.encode())
                    continue
                if state is not None:
                    done.append((kid, state.hexdigest()))
                kid, state = k, hashlib.sha256(s.encode())
            yield pa.RecordBatch.from_pydict({"kid": [x[0] for x in done], "ends_sha256": [x[1] for x in done]}, schema=_ENDS)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"kid": [kid], "ends_sha256": [state.hexdigest()]}, schema=_ENDS)

    return ordered.select("kid", "s").mapInArrow(run, "kid string, ends_sha256 string")


_ENDS = pa.schema([("kid", pa.string()), ("ends_sha256", pa.string())])
_NODES = (
    "shared boolean, prefix binary, up binary, turn_id string, conv_id long, depth long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved long, bytes long, ends_sha256 string"
)
_ARROW = pa.schema(
    [("shared", pa.bool_()), ("prefix", pa.binary()), ("up", pa.binary()), ("turn_id", pa.string())]
    + [(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "bytes")]
    + [("ends_sha256", pa.string())]
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _nodes(keys: list[bytes], rows: list[tuple[int, int, list[int], str]], left: int, right: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one range; ``rows`` has (smallest id, conversations, text bytes, ends) of each key.

    ``left`` and ``right`` are the depths down to which the first and the last
    key's path is shared with the neighbours (-1: not at all).
    """
    tree = Tree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    nodes = list(tree.aligned(WIDTH))
    size = len(nodes)
    least, convs = [2**63 - 1] * size, [0] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    shared = [False] * size
    for i, (d, up, some, _) in enumerate(nodes):
        if d <= left and (up < 0 or shared[up]) and keys[some][: WIDTH * d] == keys[0][: WIDTH * d]:
            shared[i] = True
        elif d <= right and (up < 0 or shared[up]) and keys[some][: WIDTH * d] == keys[-1][: WIDTH * d]:
            shared[i] = True
    # Parents come before their children, so backwards every node is whole when it is added to its parent.
    for i in range(size - 1, -1, -1):
        d, up, some, key = nodes[i]
        if key is not None:
            least[i] = min(least[i], rows[key][0])
            convs[i] += rows[key][1]
        if not shared[i]:
            leaves[i] = leaves[i] or 1
            saved[i] += (convs[i] - 1) * (rows[some][2][d - 1] if d else 0)
            if up >= 0:
                children[up] += 1
        if up >= 0:
            least[up] = min(least[up], least[i])
            convs[up] += convs[i]
            if not shared[i] or not shared[up]:
                leaves[up] += leaves[i]
                saved[up] += saved[i]
    # What is complete below a shared node counts for all shared nodes above it: they are added up along `up` later.
    for lo in range(0, size, 8192):
        cut = range(lo, min(size, lo + 8192))
        out: dict[str, list] = {f.name: [] for f in _ARROW}
        for i in cut:
            d, up, some, key = nodes[i]
            above = up >= 0 and shared[up]
            # A node that stands below a shared one learns its parent's smallest id when that is known.
            out["shared"].append(shared[i])
            out["prefix"].append(keys[some][: WIDTH * d] if shared[i] else None)
            out["up"].append(keys[some][: WIDTH * (d - 1)] if above else None)
            out["turn_id"].append(keys[some][WIDTH * (d - 1) : WIDTH * d].hex() if d else None)
            out["conv_id"].append(least[i])
            out["depth"].append(d)
            out["parent_conv_id"].append(least[up] if up >= 0 and not above else None)
            out["n_convs"].append(convs[i])
            out["n_children"].append(children[i])
            out["n_leaves"].append(leaves[i])
            out["saved"].append(saved[i])
            out["bytes"].append(rows[some][2][d - 1] if d else 0)
            out["ends_sha256"].append(rows[key][3] if key is not None else None)
        yield pa.RecordBatch.from_pydict(out, schema=_ARROW)


def trie(sequences: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a node of the prefix trie of (conv_id, seq) rows; ``seq`` as ``conversations`` makes it.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, turn_id): ``conv_id`` is the smallest of the
    node's conversations and names it together with ``depth``; ``turn_id``
    (lower-case hex, null for the root) finds its last turn. Ids must not be
    null. An empty table has no nodes, not even a root.
    """
    key = F.unhex(F.array_join(F.transform("seq", lambda x: x["id"]), ""))
    rows = sequences.select("conv_id", key.alias("key"), F.transform("seq", lambda x: x["bytes"]).alias("sizes"))
    rows = cut_lineage(rows.withColumn("kid", F.sha2("key", 256)))
    total = rows.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    parts = max(1, -(-total // range_bytes))
    merged = rows.groupBy("key", "kid").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.any_value("sizes").alias("sizes"))
    merged = merged.join(_ends(rows.select("kid", "conv_id")), "kid").drop("kid")
    ranged = cut_lineage(merged.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    # One row a range; each tells the next one its last key.
    edges = ranged.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    edges = with_next(edges, "part", chunk_of("part"), ["part", "lo"])
    before = edges.where("next_part IS NOT NULL").select(F.col("next_part").alias("part"), F.col("hi").alias("before"))
    edges = edges.select("part", F.col("next_lo").alias("behind")).join(before, "part", "left")
    placed = ranged.join(edges, "part").repartition(parts, "part").sortWithinPartitions("part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, held, edge = None, [], [], (None, None)

        def done() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            left, right = (_common(k, e) // WIDTH if e is not None else -1 for k, e in zip((keys[0], keys[-1]), edge, strict=True))
            yield from _nodes(keys, held, left, right)

        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("part", "key", "first", "n", "sizes", "ends_sha256", "before", "behind")}
            for k, p in enumerate(c["part"]):
                if p != part:
                    yield from done()
                    part, keys, held, edge = p, [], [], (c["before"][k], c["behind"][k])
                keys.append(c["key"][k])
                held.append((c["first"][k], c["n"][k], c["sizes"][k], c["ends_sha256"][k]))
        yield from done()

    nodes = cut_lineage(placed.mapInArrow(run, _NODES))
    whole = _merged(nodes.where("shared"))
    own = nodes.where("NOT shared").drop("shared", "prefix", "bytes")
    ups = whole.select(F.col("prefix").alias("up"), F.col("conv_id").alias("_up"))
    out = own.unionByName(whole.drop("prefix")).join(ups, "up", "left")
    return out.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "_up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        "turn_id",
    )


def _merged(parts: DataFrame) -> DataFrame:
    """Nodes whose subtrees lie in several ranges, added up."""
    one = parts.groupBy("prefix").agg(
        F.any_value("up").alias("up"),
        F.any_value("turn_id").alias("turn_id"),
        F.min("conv_id").alias("conv_id"),
        F.any_value("depth").alias("depth"),
        F.any_value("parent_conv_id").alias("parent_conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("own_children"),
        F.sum("n_leaves").alias("own_leaves"),
        F.sum("saved").alias("own_saved"),
        F.any_value("bytes").alias("bytes"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    one = one.withColumn("own_saved", F.col("own_saved") + (F.col("n_convs") - 1) * F.col("bytes"))
    # To every shared prefix above it, itself included.
    steps = F.sequence(F.lit(0).cast("long"), F.col("depth"))
    up = one.select(F.explode(F.transform(steps, lambda d: F.substring("prefix", F.lit(1), (d * WIDTH).cast("int")))).alias("prefix"), "own_leaves", "own_saved")
    sums = up.groupBy("prefix").agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved"))
    below = one.where("up IS NOT NULL").groupBy(F.col("up").alias("prefix")).agg(F.count("*").alias("more"))
    out = one.join(sums, "prefix").join(below, "prefix", "left")
    return out.select(
        "prefix",
        "up",
        "turn_id",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        (F.col("own_children") + F.coalesce("more", F.lit(0))).alias("n_children"),
        "n_leaves",
        "saved",
        "ends_sha256",
    )
