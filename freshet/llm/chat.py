"""Chat formatting with the collapse of cumulative snapshots, in DataFrame operations only.

Chat systems often log a conversation again after every turn. Each turn's
prefix gets a rolling hash; a conversation whose whole hash is the prefix of a
longer one is dropped by an anti-join, and of equal conversations one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["_pos", "_p0", "_p1", "_p2", "_p3"]


def _turns(turns: DataFrame) -> DataFrame:
    """Positions from 1 in each conversation and the hash of every prefix.

    A prefix hash is the sum of position-dependent turn hashes, as four 32-bit
    lanes, so it rolls forward by additions and cannot overflow.
    """
    base = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = base.withColumn("_pos", F.row_number().over(order))
    one, two = F.xxhash64("_pos", "role", "text"), F.xxhash64(F.lit(7), "text", "role", "_pos")
    low = F.lit(0xFFFFFFFF)
    placed = placed.withColumns({"_h1": one, "_h2": two, "_len": F.count("*").over(Window.partitionBy("conv_id"))})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lanes: list[Column] = [
        F.col("_h1").bitwiseAND(low), F.shiftrightunsigned("_h1", 32), F.col("_h2").bitwiseAND(low), F.shiftrightunsigned("_h2", 32),
    ]
    return placed.select("conv_id", "role", "text", "_pos", "_len", *[F.sum(c).over(so_far).alias(f"_p{i}") for i, c in enumerate(lanes)])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that prefix no longer one, one for each distinct content.

    Of equal conversations the smallest ``conv_id`` stays (a null one only if
    there is no other) and ``n_copies`` counts them all. Turns are ordered by
    turn, role and text; repeated rows count as turns. Null roles and texts are
    empty, null turns come first, and rows with a null ``conv_id`` make one
    conversation.
    """
    t = _turns(turns)
    whole = t.where("_pos = _len").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = t.where("_pos < _len").select(*KEY).distinct()
    return whole.join(inner, KEY, "left_anti").select("conv_id", F.col("_pos").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, *, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations.

    A turn reads ``start role newline text end newline``. Only the turns of one
    conversation are put together; what a conversation has becomes its text.
    """
    kept = maximal_conversations(turns)
    line = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(f"{end}\n"))
    rows = _turns(turns).select("conv_id", F.struct(F.col("_pos").alias("p"), line.alias("s")).alias("t"))
    kept = kept.withColumnRenamed("conv_id", "_c")
    mine = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    text = mine.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    text = text.select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("rendered"))
    return text.join(kept, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "n_turns", "n_copies", "rendered")
