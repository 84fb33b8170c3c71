"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every candidate, in blocks. A first pass counts
scores in 256 equal bins a query, the bin that holds the k-th best score is cut
into 256 again, and so on until a bin is one score wide. One more pass keeps
the scores above that value and, of the ties, those with the smallest ids.

A task reports only bins from the top down to the one in which it has ``k``
scores itself, as the global k-th score cannot lie below: at most ``k`` counts
a query. Queries go to the tasks in groups of at most about 32,768.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import cut_lineage

BINS = 256
QUERIES_AT_ONCE = 32_768
TILE = (1024, 2048)  # queries and candidates scored at once in a task


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, v) with ``floor(scale * x)`` for each component; rows with a null or non-finite part are left out."""
    x = F.col(f"`{vector}`")
    good = x.isNotNull() & F.col(f"`{vec_id}`").isNotNull()
    good &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = vectors.where(F.coalesce(good, F.lit(False)))
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    """Rows of one length ``dim``; shorter vectors are filled with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    sizes = np.diff(at)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim).astype(kind)
    out = np.zeros((len(column), dim), dtype=kind)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - at[:-1][row]] = flat
    return out


class _Scores:
    """Scores of the queries of a group against the candidates of a task, tile by tile."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind):
        self.ids, self.vectors, self.kind = ids, vectors.astype(kind), kind

    def tiles(self, batches):
        """(first query, scores, candidate ids); candidates ascend by id, and a query's own row scores nothing (mask)."""
        for batch in batches:
            ids = batch.column("id").to_numpy()
            found = _matrix(batch.column("v"), self.vectors.shape[1], self.kind)
            for c in range(0, len(ids), TILE[1]):
                order = np.argsort(ids[c : c + TILE[1]], kind="stable") + c
                own, part = ids[order], np.ascontiguousarray(found[order].T)
                for q in range(0, len(self.ids), TILE[0]):
                    mine = self.ids[q : q + TILE[0]]
                    spot = np.searchsorted(own, mine)
                    self_at = [(i, j) for i in np.flatnonzero(own[np.minimum(spot, len(own) - 1)] == mine) for j in range(spot[i], np.searchsorted(own, mine[i], "right"))]
                    yield q, self.vectors[q : q + TILE[0]] @ part, own, self_at


def _count_pass(scores: _Scores, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray):
    """Counts of the bins that may hold a query's ``need``-th score; scores above the range are not counted."""

    def run(batches):
        n = len(low)
        hist = np.zeros((n, BINS), dtype=np.int64)
        top = low + span
        least = low.copy()
        for q, s, _, own in scores.tiles(batches):
            part = slice(q, q + len(s))
            hit = (s >= least[part, None]) & (s < top[part, None])
            for i, j in own:
                hit[i, j] = False
            row, col = np.nonzero(hit)
            if not len(row):
                continue
            at = (s[row, col].astype(np.int64) - low[part][row]) // width[part][row]
            hist[part] += np.bincount(row * BINS + at, minlength=len(s) * BINS).reshape(len(s), BINS)
            down = np.cumsum(hist[part, ::-1], axis=1)
            full = down[:, -1] >= need[part]
            first = BINS - 1 - np.argmax(down >= need[part, None], axis=1)
            least[part] = np.where(full, low[part] + first * width[part], low[part])
        row, bin_ = np.nonzero(hist)
        keep = low[row] + bin_ * width[row] >= least[row]
        row, bin_ = row[keep], bin_[keep]
        for lo in range(0, len(row), 50_000):
            r, b = row[lo : lo + 50_000], bin_[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(hist[r, b])], names=["q", "bin", "n"])

    return run


def _keep_pass(scores: _Scores, kth: np.ndarray, ties: np.ndarray):
    """Scores above the k-th value, and at it a task's ``ties`` smallest ids a query."""

    def run(batches):
        limit = np.full(len(kth), np.iinfo(np.int64).max)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def pruned():
            q, c, s = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(3))
            equal = s == kth[q]
            order = np.lexsort((c, q, ~equal))
            n = int(equal.sum())
            tq = q[order[:n]]
            rank = np.arange(n) - np.searchsorted(tq, tq)
            keep = np.concatenate((order[:n][rank < ties[tq]], order[n:]))
            last = order[:n][rank == ties[tq] - 1]
            limit[q[last]] = c[last]
            return q[keep], c[keep], s[keep]

        for q, s, ids, own in scores.tiles(batches):
            part = slice(q, q + len(s))
            at_kth = (s == kth[part, None]) & (ids[None, :] <= limit[part, None])
            hit = s > kth[part, None]
            for i, j in own:
                hit[i, j] = at_kth[i, j] = False
            row, col = np.nonzero(at_kth)
            # Candidates ascend by id, so a row's first ties are its smallest ids.
            first = np.arange(len(row)) - np.searchsorted(row, row) < ties[part][row]
            up, right = np.nonzero(hit)
            row, col = np.concatenate((row[first], up)), np.concatenate((col[first], right))
            held.append((row + q, ids[col], s[row, col].astype(np.int64)))
            rows += len(row)
            if rows > 1_000_000:
                held = [pruned()]
                rows = min(len(held[0][0]), 500_000)
        q, c, s = pruned()
        for lo in range(0, len(q), 50_000):
            cut = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(scores.ids[q[cut]]), pa.array(c[cut]), pa.array(s[cut])], names=["query_id", "vec_id", "score"])

    return run


def _one_group(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, most: float, k: int) -> DataFrame:
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    reach = float(norms.max(initial=0)) * most
    if reach >= 2**62:
        raise OverflowError("scores would not fit 64 bits")
    # Partial sums are at most |q||c|, so these types are exact.
    scores = _Scores(ids, vectors, np.float32 if reach < 2**23 else np.float64 if reach < 2**52 else np.int64)
    high = np.ceil(norms * most * (1 + 1e-9)).astype(np.int64) + 1
    low, span = -high, 2 * high + 1
    need = np.full(len(ids), k, dtype=np.int64)
    done = np.zeros(len(ids), dtype=bool)  # fewer than k candidates: all are kept
    while True:
        width = np.maximum(1, -(-span // BINS))
        counts = rows.mapInArrow(_count_pass(scores, low, span, width, need), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
        needs = rows.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(need)], "q int, need long")
        at = counts.withColumn("so_far", F.sum("n").over(down)).join(needs, "q")
        found = at.where("so_far >= need AND so_far - n < need").select("q", "bin", F.expr("so_far - n").alias("above")).collect()
        seen = np.zeros(len(ids), dtype=bool)
        for r in found:
            i = r["q"]
            seen[i] = True
            low[i] += r["bin"] * width[i]
            need[i] -= r["above"]
        done |= ~seen
        low[~seen] = -high[~seen]
        need[~seen] = k
        span = np.where(seen, width, 1)
        if (span == 1).all():
            break
    kth = np.where(done, -high - 1, low)
    return rows.mapInArrow(_keep_pass(scores, kth, need), "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to smaller ids.

    Candidates are all rows but those with the query's id. Components become
    ``floor(scale * x)``. Rows with a null id or a vector that is null or holds
    null or non-finite components take no part; missing components of shorter
    vectors count as zero; of repeated query ids the least vector asks, while
    every repeated row is a candidate. With fewer than ``k`` candidates all are
    returned. Scores beyond 2^62 raise an OverflowError.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, vector, scale)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    facts = rows.agg(F.max(square).alias("most"), F.max(F.size("v")).alias("dim")).first()
    asks = quantised(vectors.where(is_query), vec_id, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    n = asks.count()
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if n:
        groups = -(-n // QUERIES_AT_ONCE)
        dim = max(1, facts["dim"])
        parts = []
        for g in range(groups):
            mine = asks.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).orderBy("id").collect()
            if not mine:
                continue
            held = np.zeros((len(mine), dim), dtype=np.int64)
            for i, r in enumerate(mine):
                held[i, : len(r["v"])] = r["v"]
            part = _one_group(rows, np.array([r["id"] for r in mine], dtype=np.int64), held, math.sqrt(facts["most"]), k)
            parts.append(part if groups == 1 else cut_lineage(part))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
