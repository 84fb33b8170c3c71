"""Sums of outer products over rows, the one heavy step of every model here.

Each task adds up its own rows with matrix products; the partial matrices are
then added in two levels, block by block, so no task and not the driver holds
more than a few of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
FAN_IN = 64
PARTIAL = "slot int, block int, salt int, body binary"


def emit(slot: int, matrix: np.ndarray) -> Iterator[tuple]:
    """Row blocks of one partial matrix."""
    salt = TaskContext.get().partitionId() // FAN_IN
    step = max(1, BLOCK_BYTES // max(8, matrix.shape[1] * 8))
    for block, start in enumerate(range(0, matrix.shape[0], step)):
        body = np.ascontiguousarray(matrix[start : start + step], dtype=np.float64)
        yield slot, block, salt, body.tobytes()


def partial_sums(df: DataFrame, accumulate: Callable[[Iterator[pd.DataFrame]], dict[int, np.ndarray]]) -> DataFrame:
    """Run ``accumulate`` once per partition and add up the matrices it returns per slot."""

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for slot, matrix in accumulate(batches).items() for row in emit(slot, matrix)]
        yield pd.DataFrame(rows, columns=["slot", "block", "salt", "body"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["body"].iloc[0], dtype=np.float64).copy()
        for body in group["body"].iloc[1:]:
            total += np.frombuffer(body, dtype=np.float64)
        first = group.iloc[0]
        return pd.DataFrame(
            {"slot": [first["slot"]], "block": [first["block"]], "salt": [0], "body": [total.tobytes()]}
        )

    partials = df.mapInPandas(per_partition, PARTIAL)
    return (
        partials.groupBy("slot", "block", "salt").applyInPandas(add, PARTIAL)
        .groupBy("slot", "block").applyInPandas(add, PARTIAL)
    )


def fetch(sums: DataFrame, columns: int) -> dict[int, np.ndarray]:
    """Bring small summed matrices to the driver."""
    parts: dict[int, dict[int, np.ndarray]] = {}
    for row in sums.collect():
        body = np.frombuffer(bytes(row["body"]), dtype=np.float64).reshape(-1, columns)
        parts.setdefault(row["slot"], {})[row["block"]] = body
    return {slot: np.vstack([blocks[b] for b in sorted(blocks)]) for slot, blocks in parts.items()}


def second_moments(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``sum v v'`` and ``sum v`` of sparse row vectors ``(idx array<int>, val array<double>)``.

    ``size`` is the vector length; the result has ``size**2`` numbers.
    """

    def accumulate(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                dense = np.zeros((len(part), size))
                for i, (idx, val) in enumerate(zip(part["idx"], part["val"])):
                    dense[i, idx] = val
                total[:size] += dense.T @ dense
                total[size] += dense.sum(axis=0)
        return {0: total}

    summed = fetch(partial_sums(rows.select("idx", "val"), accumulate), size)
    total = summed.get(0, np.zeros((size + 1, size)))
    return total[:size], total[size]
