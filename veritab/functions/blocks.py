"""Pairwise-complete statistics of many columns in one scan, by matrix products over blocks of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_sources
from .types import qc

#: Rows of a block, and tasks whose statistics are added up by one task of the second step.
BLOCK_ROWS, FAN_IN = 8192, 64
#: The statistics of a pair (i, j), over the rows that have both: their number, the mean of i, the squared deviations of i
#: from that mean, and the products of the deviations of both.
NAMES = ("n", "mean", "dev", "prod")


def block_statistics(x: np.ndarray) -> dict[str, np.ndarray]:
    """[c, c] statistics of a block [rows, c] with NaN for missing values. Values are centred at their column's mean in the
    block first, so sums of squares keep their digits however large the values are."""
    there = ~np.isnan(x)
    m = there.astype(float)
    shift = np.where(there, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    z = np.where(there, x - shift, 0.0)
    n = m.T @ m
    total = z.T @ m                                    # sum of i over the rows that have j
    some = np.maximum(n, 1)
    return {"n": n, "mean": shift[:, None] + total / some, "dev": (z * z).T @ m - total ** 2 / some,
            "prod": z.T @ z - total * total.T / some}


def merged(a: dict[str, np.ndarray] | None, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The statistics of the rows of both."""
    if a is None:
        return b
    n = a["n"] + b["n"]
    some = np.maximum(n, 1)
    step = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    both = a["n"] * b["n"] / some
    mean = np.where(a["n"] > 0, a["mean"] + step * b["n"] / some, b["mean"])
    return {"n": n, "mean": mean, "dev": a["dev"] + b["dev"] + step ** 2 * both,
            "prod": a["prod"] + b["prod"] + step * step.T * both}


def _rows(total: dict[str, np.ndarray] | None, group: int):
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *(pa.array([total[k].tobytes()], pa.binary()) for k in NAMES)],
                                         names=["grp", *NAMES])


def pair_statistics(df: DataFrame, cols: Sequence[str]) -> dict[str, np.ndarray]:
    """[c, c] arrays n, mean, dev and prod of all pairs of columns; NULL and NaN are missing. One scan: tasks send one row of
    [c, c] sums each, which a second step adds up by ``FAN_IN``, and the driver the rest."""
    ship_sources(df.sparkSession)
    c = len(cols)
    rows = df.select(F.array(*[F.coalesce(qc(x).cast("double"), F.lit(float("nan"))) for x in cols]).alias("x"))
    schema = "grp int, " + ", ".join(f"{k} binary" for k in NAMES)

    def count(batches):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, c)
            for at in range(0, len(x), BLOCK_ROWS):
                total = merged(total, block_statistics(x[at:at + BLOCK_ROWS]))
        yield from _rows(total, TaskContext.get().partitionId() // FAN_IN)

    def unpacked(batch, i):
        return {k: np.frombuffer(batch.column(k)[i].as_py()).reshape(c, c) for k in NAMES}

    def add(key, table):
        total = None
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                total = merged(total, unpacked(batch, i))
        return pa.Table.from_batches(list(_rows(total, key[0].as_py())))
    parts = rows.mapInArrow(count, schema).groupBy("grp").applyInArrow(add, schema).drop("grp").toLocalIterator()
    total = {k: np.zeros((c, c)) for k in NAMES}
    for r in parts:
        total = merged(total, {k: np.frombuffer(bytes(r[k])).reshape(c, c) for k in NAMES})
    return total


def correlations(stats: dict[str, np.ndarray]) -> np.ndarray:
    """[c, c] Pearson correlations, NaN where a side is constant over the common rows or there are none."""
    spread = stats["dev"] * stats["dev"].T
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(spread > 0, stats["prod"] / np.sqrt(spread), np.nan)
    return np.clip(r, -1.0, 1.0)
