"""Is one cluster one cluster? The dip of the distances between its rows, from counts that blocks add up.

Distances are counted on a grid of STEPS from 0 to the diagonal of the bounding box: a pair of blocks is a task, which emits counts, and the table
of counts has at most STEPS + 1 rows whatever the number of rows. The dip of counted values is computed from the convex hulls of their
distribution's lower and upper corners; its chance comes from uniform samples, a block of them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import STRIP, _vectors, block_pairs, blocked

STEPS = 65_536
#: Uniform samples, their size at most (the root of the size times the dip hardly changes beyond), and samples of a task.
SAMPLES, SAMPLE, TOGETHER = 1000, 2000, 50


def hull(x: np.ndarray, y: np.ndarray, lower: bool) -> np.ndarray:
    """Indices of the greatest convex minorant (lower) or the least concave majorant of points in order of x."""
    sign, out = (1.0 if lower else -1.0), []
    for k in range(len(x)):
        while len(out) > 1:
            i, j = out[-2], out[-1]
            if sign * ((y[j] - y[i]) * (x[k] - x[j]) - (y[k] - y[j]) * (x[j] - x[i])) < 0:
                break
            out.pop()
        out.append(k)
    return np.array(out)


def dip(values: np.ndarray, counts: np.ndarray | None = None, width: float = 0.0) -> float:
    """The dip: the least distance of the values' distribution from one of a single mode.

    values ascend and do not repeat; counts tell how often each is there (once). A value stands for a step of width, or of next to nothing, in which its share
    rises evenly, so many equal values may be the mode, as an atom may. No value, or one alone, has dip 0.
    """
    x = np.asarray(values, float)
    n = np.ones(len(x)) if counts is None else np.asarray(counts, float)
    if len(x) < 2:
        return 0.0
    rise = np.minimum(width or np.inf, np.diff(x, append=np.inf).min() * (1.0 if width else 1e-7))
    after = np.cumsum(n) / n.sum()
    x = np.column_stack([x, x + rise]).ravel()
    share = np.column_stack([after - n / n.sum(), after]).ravel()
    x, at = np.unique(x, return_index=True)
    share = share[at]
    low, high, found = 0, len(x) - 1, 0.0
    while True:
        g, m = (low + hull(x[low : high + 1], share[low : high + 1], lower) for lower in (True, False))
        # The gap between the hulls is greatest at a corner of one of them; from there to the next corner of the other is where the mode is.
        at_g, at_m = np.interp(x[g], x[m], share[m]) - share[g], share[m] - np.interp(x[m], x[g], share[g])
        if at_g.max() > at_m.max():
            left = g[at_g.argmax()]
            right = m[np.searchsorted(m, left)]
        else:
            right = m[at_m.argmax()]
            left = g[np.searchsorted(g, right, "right") - 1]
        if max(at_g.max(), at_m.max()) <= found:
            return found / 2
        mine, theirs = np.arange(low, left + 1), np.arange(right, high + 1)
        found = max(found, (share[mine] - np.interp(x[mine], x[g], share[g])).max(), (np.interp(x[theirs], x[m], share[m]) - share[theirs]).max())
        if (left, right) == (low, high) or right <= left:
            return found / 2
        low, high = left, right


def distance_counts(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """(distance, n): how often pairs of points (id, x) have each distance, rounded down to a step of the grid."""
    own, blocks = blocked(points.filter("id is not null and x is not null").select("id", F.col("x").cast("array<double>").alias("x")))
    box = own.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg((F.max("v") - F.min("v")).alias("w")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w")).first()["w"] or 0.0
    width = box / steps if box > 0 else 1.0

    def run(table: pa.Table) -> pa.Table:
        block, x = table.column("block").to_numpy(), _vectors(table.column("x"))
        first = np.flatnonzero(block == block.min())
        other = np.flatnonzero(block != block.min())
        n = np.zeros(steps + 1, np.int64)
        for k in range(0, len(first), STRIP):
            at = first[k : k + STRIP]
            # Within one block a row meets those after it; the other block's rows it meets all.
            cols = first if block.min() == block.max() else other
            d = np.sqrt(((x[at, None] - x[None, cols]) ** 2).sum(axis=2))
            if block.min() == block.max():
                d = d[np.arange(len(cols))[None] > (k + np.arange(len(at)))[:, None]]
            n += np.bincount(np.minimum(steps, (d / width).astype(np.int64)).ravel(), minlength=steps + 1)
        some = np.flatnonzero(n)
        return pa.table({"step": pa.array(some, pa.int64()), "n": pa.array(n[some])})

    # A pair of blocks of which one is empty has nothing between them.
    work = block_pairs(own, blocks, ["x"])
    full = work.groupBy("p", "q").agg(F.count_distinct("block").alias("c")).filter("c = 2 or p = q").select("p", "q")
    found = work.join(full, ["p", "q"], "left_semi").groupBy("p", "q").applyInArrow(run, "step long, n long")
    return found.groupBy("step").agg(F.sum("n").alias("n")).select((F.col("step") * width).alias("distance"), "n")


def uniform_dips(spark, size: int, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """(sample, dip) of uniform samples of a size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"]:
                rng = np.random.default_rng([seed, int(block)])
                k = min(TOGETHER, samples - TOGETHER * int(block))
                yield pd.DataFrame({"sample": TOGETHER * int(block) + np.arange(k), "dip": [dip(np.unique(rng.random(size))) for _ in range(k)]})

    blocks = -(-samples // TOGETHER)
    return spark.range(blocks).repartition(blocks).mapInPandas(run, "sample long, dip double")


def distance_dip(points: DataFrame, steps: int = STEPS, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """One row: n (pairs), dip and p, the share of uniform samples whose dip, times the root of their size, is no less; the pairs count among them.

    Fewer than two pairs have dip 0 and p 1.
    """
    spark = points.sparkSession
    counts = distance_counts(points, steps).orderBy("distance").toPandas()  # at most a row a step
    n = int(counts["n"].sum())
    distance = counts["distance"].to_numpy()
    found = dip(distance, counts["n"].to_numpy(), np.diff(distance).min() if len(distance) > 1 else 0.0)
    if n < 2:
        return spark.createDataFrame([(n, 0.0, 1.0)], "n long, dip double, p double")
    size = min(n, SAMPLE)
    no_less = (F.col("dip") * F.sqrt(F.lit(float(size))) >= found * n**0.5 - 1e-12).cast("int")
    return uniform_dips(spark, size, samples, seed).agg(((F.sum(no_less) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p")).select(F.lit(n).cast("long").alias("n"), F.lit(found).alias("dip"), "p")
