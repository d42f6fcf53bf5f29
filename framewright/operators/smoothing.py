"""Smoothing of per-frame series by kernels with mirrored edges.

A series is cut into blocks with a halo of the kernel's reach; a block is convolved on its own. Positions beyond
an end of the series are mirrored about the edge between samples, which only rows near an end can need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGMA = 40.0
BLOCK = 8192


def gaussian_kernel(sigma: float = SIGMA) -> np.ndarray:
    """Weights over the reach int(4 * sigma + 0.5) to both sides."""
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def skewed_kernel(sigma: float = 60.0, reach: int = 480, skew: float = 0.7) -> np.ndarray:
    """A Gaussian whose positive offsets are weighted by ``skew``; a convolution applies it turned round."""
    x = np.arange(-reach, reach + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    k[x > 0] *= skew
    return (k / k.sum())[::-1]


def mirrored(position: np.ndarray, n: int) -> np.ndarray:
    """Positions within 0..n-1 after any number of mirrorings at the edges."""
    folded = np.mod(position, 2 * n)
    return np.where(folded >= n, 2 * n - 1 - folded, folded)


def smooth(series: DataFrame, key: str, columns: list[str], kernel: np.ndarray, whole_numbers: bool = False, place: str = "place") -> DataFrame:
    """(key, place, columns) with each column convolved along ``place``, which counts each key's rows from 0.

    ``whole_numbers`` cuts the input and the result to whole numbers, as integer arithmetic does. Nulls are
    read as 0. Keys of any length are spread over blocks.
    """
    reach = len(kernel) // 2
    counted = series.groupBy(key).agg((F.max(place) + 1).alias("n"))
    rows = series.join(counted, key)
    # a mirrored position lies within the reach of the end that mirrors it, so these are all blocks that need a row
    low = F.greatest(F.col(place) - reach, F.lit(0))
    high = F.least(F.col(place) + reach, F.col("n") - 1)
    touch = F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))
    spread = rows.select(key, "n", place, *columns, F.explode(touch).alias("block"))

    def convolve(group: pd.DataFrame) -> pd.DataFrame:
        n, block = int(group["n"].iloc[0]), int(group["block"].iloc[0])
        group = group.sort_values(place, kind="stable")
        have = group[place].to_numpy()
        own = np.arange(block * BLOCK, min((block + 1) * BLOCK, n))
        out = {key: np.full(len(own), group[key].iloc[0]), place: own}
        needed = mirrored(np.arange(own[0] - reach, own[-1] + reach + 1), n)
        at = np.minimum(np.searchsorted(have, needed), len(have) - 1)
        for c in columns:
            v = np.nan_to_num(group[c].to_numpy(dtype=float))
            v = np.trunc(v) if whole_numbers else v
            line = np.where(have[at] == needed, v[at], 0.0)
            y = np.convolve(line, kernel[::-1], mode="valid")
            out[c] = np.trunc(y + 1e-9) if whole_numbers else y  # weights that add up to a little less than 1 cut no whole value
        return pd.DataFrame(out)

    kinds = dict(series.dtypes)
    schema = f"{key} {kinds[key]}, {place} long, " + ", ".join(f"{c} double" for c in columns)
    return spread.groupBy(key, "block").applyInPandas(lambda g: convolve(g), schema)


def joint_places(series: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """The rows as one sequence in the given order: ``place`` from 0, counted per video and block and added up, so
    that no task numbers all rows."""
    keyed = series.withColumn("_block", F.floor(F.col(order[-1]) / block))
    counts = keyed.groupBy(*order[:-1], "_block").agg(F.count("*").alias("c"))
    start = counts.withColumn("_start", F.sum("c").over(Window.orderBy(*order[:-1], "_block").rowsBetween(Window.unboundedPreceding, -1))).drop("c")
    within = F.row_number().over(Window.partitionBy(*order[:-1], "_block").orderBy(order[-1])) - 1
    return keyed.withColumn("_in", within).join(start, [*order[:-1], "_block"]).withColumn("place", (F.coalesce("_start", F.lit(0)) + F.col("_in")).cast("long")).drop("_block", "_in", "_start")
