"""All pairs of points, as pairs of tiles: points fall into tiles by a hash of their id, and two tiles meet in one task.

A task works through its two tiles block by block, so its memory does not grow with them. Tiles are as large as leaves
enough pairs for all cores: a point is sent once for each tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a tile: the fewest where there are more, and the most; pairs of tiles for each core.
TILE, LARGE, PAIRS = 2_000, 50_000, 8
#: Points of a block on either side; a task holds the distances of one block (4 MB).
ROWS, COLUMNS = 256, 2_048


def pairs_of_tiles(points: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, key: str = "id", tile: int | None = None) -> DataFrame:
    """run(left, right, same) for each pair of tiles, once; same says that both are one tile. Tiles have about ``tile`` points."""
    count = points.count()
    if tile is None:
        tile = min(LARGE, max(TILE, -(-count // math.isqrt(2 * PAIRS * points.sparkSession.sparkContext.defaultParallelism))))
    n = max(1, -(-count // tile))
    rows = points.withColumn("_t", F.pmod(F.xxhash64(key), F.lit(n)))
    own = lambda: [F.col(c).alias(c) for c in points.columns]  # noqa: E731  columns of its own for each side
    left = rows.select(*own(), F.col("_t").alias("_i"), F.explode(F.sequence(F.col("_t"), F.lit(n - 1).cast("long"))).alias("_j"))
    right = rows.select(*own(), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t"))).alias("_i"), F.col("_t").alias("_j"))

    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a, b, key[0] == key[1])

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(both, schema)


def matrix(rows: pd.DataFrame, column: str = "x") -> np.ndarray:
    return np.array(rows[column].tolist(), dtype=float).reshape(len(rows), -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Over the coordinates that both have."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        apart = (x[:, j, None] - y[None, :, j]) ** 2
        if np.isnan(x[:, j]).any() or np.isnan(y[:, j]).any():
            np.nan_to_num(apart, copy=False)
        out += apart
    return out


def squared_of_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to the same row of y, as in ``squared_distances``."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += np.nan_to_num((x[:, j] - y[:, j]) ** 2)
    return out


def blocks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
    """(rows, columns, squared distances, error): all pairs block by block, by matrix products, and how far off these may be."""
    if np.isnan(x).any() or np.isnan(y).any():
        p, q = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(p, x, 0), np.where(q, y, 0)
        a, b = np.concatenate([x * x, p, -2 * x], 1), np.concatenate([q, y * y, y], 1)
    else:
        one = lambda v: np.ones((len(v), 1))
        norm = lambda v: (v * v).sum(1)[:, None]
        a, b = np.concatenate([norm(x), one(x), -2 * x], 1), np.concatenate([one(y), norm(y), y], 1)
    error = 1e-13 * x.shape[1] * float((x * x).sum(1).max(initial=0) + (y * y).sum(1).max(initial=0))
    b = np.ascontiguousarray(b.T)
    for i in range(0, len(x), ROWS):
        for j in range(0, len(y), COLUMNS):
            yield slice(i, i + ROWS), slice(j, j + COLUMNS), a[i : i + ROWS] @ b[:, j : j + COLUMNS], error
