"""Hierarchical clustering on DataFrames: reciprocal nearest neighbours, round by round.

Ward's linkage and average linkage of correlations need no distance matrix: a cluster is its size and its mean (of
points, or of points scaled to unit length). In each round every cluster finds its nearest one, over pairs of tiles,
and all pairs that are nearest to each other merge; both linkages are reducible, so the tree is that of one merge at a
time. A few last clusters are merged by a kernel in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.linkage import merges
from tessera.operators.order import row_numbers
from tessera.operators.tiles import blocks, matrix, pairs_of_tiles, squared_distances, squared_of_pairs
from tessera.sources.scratch import cut

#: Clusters that one task merges to the end (their distances are 32 MB).
LOCAL = 2_000
_MERGE = "mid long, lo long, hi long, lo_born long, hi_born long, height double, size long"


def _apart(method: str, a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    x, y = matrix(a), matrix(b)
    if method == "average":
        return np.maximum(1 - x @ y.T, 0)
    m, n = a["size"].to_numpy(float)[:, None], b["size"].to_numpy(float)[None]
    return np.sqrt(2 * m * n / (m + n) * squared_distances(x, y))


class _Least:
    """The nearest of each row so far: by squared height, then by the smaller and the greater name."""

    def __init__(self, n: int):
        self.height, self.lo, self.hi = np.full(n, np.inf), np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")

    def update(self, rows: np.ndarray, height: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        order = np.lexsort((hi, lo, height, rows))
        rows, height, lo, hi = rows[order], height[order], lo[order], hi[order]
        first = np.append(True, rows[1:] != rows[:-1])
        rows, height, lo, hi = rows[first], height[first], lo[first], hi[first]
        of = (self.height[rows], self.lo[rows], self.hi[rows])
        less = (height < of[0]) | (height == of[0]) & ((lo < of[1]) | (lo == of[1]) & (hi < of[2]))
        rows = rows[less]
        self.height[rows], self.lo[rows], self.hi[rows] = height[less], lo[less], hi[less]


def _nearest(clusters: DataFrame, method: str, tile: int | None) -> DataFrame:
    """(name, height, lo, hi) of each cluster's nearest: by distance, then by the smaller and the greater name.

    Matrix products find the candidates, whose distances are then computed one by one.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = a.sort_values("name"), b.sort_values("name")
        x, y, p, q = matrix(a), matrix(b), a["name"].to_numpy(), b["name"].to_numpy()
        m, n = a["size"].to_numpy(float), b["size"].to_numpy(float)
        ward = method != "average"
        single = (m == 1).all() and (n == 1).all()
        times = 2 if ward and not single else 1  # what d lacks of the squared height
        mine, theirs = _Least(len(a)), _Least(len(b))
        for i, j, d, error in blocks(x, y):
            if not ward:
                d = 1 - x[i] @ y[j].T
            elif not single:
                d /= (1 / m[i])[:, None] + (1 / n[j])[None]
            if same and i.start < j.stop and j.start < i.stop:
                at = np.arange(max(i.start, j.start), min(i.stop, j.stop, len(p)))
                d[at - i.start, at - j.start] = np.inf
            for least, size, axis, span in ((mine, m[i], 1, i),) if same else ((mine, m[i], 1, i), (theirs, n[j], 0, j)):
                low = d.min(axis)
                slack = 2 * error * (np.maximum(size, 1) if ward else 1)  # as the greatest weight of a cluster's distances is its size
                may = np.flatnonzero(low <= least.height[span] / times + slack)
                if not len(may):
                    continue
                near = (d[may] if axis else d[:, may].T) <= (low + slack)[may][:, None]
                r, c = np.nonzero(near)
                r, c = (may[r], c) if axis else (c, may[r])
                r, c = r + i.start, c + j.start
                keep = p[r] != q[c]
                r, c = r[keep], c[keep]
                if ward:
                    height = 2 * m[r] * n[c] / (m[r] + n[c]) * squared_of_pairs(x[r], y[c])
                else:
                    height = np.maximum(1 - np.einsum("ij,ij->i", x[r], y[c]), 0)
                if len(r):
                    least.update(r if axis else c, height, np.minimum(p[r], q[c]), np.maximum(p[r], q[c]))
        out = []
        for least, names in ((mine, p), (theirs, q))[: 1 if same else 2]:
            keep = np.isfinite(least.height)
            out.append(pd.DataFrame({"name": names[keep], "height": least.height[keep], "lo": least.lo[keep], "hi": least.hi[keep]}))
        return pd.concat(out)

    found = pairs_of_tiles(clusters.select("name", "size", "x"), run, "name long, height double, lo long, hi long", "name", tile)
    best = found.groupBy("name").agg(F.min(F.struct("height", "lo", "hi")).alias("m")).select("name", "m.*")
    return best if method == "average" else best.withColumn("height", F.sqrt("height"))


def _rest(method: str, step: int):
    """The merges of all clusters that are left, in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name").reset_index(drop=True)
        d = _apart(method, rows, rows)
        d = (d + d.T) / 2
        name, born, size, high = rows["name"].tolist(), rows["born"].astype(object).where(rows["born"].notna(), None).tolist(), rows["size"].tolist(), rows["height"].tolist()
        out = []
        for k, (i, j, h) in enumerate(merges(d, method, np.array(size, dtype=float))):
            if name[i] > name[j]:
                i, j = j, i
            top = max(h, high[i], high[j])
            mid = (step + k) << 40 | name[i]
            out.append((mid, name[i], name[j], born[i], born[j], top, size[i] + size[j]))
            for at in (i, j):  # either may stand for the new cluster from now on
                name[at], born[at], high[at] = out[-1][1], mid, top
                size[at] = out[-1][6]
        got = pd.DataFrame(out, columns=["mid", "lo", "hi", "lo_born", "hi_born", "height", "size"])
        return got.astype({"lo_born": "Int64", "hi_born": "Int64"})

    return run


def linkage_table(points: DataFrame, method: str = "ward", local: int = LOCAL, tile: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(step, left, right, height, size), and (leaf, id): the tree of points (id, x), whose ids are distinct.

    Leaves are numbered by id, the cluster made in a step is n + step, steps go by height. ``ward`` takes Euclidean
    distances, ``average`` 1 - correlation of the points' coordinates (a constant point correlates with none). Points
    with a value that is not finite are an error; fewer than two points have no steps.
    """
    if method not in ("ward", "average"):
        raise ValueError(f"unknown linkage {method!r}")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("coordinates must be finite"))).otherwise(F.col("x"))
    numbered = row_numbers(points.select("id", checked.alias("x")), [], ["id"], "leaf").withColumn("leaf", F.col("leaf") - 1)
    x = F.transform("x", lambda v: v.cast("double"))
    if method == "average":
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        x = F.transform(x, lambda v: v - total(F.col("x")) / F.size("x"))
        norm = F.sqrt(total(F.transform(x, lambda v: v * v)))
        x = F.transform(x, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))
    numbered = cut(numbered.select("leaf", "id", x.alias("x")), "leaves")
    n = numbered.count()
    none = F.lit(None).cast("long")
    clusters = numbered.select(F.col("leaf").alias("name"), F.lit(1).cast("long").alias("size"), "x", none.alias("born"), F.lit(0.0).alias("height"))
    parts, step, left = [], 0, n
    while left > max(1, local):
        near = _nearest(clusters, method, tile)
        pairs = near.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("height").alias("height")).where("n = 2").drop("n")
        a, b = (clusters.select(*[F.col(c).alias(f"{s}_{c}") for c in clusters.columns]) for s in ("a", "b"))
        met = pairs.join(a, F.col("lo") == F.col("a_name")).join(b, F.col("hi") == F.col("b_name"))
        weight = F.col("a_size") + F.col("b_size")
        mean = F.zip_with("a_x", "b_x", lambda p, q: (p * F.col("a_size") + q * F.col("b_size")) / weight)
        met = cut(met.select(
            (F.lit(step << 40) + F.col("lo")).alias("mid"), "lo", "hi", F.col("a_born").alias("lo_born"), F.col("b_born").alias("hi_born"),
            F.greatest("height", "a_height", "b_height").alias("height"), weight.alias("size"), mean.alias("x"),
        ), "merges")
        parts.append(met.drop("x"))
        gone = met.select(F.explode(F.array("lo", "hi")).alias("name"))
        new = met.select(F.col("lo").alias("name"), "size", "x", F.col("mid").alias("born"), "height")
        clusters = cut(clusters.join(gone, "name", "left_anti").select(*new.columns).unionByName(new), "clusters")
        left, step = clusters.count(), step + 1
    if left > 1:
        parts.append(cut(clusters.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(_rest(method, step), _MERGE), "rest"))
    if not parts:
        empty = points.sparkSession.createDataFrame([], "step long, left long, right long, height double, size long")
        return empty, numbered.select("leaf", "id")
    every = row_numbers(reduce(DataFrame.unionByName, parts), [], ["height", "mid"], "step").withColumn("step", F.col("step") - 1)
    every = cut(every, "steps")
    made = every.select(F.col("mid").alias("of"), (F.col("step") + n).alias("number"))
    rows = every.join(made.withColumnsRenamed({"of": "lo_of", "number": "lo_n"}), F.col("lo_born") == F.col("lo_of"), "left")
    rows = rows.join(made.withColumnsRenamed({"of": "hi_of", "number": "hi_n"}), F.col("hi_born") == F.col("hi_of"), "left")
    p, q = F.coalesce("lo_n", "lo"), F.coalesce("hi_n", "hi")
    return cut(rows.select("step", F.least(p, q).alias("left"), F.greatest(p, q).alias("right"), "height", "size"), "tree"), numbered.select("leaf", "id")


def _to_root(up: DataFrame) -> DataFrame:
    """(node, root, way): each node's root by doubling its way up, and the sum of ``way`` along it. up: (node, root, way)."""
    while True:
        next_ = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("way").alias("_w"))
        up = cut(up.join(next_, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.col("way") + F.coalesce("_w", F.lit(0))).alias("way"), F.col("_n").isNotNull().alias("moved")), "up")
        if up.where("moved").isEmpty():
            return up.drop("moved")
        up = up.drop("moved")


def cut_tree(tree: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(id, cluster): the k clusters (fewer if there are fewer leaves) before the last k - 1 steps, numbered by their first leaf."""
    n = leaves.count()
    done = tree.where(F.col("step") < n - k)
    up = done.select(F.explode(F.array("left", "right")).alias("node"), (F.col("step") + n).alias("root"), F.lit(0).cast("long").alias("way"))
    found = _to_root(up)
    rows = leaves.join(found, F.col("leaf") == F.col("node"), "left").select("id", "leaf", F.coalesce("root", "leaf").alias("root"))
    firsts = rows.groupBy("root").agg(F.min("leaf").alias("first"))  # k rows
    numbers = firsts.select(F.col("root").alias("_r"), (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))
    return rows.join(numbers, F.col("root") == F.col("_r")).select("id", "cluster")


def leaf_order(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, id, position): the leaves from left to right. A node's place is the leaves before it, added up on its way to the root."""
    n = leaves.count()
    size = tree.select((F.col("step") + n).alias("_node"), F.col("size").alias("_size"))
    rows = tree.join(size, F.col("left") == F.col("_node"), "left").select("step", "left", "right", F.coalesce("_size", F.lit(1)).alias("before"))
    side = F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit(0).cast("long").alias("way")), F.struct(F.col("right").alias("node"), F.col("before").alias("way"))))
    found = _to_root(rows.select((F.col("step") + n).alias("root"), side.alias("c")).select("c.node", "root", "c.way"))
    return leaves.join(found, F.col("leaf") == F.col("node"), "left").select("leaf", "id", F.coalesce("way", F.lit(0)).alias("position"))


def dendrogram(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(step, x_left, x_right, y_left, y_right, y): each step's bracket; leaves stand at 5, 15, 25, ... and at height 0.

    A round places the steps whose two parts are placed, so there are as many rounds as the tree is deep.
    """
    n = leaves.count()
    placed = leaf_order(tree, leaves).select(F.col("leaf").alias("node"), (10.0 * F.col("position") + 5).alias("x"), F.lit(0.0).alias("y"))
    waiting, out = tree, []
    while not waiting.isEmpty():
        side = lambda s: placed.select(F.col("node").alias(f"{s}_n"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
        met = waiting.join(side("left"), F.col("left") == F.col("left_n")).join(side("right"), F.col("right") == F.col("right_n"))
        met = cut(met.select("step", "x_left", "x_right", "y_left", "y_right", F.col("height").alias("y")), "brackets")
        out.append(met)
        placed = cut(placed.unionByName(met.select((F.col("step") + n).alias("node"), ((F.col("x_left") + F.col("x_right")) / 2).alias("x"), "y")), "placed")
        waiting = cut(waiting.join(met.select("step"), "step", "left_anti"), "waiting")
    if not out:
        return tree.select("step", *[F.lit(0.0).alias(c) for c in ("x_left", "x_right", "y_left", "y_right", "y")])
    return reduce(DataFrame.unionByName, out)
