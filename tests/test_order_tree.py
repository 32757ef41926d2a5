"""Running sums, ranks, quantiles, slot scans and trees against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import linkage as L
from tessera.operators import documents as D
from tessera.operators import interpret as T
from tessera.operators import intervals as I
from tessera.operators import order as O
from tessera.operators import tree as R
from tessera.operators.tiles import PAIRS, pairs_of_tiles

HARD = [0.0, -0.0, 1.0, 1.0, 1.0, -1.5, 1e308, -1e308, 5e-324, 3.0, 3.0000000000000004, 7.25, 1e-9, float("inf"), float("-inf")]


def values(seed: int, n: int) -> list[float]:
    r = random.Random(seed)
    return [r.choice([r.gauss(0, 1), r.randint(-3, 3), r.lognormvariate(0, 20), -r.lognormvariate(3, 9), 2.0]) * 1.0 for _ in range(n)]


@pytest.mark.parametrize("slots", [65_536, 5])
def test_quantiles_equal_sorted_lists(spark, monkeypatch, slots):
    monkeypatch.setattr(O, "SLOTS", slots)
    data = {"a": values(1, 500), "b": HARD, "c": [4.0], "d": [2.0] * 60 + [3.0], None: values(2, 21), "e": [1.0 + i * 2**-52 for i in range(40)]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("f", None)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.key, r.share): r.value for r in O.quantiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", shares).collect()}
    assert {k for k, _ in got} == set(data)
    for k, vs in data.items():
        s = sorted(vs)
        for q in shares:
            at = (len(s) - 1) * q
            low = int(at)
            want = s[low] if at == low else s[low] + (s[low + 1] - s[low]) * (at - low)
            assert got[k, q] == want or (np.isnan(got[k, q]) and np.isnan(want)), (k, q)
    assert O.quantiles(spark.createDataFrame([], "key string, v double"), ["key"], "v", shares).count() == 0


def test_describe_leaves_nan_out_and_keeps_empty_columns(spark):
    t = spark.createDataFrame([(1, 2.0, None, "x"), (2, float("nan"), None, "y"), (4, 6.0, None, None)], "a int, b double, c double, s string")
    got = {r.column: r for r in D.describe(t).collect()}
    assert (got["a"].q25, got["a"].q50, got["a"].q75) == (1.5, 2.0, 3.0)
    assert (got["b"]["count"], got["b"].mean, got["b"].q50, got["b"].max) == (2, 4.0, 4.0, 6.0)
    assert (got["c"]["count"], got["c"].mean, got["c"].q50) == (0, None, None)
    assert D.describe(t.limit(0)).count() == 3


def test_running_sums_and_ranks(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), float(r.randint(0, 9)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    got = {x.id: x.rank for x in O.row_numbers(df, ["k"], ["v", "id"]).collect()}
    for k in ("a", "b", None):
        assert [got[i] for _, i in sorted((v, i) for key, v, i in rows if key == k)] == list(range(1, sum(key == k for key, _, _ in rows) + 1))
    assert sorted(x.rank for x in O.row_numbers(df, [], ["id"]).collect()) == list(range(1, 301))
    mean = {(x.k, x.v): (x.n, x.rank) for x in O.average_ranks(df, ["k"], "v").collect()}
    for (k, v), (n, rank) in mean.items():
        below = sum(key == k and w < v for key, w, _ in rows)
        assert n == sum(key == k and w == v for key, w, _ in rows) and rank == below + (n + 1) / 2
    assert O.row_numbers(df.limit(0), ["k"], ["v"]).count() == 0


IV = "k string, s long, e long"


@pytest.mark.parametrize("width", [3, 50, 65_536])
def test_scans_carry_over_slots(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", None]), s := r.randint(-200, 2000), s + r.choice([0, 1, 5, 40, 300])) for _ in range(120)] + [("a", 100, 104)] * 30 + [("b", 5, 9)]
    df = spark.createDataFrame(rows, IV)
    merged = [tuple(x) for x in I.merge(df, ["k"], width).select("k", "s", "e").collect()]
    for k in ("a", "b", None):
        want = []
        for s, e in sorted((s, e) for key, s, e in rows if key == k and e > s):
            if want and s <= want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert sorted([s, e] for key, s, e in merged if key == k) == want
    classed = [(r.randint(0, 2), *x) for x in rows if x[2] > x[1]]
    owner = {}
    for c, k, s, e in classed:
        for p in range(s, e):
            owner[k, p] = min(owner.get((k, p), 9), c)
    got = I.claim(spark.createDataFrame(classed, "cl int, k string, s long, e long"), ["k"], [0, 1, 2], width=width).collect()
    found = [((x.k, p), x.cl) for x in got for p in range(x.s, x.e)]
    assert dict(found) == owner and len(found) == len(owner)
    refs = [(r.choice(["a", None]), r.randint(-300, 2500)) for _ in range(25)]
    asked = [(i, r.choice(["a", None, "z"]), r.randint(-300, 2500)) for i in range(150)] + [(900 + i, "a", 77) for i in range(20)] + [(999, "a", None)]
    near = {x.id: x.distance for x in I.nearest(spark.createDataFrame(asked, "id int, k string, p long"), spark.createDataFrame(refs, "k string, p long"), ["k"], width=width).collect()}
    assert len(near) == len(asked)
    for i, k, p in asked:
        best = None if p is None else min((q for key, q in refs if key == k), key=lambda q: (abs(p - q), q), default=None)
        assert near[i] == (None if best is None else p - best), (i, k, p)


def test_one_chromosome_is_spread_over_slots(spark):
    rows = spark.range(50_000).select(F.lit("c").alias("k"), (F.col("id") * 40).alias("s"), (F.col("id") * 40 + F.when(F.col("id") % 5 == 0, 30).otherwise(60)).alias("e"))
    merged = I.merge(rows, ["k"], 10_000)
    assert merged.count() == 10_001  # every fifth interval ends before the next begins, the first included
    slots = rows.select(I.div("s", 10_000).alias("slot")).groupBy("slot").count()
    assert slots.count() == 200 and slots.agg(F.max("count")).first()[0] == 250
    assert T.GENOME // I.SLOT > 40_000


def naive(x, method):
    groups, heights = [[i] for i in range(len(x))], []
    u = x - x.mean(1, keepdims=True)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    while len(groups) > 1:
        def cost(g, h):
            if method == "average":
                return max(0.0, 1 - float(u[g].mean(0) @ u[h].mean(0)))
            return np.sqrt(2 * len(g) * len(h) / (len(g) + len(h))) * np.linalg.norm(x[g].mean(0) - x[h].mean(0))

        c, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        heights.append((c, sorted(groups[i] + groups[j])))
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [groups[i] + groups[j]]
    return heights


@pytest.mark.parametrize("method", ["ward", "average"])
def test_trees_equal_naive_ones(spark, method):
    x = np.random.default_rng(8).normal(size=(36, 4))
    points = spark.createDataFrame([(f"p{i:02}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, x array<double>")
    want = naive(x, method)
    for local, tile in ((2_000, 2_000), (8, 15)):
        tree, leaves = R.linkage_table(points, method, local, tile)
        members, got = {r.leaf: [r.leaf] for r in leaves.collect()}, tree.orderBy("step").collect()
        assert [r.step for r in got] == list(range(35))
        for r, (height, group) in zip(got, want):
            members[36 + r.step] = members[r.left] + members[r.right]
            assert r.height == pytest.approx(height) and sorted(members[36 + r.step]) == group and r.size == len(group) and r.left < r.right
    z = np.array([[r.left, r.right, r.height, r.size] for r in got])
    for k in (1, 4, 99):
        cut = {r.id: r.cluster for r in R.cut_tree(tree, leaves, k).collect()}
        assert [cut[f"p{i:02}"] for i in range(36)] == L.cut(z, k).tolist()
    order = [r.leaf for r in R.leaf_order(tree, leaves).orderBy("position").collect()]
    assert order == L.leaves(z)
    at = {leaf: (10.0 * i + 5, 0.0) for i, leaf in enumerate(order)}
    brackets = {r.step: r for r in R.dendrogram(tree, leaves).collect()}
    for step, (a, b, h, _) in enumerate(z):
        r = brackets[step]
        assert (r.x_left, r.y_left, r.x_right, r.y_right, r.y) == (*at[a], *at[b], h)
        at[36 + step] = ((at[a][0] + at[b][0]) / 2, h)


def test_trees_of_ties_few_points_and_bad_values(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)] + [(20, [1.0, 3.0])], "id int, x array<double>")
    for local in (0, 100):
        tree, leaves = R.linkage_table(same, local=local)
        assert [r.height for r in tree.orderBy("step").collect()[:8]] == [0.0] * 8 and tree.orderBy("step").collect()[-1].size == 10
        assert {r.id: r.cluster for r in R.cut_tree(tree, leaves, 2).collect()} == {**{i: 0 for i in range(9)}, 20: 1}
    one, leaf = R.linkage_table(same.where("id = 20"))
    assert one.count() == 0 and [tuple(r) for r in R.cut_tree(one, leaf, 3).collect()] == [(20, 0)] and R.dendrogram(one, leaf).count() == 0
    assert R.linkage_table(same.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="finite"):
        R.linkage_table(spark.createDataFrame([(1, [1.0]), (2, [float("nan")])], "id int, x array<double>"))[0].count()
    with pytest.raises(ValueError, match="unknown"):
        R.linkage_table(same, "single")


def test_points_are_not_sent_for_each_two_thousand_others(spark):
    points = spark.range(60_000).withColumn("x", F.array(F.col("id").cast("double")))
    run = lambda a, b, same: pd.DataFrame({"n": [len(a) + len(b)], "pairs": [len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)]})
    got = pairs_of_tiles(points, run, "n long, pairs long").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
    assert got.pairs == 60_000 * 59_999 // 2 and got.n <= 60_000 * (2 + (2 * PAIRS * spark.sparkContext.defaultParallelism) ** 0.5)


def test_trees_over_blocks_equal_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(40, 3)), 3, 0), rng.normal(size=(80, 3)) * 1e-7 + 5])  # alike and nearly alike ones too
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    for method in ("ward", "average"):
        one, many = (R.linkage_table(points, method, local, tile)[0].orderBy("step").collect() for local, tile in ((2_000, None), (50, 300)))
        assert [r.height for r in many] == pytest.approx([r.height for r in one], abs=1e-7) and len(one) == 499
        assert sorted(r.size for r in many) == sorted(r.size for r in one) or method == "average"
