import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import linkage as L
from tessera.operators import cluster as K
from tessera.operators import matrix as M
from tessera.plans import expression


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 5, 5))])
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").cache()


def test_resamples_hold_their_share_and_fits_follow_lloyd(blobs):
    _, points = blobs
    spread = K._spread(points)
    n = spread.count()
    bounds = K.resample_bounds(spread, 3, 0.8)
    h = np.array([r.h for r in spread.select("h").collect()], dtype="int64").view("uint64")
    for b in range(3):
        u = (K._mixed(h, K.SEED + 77 * (b + 1)) >> np.uint64(1)).astype("int64")
        assert (u <= bounds[b]).sum() == int(0.8 * n)  # without replacement, exactly
    x = np.array([r.x for r in spread.select("x").collect()])
    c = x[:2].copy()
    got, inertia = K.fit_all(spread, [K.Fit(2, 0)], rounds=3, starts=[c.tolist()])[0]
    for _ in range(3):
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        k, last = d2.argmin(1), c
        c = np.array([x[k == j].mean(0) for j in range(2)])
        if ((c - last) ** 2).sum() <= K.TOLERANCE:
            break
    assert np.allclose(got, c) and inertia == pytest.approx(d2.min(1).sum())


def test_fits_on_sent_points_equal_rounds_over_spark(blobs):
    _, points = blobs
    spread = K._spread(points)
    bounds = K.resample_bounds(spread, 2, 0.8)
    fits = [K.Fit(k, 7 * k + run, part) for k in (1, 2, 3, 6) for run in (0, 1) for part in (-1, 0, 1)]
    here, rounds = K.fit_all(spread, fits, bounds), K.fit_all(spread, fits, bounds, local=0)
    for (a, x), (b, y) in zip(here, rounds):
        assert np.allclose(a, b) and x == pytest.approx(y)
    with pytest.raises(ValueError, match="no points"):
        K.fit_all(spread.limit(0), fits)


def test_kmeans_finds_the_groups_and_repeats(blobs):
    x, points = blobs
    centres, inertia = K.kmeans(points, 3, restarts=2)
    truth = np.repeat([0, 1, 2], 30)
    assert inertia == pytest.approx(sum(((x[truth == g] - x[truth == g].mean(0)) ** 2).sum() for g in range(3)))
    assert K.kmeans(points, 3, restarts=2) == (centres, inertia)
    a = K.assign(points, centres).withColumn("truth", F.floor(F.col("id") / 30))
    assert K.ari(a, "cluster", "truth").first().ari == pytest.approx(1)
    mean, sd = K.stability(points, 3, resamples=3, restarts=2)
    assert mean == pytest.approx(1) and sd == pytest.approx(0)


def test_assign_ties_and_empty_clusters(spark):
    p = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [4.0])], "id int, x array<double>")
    assert {r.id: r.cluster for r in K.assign(p, [[0.0], [2.0]]).collect()} == {1: 0, 2: 0, 3: 1}
    centres, inertia = K.kmeans(p, 3, restarts=1)
    assert inertia == 0 and len(centres) == 3


def test_silhouette_and_validity_equal_brute_force(blobs):
    x, points = blobs
    lab = np.arange(90) % 4
    lab[lab == 3] = 2
    lab[0] = 9
    a = points.withColumn("cluster", F.when(F.col("id") == 0, 9).when(F.col("id") % 4 == 3, 2).otherwise(F.col("id") % 4).cast("int"))
    got = {r.id: r.silhouette for r in K.silhouettes(a, tile=20).collect()}
    assert got == pytest.approx({r.id: r.silhouette for r in K.silhouettes(a).collect()}) and len(got) == 90
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(90):
        own = (lab == lab[i]) & (np.arange(90) != i)
        if not own.any():
            assert got[i] == 0
            continue
        p, q = d[i, own].mean(), min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        assert got[i] == pytest.approx((q - p) / max(p, q))
    kinds = sorted(set(lab))
    c = np.array([x[lab == k].mean(0) for k in kinds])
    n = np.array([(lab == k).sum() for k in kinds])
    w = sum(((x[lab == k] - c[j]) ** 2).sum() for j, k in enumerate(kinds))
    ch = (n * ((c - x.mean(0)) ** 2).sum(1)).sum() / (len(kinds) - 1) / (w / (90 - len(kinds)))
    s = [np.sqrt(((x[lab == k] - c[j]) ** 2).sum(1)).mean() for j, k in enumerate(kinds)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(kinds)) if j != i) for i in range(len(kinds))])
    v = K.validity(a, 3).first()
    assert (v.calinski_harabasz, v.davies_bouldin) == (pytest.approx(ch), pytest.approx(db))
    two = a.withColumn("k", F.explode(F.array(F.lit(4), F.lit(5)))).withColumn("cluster", F.when(F.col("k") == 5, F.col("id") % 5).otherwise(F.col("cluster")))
    by = {r.k: r for r in K.validity(two, 3, "k").collect()}
    assert by[4].davies_bouldin == pytest.approx(db) and by[5].calinski_harabasz == pytest.approx(K.validity(two.where("k = 5"), 3).first().calinski_harabasz)
    centres = np.array([x[:30].mean(0), x[30:60].mean(0), x[60:].mean(0)])
    mean = K.silhouettes(K.assign(points, centres.tolist())).agg(F.avg("silhouette")).first()[0]
    assert K.sampled_silhouettes(K._spread(points), {3: centres})[3] == pytest.approx(mean)


def test_evaluate_k_rows(blobs):
    _, points = blobs
    rows = {r.k: r for r in K.evaluate_k(points, range(2, 5), resamples=3, restarts=2, resample_restarts=2).collect()}
    assert max(rows.values(), key=lambda r: r.silhouette).k == 3 and rows[3].stability == pytest.approx(1)
    a = K.assign(points, K.kmeans(points, 3, restarts=2)[0])
    assert rows[3].davies_bouldin == pytest.approx(K.validity(a, 3).first().davies_bouldin)


@pytest.mark.parametrize("method", ["average", "ward"])
def test_linkage_equals_naive(method):
    x = np.random.default_rng(5).normal(size=(25, 3))
    z = L.linkage(L.distances(x), method)
    groups = [[i] for i in range(25)]
    for step in range(24):
        def cost(g, h):
            if method == "average":
                return np.mean([np.linalg.norm(x[i] - x[j]) for i in g for j in h])
            return np.sqrt(2 * len(g) * len(h) / (len(g) + len(h))) * np.linalg.norm(x[g].mean(0) - x[h].mean(0))

        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        assert z[step, 2] == pytest.approx(cost(groups[i], groups[j])) and z[step, 3] == len(groups[i] + groups[j])
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [groups[i] + groups[j]]
        labels = L.cut(z, 24 - step)
        assert all(len({labels[k] for k in g}) == 1 for g in groups) and len(set(labels)) == 24 - step
    assert sorted(L.leaves(z)) == list(range(25))


def test_pca(blobs):
    x, points = blobs
    pcs, share = K.pca(points, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert share == pytest.approx((s**2 / (s**2).sum())[:2])
    got = np.array([r.pc for r in pcs.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs((u * s)[:, :2]))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    rows = [(f"g{i}", f"S{j}", float(0 if i == 0 else 7 if i == 1 else rng.randint(0, 300) * (3 if j > 3 and i % 2 else 1))) for i in range(40) for j in range(1, 7)]
    return rows, spark.createDataFrame(rows, "gene string, sample string, v double").cache()


def test_preprocess(small):
    rows, df = small
    parts = M.preprocess(df)
    kept = {r.gene for r in parts["kept"].select("gene").distinct().collect()}
    assert not kept & {"g0", "g1"} and len(kept) > 30
    x = np.array([[v for g, s, v in rows if g == k] for k in sorted(kept)])
    log = np.log2(x + 1)
    log = log - (np.median(log, 0) - np.median(np.median(log, 0)))
    z = (log - log.mean(1, keepdims=True)) / log.std(1, keepdims=True)
    got = M.to_wide(parts["z"], [f"S{j}" for j in range(1, 7)]).orderBy("gene").collect()
    assert np.array([list(r)[1:] for r in got]) == pytest.approx(z)
    q = M.to_wide(M.normalise(M.log2p1(parts["kept"]), "quantile"), ["S1", "S2"]).collect()
    assert sorted(r.S1 for r in q) == pytest.approx(sorted(r.S2 for r in q))
    const = M.zscore(df.where("gene = 'g1'")).collect()
    assert {r.v for r in const} == {0.0}
    with pytest.raises(ValueError, match="unknown"):
        M.normalise(df, "mean")
    assert M.qc_overall(df).first().n_all_zero == 1


def test_samples(small):
    _, df = small
    log = M.log2p1(M.gene_filter(df))
    wide = M.to_wide(log, M.samples_of(log)).orderBy("gene").collect()
    x = np.array([[v[s] for s in M.samples_of(log)] for v in wide])
    names, d = K.sample_distances(log, False)
    assert names == M.samples_of(log) and d == pytest.approx(1 - np.corrcoef(x.T))
    tree, _ = K.sample_tree(log, False)
    assert [r.height for r in tree.orderBy("step").collect()] == pytest.approx(L.linkage(L.distances(x.T, "correlation"), "average")[:, 2])
    holes = log.where("not (gene = 'g5' and sample = 'S1')")
    assert K.sample_distances(holes, False)[1] == pytest.approx(1 - np.corrcoef(np.array([[v[s] for s in names] for v in wide if v.gene != "g5"]).T))
    r = {(c.s1, c.s2): c.r for c in M.sample_correlation(log).collect()}
    assert r["S1", "S5"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 4])[0, 1]) and r["S2", "S2"] == 1
    co = K.coassignment(log, 2, replicates=30)
    got = {(c.s1, c.s2): (c.support, c.usable) for c in co.collect()}
    assert got["S1", "S1"] == (1.0, 30) and got["S1", "S2"] == got["S2", "S1"]
    labels = {"S1": 1, "S2": 1, "S3": 1, "S4": 2, "S5": 2, "S6": 2}
    s = K.support(co, labels).first()
    assert 0 <= s.between_min <= s.between_max <= 1
    assert K.support(co, {k: i for i, k in enumerate(labels)}).first().within_min is None
    sig = M.signatures(log, labels, 3)
    assert sig.count() == 12 and {x.rank for x in sig.collect()} == {1, 2, 3}
    assert M.signatures(log, labels | {"S6": 3}, 1).where("cluster = 3 and direction = 'up'").count() == 1
    assert [x.k for x in K.evaluate_sample_k(log).orderBy("k").collect()] == [2, 3, 4, 5]


def test_resampled_moments_are_those_of_a_multinomial_draw(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    for block in (4_096, 7):
        rows = {r.r: np.array(r.m) for r in K.resampled_moments(points, 400, block=block).collect()}
        assert rows.keys() == set(range(400)) and all(m[0] == 50 for m in rows.values())
        means = np.array([m[1:4] / 50 for m in rows.values()])
        assert means.mean(0) == pytest.approx(x.mean(0), abs=0.03)
        assert means.std(0) == pytest.approx(x.std(0) / np.sqrt(50), rel=0.15)
        again = {r.r: np.array(r.m) for r in K.resampled_moments(points.repartition(3), 400, block=block).collect()}
        assert all(np.allclose(rows[k], again[k]) for k in rows)


def test_choose_k(spark):
    m = spark.createDataFrame([(2, 0.99, 0.3), (3, 0.8, 0.5), (4, 0.96, 0.34), (5, 0.5, 0.9)], "k int, stability double, silhouette double")
    assert tuple(K.choose_k(m).first()) == (4, 3, True)
    assert tuple(K.choose_k(m.where("k = 5")).first()) == (5, 5, False)


@pytest.mark.parametrize("name", ["assign_centroids", "lloyd_step", "cluster_summaries", "gene_table", "ari", "validity", "silhouette", "cluster_profiles", "gene_sample_bridge", "kmeans_rounds"])
def test_genes_without_a_value_in_every_sample_count_as_in_the_sql(partial, spark, name):
    folder, db = partial
    got = expression.QUERIES[name](spark, folder)
    want = db.execute(f"select {', '.join(f'\"{c}\"' for c in got.columns)} from ({expression.ORACLE[name]})").fetchall()
    key = lambda r: [str(v) for v in r if not isinstance(v, float)]
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, sorted(want, key=key)):
        assert key(a) == key(b) and [v for v in a if isinstance(v, float)] == pytest.approx([v for v in b if isinstance(v, float)], abs=2e-5)


@pytest.fixture(scope="module")
def partial(spark, tmp_path_factory):
    """Tables of 50 genes, most of which lack a sample, and the same in DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    folder = str(tmp_path_factory.mktemp("partial"))
    lines = "/root/testdata/sf0.001/lineitem.parquet"
    spark.read.parquet(lines).where("(l_orderkey % 9 <> l_partkey % 50 % 11)").write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(lines.replace("lineitem", "part")).write.parquet(f"{folder}/part.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return folder, db
