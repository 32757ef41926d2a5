"""Clustering of vectors (id, x array<double>): k-means, validity measures, stability, samples, PCA.

Points stay in Spark; the centres (k by d numbers) go to the expressions as literals. Small sets of points, of LOCAL
values at most, are sent to all tasks, which then run whole fits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import linkage as L
from tessera.operators.matrix import correlation_distance, sample_correlation, samples_of, to_wide
from tessera.operators.tiles import blocks, matrix, pairs_of_tiles, squared_distances, squared_of_pairs
from tessera.sources.scratch import cut

#: Restarts, those of the chosen k, rounds, tolerance, points of a sampled silhouette, seed.
RESTARTS, FINAL_RESTARTS, ROUNDS, TOLERANCE, SAMPLE, SEED = 10, 50, 300, 1e-8, 4_000, 20260726
#: Values (points times coordinates) that are sent to every task: 16 MB.
LOCAL = 2_000_000


def vectors(rows: DataFrame, samples: list[str] | None = None, whole: bool = True) -> DataFrame:
    """(id, x) from a long matrix, samples in order; genes without a value in every sample are left out, or have nulls there."""
    names = samples or samples_of(rows)
    wide = to_wide(rows, names)
    return (wide.dropna(subset=names) if whole else wide).select(F.col("gene").alias("id"), F.array(*[F.col(s) for s in names]).alias("x"))


def squared(x: Column, c: list[float | None]) -> Column:
    """Squared distance over the coordinates that both have; null without one."""
    apart = [F.get(x, j) - F.lit(float(v)) for j, v in enumerate(c) if v is not None]
    if not apart:
        return F.lit(None).cast("double")
    return F.when(F.coalesce(*apart).isNotNull(), sum((F.coalesce(a * a, F.lit(0.0)) for a in apart), F.lit(0.0)))


def assign(points: DataFrame, centres: list[list[float | None]]) -> DataFrame:
    """points with cluster and d2 (squared distance) of the nearest centre, the first if tied; null without a coordinate in common."""
    near = [(squared(F.col("x"), c), k) for k, c in enumerate(centres)]
    best = F.array_min(F.array(*[F.when(d2.isNotNull(), F.struct(d2.alias("d2"), F.lit(k).alias("k"))) for d2, k in near]))
    return points.withColumn("_b", best).withColumns({"cluster": F.col("_b")["k"], "d2": F.col("_b")["d2"]}).drop("_b")


def means(assigned: DataFrame, d: int) -> DataFrame:
    """(cluster, n, x, held): the mean of each cluster, and how many of its points have each coordinate."""
    x = [F.get("x", j) for j in range(d)]
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.avg(v) for v in x]).alias("x"), F.array(*[F.count(v) for v in x]).alias("held"))


def lloyd_step(points: DataFrame, centres: list[list[float | None]]) -> DataFrame:
    return means(assign(points, centres).where("cluster is not null"), len(centres[0]))


class Fit(NamedTuple):
    """One run of Lloyd's method: k centres, the seed of its start, and its points (all, or the resample of that number)."""

    k: int
    seed: int
    part: int = -1


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned 64-bit hashes of the hashes h and a seed."""
    x = h + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _spread(points: DataFrame) -> DataFrame:
    """(id, x, h) dealt over all cores and kept there, as every round reads them; h is a hash of the id."""
    rows = points.select("id", "x", F.xxhash64("id").alias("h"))
    return rows.repartition(points.sparkSession.sparkContext.defaultParallelism, "id").persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(batches):
    for b in batches:
        if len(b):
            yield np.array(b["x"].tolist(), dtype=float), b["h"].to_numpy().astype("int64").view("uint64")


def resample_bounds(spread: DataFrame, resamples: int, share: float, seed: int = SEED) -> dict[int, int]:
    """For each resample the hash below which floor(share * n) of the points lie: a draw without replacement.

    Hashes are counted in 65,536 ranges; only the range of the cut is ordered.
    """

    def run(batches):
        for _, h in _blocks(batches):
            for r in range(resamples):
                yield pd.DataFrame({"r": r, "u": (_mixed(h, seed + 77 * (r + 1)) >> np.uint64(1)).astype("int64")})

    u = spread.mapInPandas(run, "r int, u long").withColumn("bin", F.shiftright("u", 47))
    bins = u.groupBy("r", "bin").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("r").orderBy("bin"))  # 65,536 rows a resample
    wanted = F.floor(F.sum("m").over(Window.partitionBy("r")) * share + 1e-9)
    bins = bins.select("r", "bin", (wanted - (upto - F.col("m"))).alias("left"), (wanted - upto).alias("over")).where("left > 0 and over <= 0").drop("over")
    inside = u.join(bins, ["r", "bin"]).withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("u")))
    return {x.r: x.u for x in inside.where(F.col("k") == F.col("left")).select("r", "u").collect()}


def _member(h: np.ndarray, part: int, bounds: dict[int, int], seed: int) -> np.ndarray:
    return np.ones(len(h), bool) if part < 0 else (_mixed(h, seed + 77 * (part + 1)) >> np.uint64(1)).astype("int64") <= bounds[part]


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points and centres over the coordinates that both have; infinite without one."""
    if not (np.isnan(x).any() or np.isnan(c).any()):
        return ((x[:, None, :] - c[None]) ** 2).sum(2)
    p, q = ~np.isnan(x), ~np.isnan(c)
    return np.where(p.astype(float) @ q.T > 0, np.nansum((x[:, None, :] - c[None]) ** 2, 2), np.inf)


def _fit_here(x: np.ndarray, h: np.ndarray, fit: Fit, bounds: dict[int, int], rounds: int, seed: int, start: list[list[float]] | None) -> tuple[np.ndarray, float]:
    """One whole fit on points at hand: the draws, rounds and rules of ``fit_all``."""
    inside = _member(h, fit.part, bounds, seed)
    x, h = x[inside], h[inside]
    centres = [np.array(c, dtype=float) for c in start or []]
    d2 = np.ones(len(x))
    for step in range(len(centres), fit.k if start is None else 0):
        u = ((_mixed(h, fit.seed + step) >> np.uint64(11)) + 0.5) / float(1 << 53)
        with np.errstate(divide="ignore"):
            wait = np.where(d2 > 0, -np.log(u) / d2, np.inf)
        centres.append(x[np.lexsort((u, wait))[0]])
        new = ((x - centres[-1]) ** 2).sum(1)
        d2 = new if step == 0 else np.minimum(d2, new)
    held, inertia = np.array(centres), float("inf")
    whole = ~np.isnan(x)
    filled, norm = np.where(whole, x, 0), np.nansum(x * x, 1)
    gaps = not whole.all()
    rows = np.arange(len(x))
    for _ in range(rounds):
        odd = gaps or np.isnan(held).any()
        k = (_apart(x, held) if odd else norm[:, None] - 2 * (x @ held.T) + (held * held).sum(1)).argmin(1)
        least = (np.nansum if odd else np.sum)((x - held[k]) ** 2, 1)
        member = np.zeros((len(x), len(held)))
        member[rows, k] = 1
        m = member.sum(0)
        n = member.T @ whole if gaps else m[:, None]
        moved = np.where(n > 0, (member.T @ filled) / np.maximum(n, 1), held)
        if not m.all():  # an empty cluster moves to the point served worst among those of the other clusters
            worst = sorted((int(np.flatnonzero(k == c)[least[k == c].argmax()]) for c in np.flatnonzero(m)), key=lambda i: -least[i])
            for c in np.flatnonzero(m == 0):
                if worst:
                    moved[c] = x[worst.pop(0)]
        inertia = float(least.sum())
        done = ((moved - held) ** 2).sum() <= TOLERANCE
        held = moved
        if done:
            break
    return held, inertia


def _fit_local(spread: DataFrame, fits: list[Fit], bounds: dict[int, int], rounds: int, seed: int, starts: list[list[list[float]]] | None) -> list[tuple[np.ndarray, float]]:
    """The fits of a small set of points: the points go to every task, a task runs whole fits."""
    spark = spread.sparkSession
    pdf = spread.toPandas().sort_values("h")  # LOCAL values at most
    data = spark.sparkContext.broadcast((matrix(pdf), pdf["h"].to_numpy().astype("int64").view("uint64")))

    def run(batches):
        x, h = data.value
        for b in batches:
            for n in b["id"]:
                centres, inertia = _fit_here(x, h, fits[n], bounds, rounds, seed, starts[n] if starts else None)
                yield pd.DataFrame({"n": [n], "centres": [centres.tolist()], "inertia": inertia})

    dealt = spark.range(len(fits)).repartition(min(len(fits), 4 * spark.sparkContext.defaultParallelism))  # large k next to small
    got = dealt.mapInPandas(run, "n long, centres array<array<double>>, inertia double").collect()  # k by d numbers a fit
    data.unpersist()
    of = {r.n: (np.array(r.centres), r.inertia) for r in got}
    return [of[n] for n in range(len(fits))]


def fit_all(spread: DataFrame, fits: list[Fit], bounds: dict[int, int] | None = None, rounds: int = ROUNDS, seed: int = SEED, starts: list[list[list[float]]] | None = None, local: int = LOCAL) -> list[tuple[np.ndarray, float]]:
    """Centres and inertia of each fit.

    Points of up to ``local`` values are sent to all tasks, each of which runs whole fits. More are not sent: all fits
    advance by the same Spark jobs, and a round is one pass over the points: tasks give partial sums for each fit and
    cluster, Spark adds them up, and what reaches the driver has one row for each cluster of a fit not yet done,
    whatever the number of points. Both ways draw and count alike. Starts are drawn with weight the squared distance to
    those drawn before, by exponential keys, unless given. An empty cluster moves to the point served worst.
    """
    size = spread.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size.n:
        raise ValueError("there are no points")
    if size.n * size.d <= local:
        return _fit_local(spread, fits, bounds or {}, rounds, seed, starts)
    bounds = bounds or {}
    centres: list[list[np.ndarray]] = [[np.array(c, dtype=float) for c in s] for s in starts] if starts else [[] for _ in fits]

    def member(h: np.ndarray, part: int, kept: dict[int, np.ndarray]) -> np.ndarray:
        if part not in kept:
            kept[part] = _member(h, part, bounds, seed)
        return kept[part]

    for step in range(0 if starts else max((f.k for f in fits), default=0)):
        now = [(n, f, centres[n][:]) for n, f in enumerate(fits) if f.k > step]

        def draw(batches, now=now, step=step):
            for x, h in _blocks(batches):
                kept: dict[int, np.ndarray] = {}
                out = []
                for n, f, c in now:
                    inside = np.flatnonzero(member(h, f.part, kept))
                    if not len(inside):
                        continue
                    u = ((_mixed(h[inside], f.seed + step) >> np.uint64(11)) + 0.5) / float(1 << 53)
                    d2 = np.ones(len(inside)) if not c else np.min([((x[inside] - v) ** 2).sum(1) for v in c], axis=0)
                    with np.errstate(divide="ignore"):
                        wait = np.where(d2 > 0, -np.log(u) / d2, np.inf)
                    best = np.lexsort((u, wait))[0]
                    out.append((n, wait[best], u[best], x[inside[best]]))
                yield pd.DataFrame(out, columns=["n", "wait", "u", "x"])

        got = spread.mapInPandas(draw, "n int, wait double, u double, x array<double>").groupBy("n").agg(F.min_by("x", F.struct("wait", "u")).alias("x")).collect()
        if not got:
            raise ValueError("there are no points")
        for r in got:
            centres[r.n].append(np.array(r.x))
    held = [np.array(c) for c in centres]
    inertia = [float("inf")] * len(fits)
    active = set(range(len(fits)))
    for _ in range(rounds):
        if not active:
            break
        now = [(n, fits[n].part, held[n]) for n in sorted(active)]

        def add(batches, now=now):
            for x, h in _blocks(batches):
                kept: dict[int, np.ndarray] = {}
                out = []
                for n, part, c in now:
                    inside = member(h, part, kept)
                    y = x[inside]
                    d2, gaps = _apart(y, c), np.isnan(y).any()
                    k = d2.argmin(1)
                    least = d2[np.arange(len(y)), k]
                    for j in np.unique(k):
                        mine = np.flatnonzero(k == j)
                        far = mine[least[mine].argmax()]
                        out.append((n, int(j), (~np.isnan(y[mine])).sum(0) if gaps else np.full(y.shape[1], len(mine)), float(least[mine].sum()), (np.nansum if gaps else np.sum)(y[mine], 0), float(least[far]), y[far]))
                yield pd.DataFrame(out, columns=["n", "c", "m", "d2", "s", "far", "worst"])

        d = held[now[0][0]].shape[1]
        part = spread.mapInPandas(add, "n int, c int, m array<long>, d2 double, s array<double>, far double, worst array<double>")
        added = [F.array(*[F.sum(F.get(v, j)) for j in range(d)]).alias(v) for v in ("m", "s")]
        got = part.groupBy("n", "c").agg(F.sum("d2").alias("d2"), *added, F.max("far").alias("far"), F.max_by("worst", F.struct("far", "worst")).alias("worst")).collect()
        of: dict[int, list] = {}
        for r in got:
            of.setdefault(r.n, []).append(r)
        for n in list(active):
            rows = of.get(n, [])
            new = {r.c: np.where(np.array(r.m) > 0, np.array(r.s) / np.maximum(r.m, 1), held[n][r.c]) for r in rows}
            worst = sorted(rows, key=lambda r: -r.far)
            for empty in [c for c in range(fits[n].k) if c not in new]:
                new[empty] = np.array(worst.pop(0).worst) if worst else held[n][empty]
            moved = np.array([new[c] for c in range(fits[n].k)])
            inertia[n] = float(sum(sorted(r.d2 for r in rows)))
            if ((moved - held[n]) ** 2).sum() <= TOLERANCE:
                active.discard(n)
            held[n] = moved
    return list(zip(held, inertia, strict=True))


def _best(fits: list[Fit], got: list[tuple[np.ndarray, float]]) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """The run of least inertia, the first if tied, of each (k, part)."""
    best: dict = {}
    for f, g in zip(fits, got, strict=True):
        if (f.k, f.part) not in best or g[1] < best[f.k, f.part][1]:
            best[f.k, f.part] = g
    return best


def _runs(k: int, restarts: int, seed: int, part: int = -1) -> list[Fit]:
    return [Fit(k, seed + 1000 * run, part) for run in range(restarts)]


def kmeans(points: DataFrame, k: int, restarts: int = RESTARTS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[list[list[float]], float]:
    """Centres and inertia of the best of several runs of Lloyd's method from drawn starts, all runs in one job a round."""
    spread = _spread(points)
    fits = _runs(k, restarts, seed)
    centres, inertia = _best(fits, fit_all(spread, fits, rounds=rounds))[k, -1]
    spread.unpersist()
    return centres.tolist(), inertia


def ari(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (ari): adjusted Rand index of two labellings of the same rows; 1 where both are trivial."""
    return ari_of_cells(pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")))


def ari_of_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, ari) from (keys, a, b, n): how many rows have label a in the one labelling and b in the other."""
    two = lambda n: n * (n - 1) / 2
    margin = lambda side, name: cells.groupBy(*keys, side).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two(F.col("n"))).alias(name))
    t = cells.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    for other in (margin("a", "ra"), margin("b", "rb")):
        t = t.join(other, list(keys)) if keys else t.crossJoin(other)  # one row each
    e = F.col("ra") * F.col("rb") / F.nullif(two(F.col("n")), F.lit(0.0))
    top, bottom = F.col("s") - e, (F.col("ra") + F.col("rb")) / 2 - e
    return t.select(*keys, F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def silhouettes(assigned: DataFrame, tile: int | None = None) -> DataFrame:
    """(id, cluster, silhouette) of every point, whose ids are distinct; 0 for the only point of its cluster.

    Sums of distances by (point, cluster) come from pairs of tiles and are added up by Spark.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = matrix(a), matrix(b)
        kinds, member = [], []
        for side in (a, b):
            k, at = np.unique(side["cluster"].to_numpy(), return_inverse=True)
            kinds.append(k)
            member.append((at[:, None] == np.arange(len(k))).astype(float))
        sums = [np.zeros((len(a), len(kinds[1]))), np.zeros((len(b), len(kinds[0])))]
        for i, j, d, error in blocks(x, y):
            p, q = np.nonzero(d < 1e6 * error)  # where the product is not exact enough
            d[p, q] = squared_of_pairs(x[i][p], y[j][q])
            np.sqrt(d, out=d)
            sums[0][i] += d @ member[1][j]
            if not same:
                sums[1][j] += d.T @ member[0][i]
        out = []
        for mine, k, s in ((a, kinds[1], sums[0]), (b, kinds[0], sums[1]))[: 1 if same else 2]:
            n = len(k)
            out.append(pd.DataFrame({"id": np.repeat(mine["id"].to_numpy(), n), "cluster": np.repeat(mine["cluster"].to_numpy(), n), "other": np.tile(k, len(mine)), "s": s.ravel()}))
        return pd.concat(out)

    kind = assigned.schema["id"].dataType.simpleString()
    assigned = cut(assigned.select("id", "x", F.col("cluster").cast("int").alias("cluster")), "assigned")
    parts = pairs_of_tiles(assigned, run, f"id {kind}, cluster int, other int, s double", "id", tile)
    sizes = assigned.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("_n"))
    sums = parts.groupBy("id", "cluster", "other").agg(F.sum("s").alias("s")).join(sizes, F.col("other") == F.col("_c"))
    own = F.col("cluster") == F.col("other")
    per = sums.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("_n"))).alias("n"), F.max(F.when(own, F.col("s") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("_n"))).alias("b")
    )
    value = (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))
    return per.select("id", "cluster", F.when((F.col("n") > 1) & F.col("b").isNotNull(), value).otherwise(0.0).alias("silhouette"))


def sampled_silhouettes(spread: DataFrame, centres: dict[int, np.ndarray], most: int = SAMPLE) -> dict[int, float]:
    """Mean silhouette, for each k, of at most ``most`` points (chosen by the hash of their id) among themselves.

    The distances are computed once for all k. The sample goes to each task, which compares its points with it.
    """
    spark = spread.sparkSession
    sample = spread.orderBy("h", "id").limit(most)
    x = matrix(sample.toPandas())  # ``most`` rows at most
    data = spark.sparkContext.broadcast(x)
    labels = {k: squared_distances(x, c).argmin(1) for k, c in centres.items()}

    def run(batches):
        for b in batches:
            at = b["id"].to_numpy()
            d = np.sqrt(squared_distances(data.value[at], data.value))
            for k, lab in labels.items():
                kinds, of = np.unique(lab, return_inverse=True)
                member = (of[:, None] == np.arange(len(kinds))).astype(float)
                sizes, own, rows = member.sum(0), of[at], np.arange(len(at))
                sums = d @ member
                inner = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
                other = sums / sizes
                other[rows, own] = np.inf
                outer = other.min(1)
                with np.errstate(invalid="ignore"):
                    value = np.where((sizes[own] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
                yield pd.DataFrame({"k": [k], "s": [float(value.sum())]})

    got = spark.range(len(x)).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    data.unpersist()
    return {r.k: r.s / len(x) for r in got}


def validity(assigned: DataFrame, d: int, *keys: str) -> DataFrame:
    """(keys, calinski_harabasz, davies_bouldin), one row without keys; null where undefined.

    keys (a k, say) tell labellings of the same points apart.
    """
    by = [*keys, "cluster"]
    c = assigned.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("x", j)) for j in range(d)]).alias("x"))
    every = assigned.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("x", j)) for j in range(d)]).alias("m"))
    dist2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.coalesce((p - q) * (p - q), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)  # noqa: E731  coordinates that both have
    own = assigned.join(F.broadcast(c.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("x").alias("cx"))), [F.col(k) == F.col(f"_{k}") for k in by])  # one row a cluster
    spread = own.groupBy(*by).agg(F.sum(dist2("x", "cx")).alias("w"), F.avg(F.sqrt(dist2("x", "cx"))).alias("s"))
    c2 = c.withColumnRenamed("n", "size").join(spread, by)
    c2 = c2.join(every, list(keys)) if keys else c2.crossJoin(every)  # one row
    ch = c2.groupBy(*keys).agg(F.sum(F.col("size") * dist2("x", "m")).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k_"), F.max("n").alias("n"))
    ch = ch.select(*keys, ((F.col("b") / F.nullif(F.col("k_") - 1, F.lit(0))) / F.nullif(F.col("w") / F.nullif(F.col("n") - F.col("k_"), F.lit(0)), F.lit(0.0))).alias("calinski_harabasz"))
    p = c.join(spread, by).select(*by, "x", "s")
    q = p.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("cluster").alias("c2"), F.col("x").alias("x2"), F.col("s").alias("s2"))
    pairs = p.join(q, [*[F.col(k) == F.col(f"_{k}") for k in keys], F.col("cluster") != F.col("c2")])  # clusters, not points
    worst = pairs.groupBy(*by).agg(F.max((F.col("s") + F.col("s2")) / F.nullif(F.sqrt(dist2("x", "x2")), F.lit(0.0))).alias("r"))
    db = worst.groupBy(*keys).agg(F.avg("r").alias("davies_bouldin"))
    return ch.join(db, list(keys), "left") if keys else ch.crossJoin(db)


def _agreement(spread: DataFrame, labellings: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(k, stability, stability_sd): mean and population deviation of the ARI of each two labellings of one k, over all points."""
    ks = sorted({k for k, _ in labellings})
    of = {k: [c for (j, _), c in sorted(labellings.items()) if j == k] for k in ks}

    def run(batches):
        for x, _ in _blocks(batches):
            out = []
            for k in ks:
                lab = [squared_distances(x, c).argmin(1) for c in of[k]]
                for i in range(len(lab)):
                    for j in range(i + 1, len(lab)):
                        n = np.bincount(lab[i] * k + lab[j], minlength=k * k)
                        at = np.flatnonzero(n)
                        one = np.ones(len(at), dtype=int)
                        out.append(np.stack([k * one, i * one, j * one, at // k, at % k, n[at]]))
            yield pd.DataFrame(np.concatenate(out, 1).T if out else np.empty((0, 6), int), columns=["k", "i", "j", "a", "b", "n"])

    cells = spread.mapInPandas(run, "k int, i int, j int, a int, b int, n long").groupBy("k", "i", "j", "a", "b").agg(F.sum("n").alias("n"))
    return ari_of_cells(cells, "k", "i", "j").groupBy("k").agg(F.avg("ari").alias("stability"), F.stddev_pop("ari").alias("stability_sd"))


def _resampled(k: int, resamples: int, restarts: int, seed: int) -> list[Fit]:
    return [f for b in range(resamples) for f in _runs(k, restarts, seed + 13 * b, b)]


def stability(points: DataFrame, k: int, resamples: int = 10, share: float = 0.8, restarts: int = 5, seed: int = SEED) -> tuple[float, float]:
    """Mean and population deviation of the pairwise ARI of labellings fitted on subsamples, drawn without replacement."""
    spread = _spread(points)
    fits = _resampled(k, resamples, restarts, seed)
    best = _best(fits, fit_all(spread, fits, resample_bounds(spread, resamples, share, seed), seed=seed))
    r = _agreement(spread, {key: c for key, (c, _) in best.items()}).first()
    spread.unpersist()
    return r.stability, r.stability_sd


def evaluate_k(points: DataFrame, ks: range, resamples: int = 10, restarts: int = RESTARTS, seed: int = SEED, share: float = 0.8, resample_restarts: int = 5) -> DataFrame:
    """One row a k: inertia, silhouette, calinski_harabasz, davies_bouldin, stability, stability_sd.

    The silhouette is that of a sample of SAMPLE points. All fits, measures and agreements are a few jobs for all k.
    """
    spread = _spread(points)
    fits = [f for k in ks for f in _runs(k, restarts, seed) + _resampled(k, resamples, resample_restarts, seed)]
    best = _best(fits, fit_all(spread, fits, resample_bounds(spread, resamples, share, seed), seed=seed))
    agree = {r.k: r for r in _agreement(spread, {key: c for key, (c, _) in best.items() if key[1] >= 0}).collect()}
    centres = {k: best[k, -1][0] for k in ks}

    def label(batches):
        for x, _ in _blocks(batches):
            for k, c in centres.items():
                yield pd.DataFrame({"k": k, "cluster": squared_distances(x, c).argmin(1), "x": list(x)})

    every = cut(spread.mapInPandas(label, "k int, cluster int, x array<double>"), "labelled")
    valid = {r.k: r for r in validity(every, len(centres[ks[0]][0]), "k").collect()}  # one row a k
    scores = sampled_silhouettes(spread, centres)
    spread.unpersist()
    out = [(k, best[k, -1][1], scores[k], valid[k].calinski_harabasz, valid[k].davies_bouldin, agree[k].stability, agree[k].stability_sd) for k in ks]
    return points.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, stability double, stability_sd double")


def choose_k(metrics: DataFrame, strict: float = 0.95, gate: float = 0.75) -> DataFrame:
    """One row (most_granular, most_separated, gate_passed) from (k, stability, silhouette)."""
    gated = F.col("stability") >= gate
    r = metrics.agg(
        F.min_by(F.when(gated, F.col("k")), F.when(gated, F.struct(-F.col("silhouette"), "k"))).alias("separated"),
        F.min_by("k", F.struct(-F.col("stability"), "k")).alias("fallback"),
        F.max(F.when(F.col("stability") >= strict, F.col("k"))).alias("granular"),
        (F.count_if(gated) > 0).alias("gate_passed"),
    )
    separated = F.coalesce("separated", "fallback")
    return r.select(F.coalesce("granular", separated).alias("most_granular"), separated.alias("most_separated"), "gate_passed")


def summaries(z: DataFrame, log: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a cluster: sizes, amplitudes, coherence, and the samples of the profile's peak and trough (first if tied).

    z and log are long matrices, labels (gene, cluster, silhouette).
    """
    lab = labels.select(F.col("gene").alias("_g"), "cluster", "silhouette")
    zc = z.join(lab, F.col("gene") == F.col("_g"))
    profile = zc.groupBy("cluster", "sample").agg(F.avg("v").alias("m"))
    peaks = profile.groupBy("cluster").agg(F.min_by("sample", F.struct(-F.col("m"), "sample")).alias("peak_sample"), F.min_by("sample", F.struct("m", "sample")).alias("trough_sample"))
    p = profile.select(F.col("cluster").alias("_c"), F.col("sample").alias("_s"), "m")
    r = zc.join(p, (F.col("cluster") == F.col("_c")) & (F.col("sample") == F.col("_s"))).groupBy("cluster", "gene").agg(F.corr("v", "m").alias("r"))
    r = r.where(~F.isnan("r")).groupBy("cluster").agg(F.avg("r").alias("mean_correlation_to_centroid"))
    per = log.groupBy("gene").agg((F.max("v") - F.min("v")).alias("range"), F.avg("v").alias("mean")).join(lab, F.col("gene") == F.col("_g"))
    s = per.groupBy("cluster").agg(
        F.count("*").alias("n_genes"), F.avg("range").alias("mean_log2_range"), F.median("range").alias("median_log2_range"),
        F.pow(F.lit(2.0), F.avg("range")).alias("fold_change"), F.avg("mean").alias("mean_expression_log2"), F.avg("silhouette").alias("mean_silhouette"),
    )
    return s.join(r, "cluster", "left").join(peaks, "cluster")


def profiles(z: DataFrame, log: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, sample, zmean, z_q25, z_q75, log2mean)."""
    lab = labels.select(F.col("gene").alias("_g"), "cluster")
    a = z.join(lab, F.col("gene") == F.col("_g")).groupBy("cluster", "sample").agg(F.avg("v").alias("zmean"), F.percentile("v", F.lit(0.25)).alias("z_q25"), F.percentile("v", F.lit(0.75)).alias("z_q75"))
    b = log.join(lab, F.col("gene") == F.col("_g")).groupBy("cluster", "sample").agg(F.avg("v").alias("log2mean"))
    return a.join(b, ["cluster", "sample"])


def gene_table(z: DataFrame, log: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a gene: cluster, silhouette, mean and range of log2 values, correlation with the cluster's profile (0 if undefined)."""
    lab = labels.select(F.col("gene").alias("_g"), "cluster", "silhouette")
    zc = z.join(lab, F.col("gene") == F.col("_g")).drop("_g")
    zc = zc.withColumn("m", F.avg("v").over(Window.partitionBy("cluster", "sample")))
    r = zc.groupBy("gene", "cluster", "silhouette").agg(F.corr("v", "m").alias("r"))
    a = log.groupBy(F.col("gene").alias("_g")).agg(F.avg("v").alias("mean_log2_expression"), (F.max("v") - F.min("v")).alias("log2_range"))
    return r.join(a, F.col("gene") == F.col("_g")).select("gene", "cluster", "silhouette", "mean_log2_expression", "log2_range", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("correlation_to_centroid"))


def pca(points: DataFrame, components: int = 3) -> tuple[DataFrame, list[float]]:
    """(id, pc array) of the centred points and the share of variance of each component; signs are arbitrary.

    Sums and products are aggregated by Spark, so only a d by d matrix reaches the driver.
    """
    d = len(points.select("x").first().x)
    x = lambda j: F.get("x", j)
    m = points.agg(F.count("*").alias("n"), *[F.avg(x(j)).alias(f"m{j}") for j in range(d)]).first()
    mean = [m[f"m{j}"] for j in range(d)]
    c = points.agg(*[F.sum((x(i) - mean[i]) * (x(j) - mean[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[c[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / max(1, m.n - 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    total = float(values.sum()) or 1.0
    pcs = [sum(((x(j) - mean[j]) * float(axes[j, o]) for j in range(d)), F.lit(0.0)) for o in order]
    return points.select("id", F.array(*pcs).alias("pc")), [float(values[o]) / total for o in order]


def sample_distances(rows: DataFrame, centre: bool = True) -> tuple[list[str], np.ndarray]:
    """Sample names and 1 - correlation over genes, by one aggregation; one number for each pair of samples.

    Genes without a value in every sample are left out.
    """
    names = samples_of(rows)
    rows = rows.withColumn("_k", F.count("v").over(Window.partitionBy("gene"))).where(F.col("_k") == len(names)).drop("_k")
    at = {s: n for n, s in enumerate(names)}
    d = np.full((len(names), len(names)), np.nan)
    for r in correlation_distance(sample_correlation(rows, centre, names)).collect():
        d[at[r.s1], at[r.s2]] = np.nan if r.d is None else r.d
    np.fill_diagonal(d, 0.0)
    return names, d


def sample_tree(rows: DataFrame, centre: bool = True) -> tuple[DataFrame, list[str]]:
    """(step, left, right, height, size) of the samples' average linkage, and their names in order."""
    names, d = sample_distances(rows, centre)
    out = [(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(L.linkage(d, "average"))]
    return rows.sparkSession.createDataFrame(out, "step long, left long, right long, height double, size long"), names


def sample_clusters(rows: DataFrame, k: int, centre: bool = True) -> dict[str, int]:
    """Cluster of each sample, at most k."""
    names, d = sample_distances(rows, centre)
    return dict(zip(names, L.cut(L.linkage(d, "average"), k).tolist(), strict=True))


def evaluate_sample_k(rows: DataFrame, centre: bool = True) -> DataFrame:
    """(k, silhouette) of the samples' average-linkage clusters, k from 2 to the lesser of 5 and n - 1."""
    names, d = sample_distances(rows, centre)
    out = []
    for k in range(2, min(5, len(names) - 1) + 1):
        lab = L.cut(L.linkage(d, "average"), k)
        values = []
        for i in range(len(names)):
            own = (lab == lab[i]) & (np.arange(len(names)) != i)
            others = [d[i, lab == c].mean() for c in set(lab.tolist()) if c != lab[i]]
            a, b = (d[i, own].mean() if own.any() else 0.0), min(others, default=0.0)
            values.append((b - a) / max(a, b) if own.any() and max(a, b) > 0 else 0.0)
        out.append((k, float(np.mean(values)) if 2 <= len(set(lab.tolist())) < len(names) else None))
    return rows.sparkSession.createDataFrame(out, "k int, silhouette double")


def resampled_moments(points: DataFrame, replicates: int, seed: int = SEED, block: int = 4_096) -> DataFrame:
    """(r, m): for each bootstrap replicate over the points (id, x) the weighted sums 1, x_i and x_i x_j (i <= j).

    A replicate draws as many points as there are, with replacement: blocks of points share the draws by binomial
    splits that every task repeats from the replicate's own stream, and a block deals its share out among its points.
    """
    blocks = max(1, -(-points.count() // block))
    rows = points.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    held = {r.b: r.n for r in rows.groupBy("b").agg(F.count("*").alias("n")).collect()}  # one row a block
    sizes = np.array([held.get(b, 0) for b in range(blocks)])
    after = np.append(np.cumsum(sizes[::-1])[::-1], 0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        x = matrix(pdf.sort_values("id"))
        i, j = np.triu_indices(x.shape[1])
        values = np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)
        weights = np.zeros((replicates, len(x)))
        for r in range(replicates):
            rng, left = np.random.default_rng([seed, r]), int(sizes.sum())
            for c in range(b + 1):
                mine = int(rng.binomial(left, sizes[c] / after[c])) if after[c + 1] and after[c] else left
                left -= mine
            weights[r] = np.random.default_rng([seed, r, b]).multinomial(mine, np.full(len(x), 1 / len(x)))
        return pd.DataFrame({"r": np.arange(replicates), "m": list(weights @ values)})

    parts = rows.groupBy("b").applyInPandas(run, "r long, m array<double>")
    n = len(points.first().x)
    width = 1 + n + n * (n + 1) // 2
    return parts.groupBy("r").agg(F.array(*[F.sum(F.get("m", c)) for c in range(width)]).alias("m"))


def coassignment(rows: DataFrame, k: int, replicates: int = 1_000, centre: bool = True, seed: int = SEED) -> DataFrame:
    """(s1, s2, support, usable): share of bootstraps over genes that put two samples together.

    Genes without a value in every sample are left out. Genes stay in Spark: what a replicate needs of them is its
    weighted sums of products of samples. The divisor is the number of replicates asked for; usable is how many had
    finite correlations.
    """
    names = samples_of(rows)
    d = len(names)
    points = vectors(rows, names)
    if centre:
        mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
        points = points.withColumn("x", F.transform("x", lambda v: v - mean))
    i, j = np.triu_indices(d)

    def run(batches):
        for b in batches:
            total, usable = np.zeros((d, d)), 0
            for m in b["m"]:
                n, s, q = m[0], np.array(m[1 : d + 1]), np.zeros((d, d))
                q[i, j] = q[j, i] = m[d + 1 :]
                cov = q / n - np.outer(s, s) / n**2
                var = np.diag(cov)
                if not np.isfinite(cov).all() or (var <= 1e-12 * np.maximum(np.diag(q) / n, 1e-300)).any():
                    continue
                r = cov / np.sqrt(np.outer(var, var))
                lab = L.cut(L.linkage(np.maximum(1 - r, 0), "average"), k)
                total += lab[:, None] == lab[None]
                usable += 1
            p, q = np.meshgrid(range(d), range(d), indexing="ij")
            yield pd.DataFrame({"i": p.ravel(), "j": q.ravel(), "n": total.ravel().astype("int64"), "u": usable})

    got = resampled_moments(points, replicates, seed).mapInPandas(run, "i int, j int, n long, u long").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("u").alias("usable"))
    label = F.array(*[F.lit(s) for s in names])
    return got.select(F.get(label, F.col("i")).alias("s1"), F.get(label, F.col("j")).alias("s2"), (F.col("n") / replicates).alias("support"), "usable")


def support(coassigned: DataFrame, labels: dict[str, int]) -> DataFrame:
    """One row: mean, least and greatest support within clusters and between them; null where there is no pair."""
    of = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    t = coassigned.where("s1 < s2").withColumn("same", of[F.col("s1")] == of[F.col("s2")])
    pick = lambda same: F.when(F.col("same") == same, F.col("support"))
    return t.agg(*[f(pick(s)).alias(f"{n}_{m}") for s, n in ((True, "within"), (False, "between")) for f, m in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))])


def weak_pairs(coassigned: DataFrame, labels: dict[str, int], below: float = 0.9) -> DataFrame:
    of = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return coassigned.where((F.col("s1") < F.col("s2")) & (of[F.col("s1")] == of[F.col("s2")]) & (F.col("support") < below))
