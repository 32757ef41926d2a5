"""Statistics of stratified two-group count tables.

A table is long: (j, i, a, b) with a stratum j, a category i and the two groups' counts. Everything that grows with
the input is aggregated by Spark; what reaches the driver has one row a stratum or R * R numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.pvalues import chi2_sf, norm_isf, norm_sf, t_two_sided
from tessera.operators.order import running


def _xlogx(x: Column, e: Column) -> Column:
    return F.when(x > 0, x * F.ln(x / F.nullif(e, F.lit(0.0)))).otherwise(0.0)


def pair(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """(j, i, a, b) from two matrices (row, col, value) of one shape; a cell that only one has is an error."""
    b = m2.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("b"))
    rows = m1.join(b, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "full")
    bad = F.col("value").isNull() | F.col("b").isNull()
    value = F.when(bad, F.raise_error(F.lit("the matrices differ in shape"))).otherwise(F.col("value"))
    return rows.select(F.coalesce("col", "_c").alias("j"), F.coalesce("row", "_r").alias("i"), value.cast("double").alias("a"), F.col("b").cast("double").alias("b"))


def per_stratum(table: DataFrame, keys: tuple[str, ...] = ("j",)) -> DataFrame:
    """For each stratum: g, chi2, dof, min_expected, cramers_v, js_divergence, cosine, n. Undefined values are null.

    keys may hold a replicate besides the stratum.
    """
    w = Window.partitionBy(*keys)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    t = table.select(*keys, "i", a.alias("a"), b.alias("b"), F.sum(a).over(w).alias("na"), F.sum(b).over(w).alias("nb"))
    n = F.col("na") + F.col("nb")
    t = t.withColumns({"n": n, "ea": (F.col("a") + F.col("b")) * F.col("na") / F.nullif(n, F.lit(0.0)), "eb": (F.col("a") + F.col("b")) * F.col("nb") / F.nullif(n, F.lit(0.0))})
    p, q = F.col("a") / F.nullif(F.col("na"), F.lit(0.0)), F.col("b") / F.nullif(F.col("nb"), F.lit(0.0))
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / F.nullif(m, F.lit(0.0)))).otherwise(0.0)
    square = lambda o, e: F.pow(F.col(o) - F.col(e), 2) / F.nullif(F.col(e), F.lit(0.0))
    empty = F.count_if((F.col("ea") == 0) | (F.col("eb") == 0) | F.col("ea").isNull()) > 0
    rows = t.groupBy(*keys).agg(
        (2 * F.sum(_xlogx(F.col("a"), F.col("ea")) + _xlogx(F.col("b"), F.col("eb")))).alias("g"),
        F.when(empty, None).otherwise(F.sum(square("a", "ea") + square("b", "eb"))).alias("chi2"),
        (F.count("*") - 1).alias("dof"),
        F.min(F.least("ea", "eb")).alias("min_expected"),
        (0.5 * F.sum(half(p)) + 0.5 * F.sum(half(q))).alias("js_divergence"),
        (F.sum(F.col("a") * F.col("b")) / F.nullif(F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))), F.lit(0.0))).alias("cosine"),
        F.max("n").alias("n"),
    )
    return rows.withColumn("cramers_v", F.sqrt(F.col("chi2") / F.nullif(F.col("n"), F.lit(0.0))))


def with_pvalues(rows: DataFrame, statistic: str, name: str) -> DataFrame:
    """rows with the chi-square tail of a statistic; for the few rows that strata give."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi2_sf(v, int(d)) for v, d in zip(x, dof, strict=True)], dtype="float64")

    return rows.withColumn(name, tail(F.col(statistic), F.col("dof")))


def significance_split(rows: DataFrame, p: str = "g_p", alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The rows whose p is below alpha, and those whose p is not; a null p is in neither."""
    return rows.where(F.col(p) < alpha), rows.where(F.col(p) >= alpha)


def fisher(p: list[float]) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of Fisher's combination; p values are held above 1e-300."""
    x = -2 * math.fsum(math.log(min(1.0, max(1e-300, v))) for v in p)
    return x, 2 * len(p), chi2_sf(x, 2 * len(p))


def stouffer(p: list[float], weights: list[float] | None = None) -> tuple[float, float]:
    w = weights or [1.0] * len(p)
    z = math.fsum(a * norm_isf(min(1 - 1e-16, max(1e-300, v))) for a, v in zip(w, p, strict=True)) / math.sqrt(math.fsum(a * a for a in w))
    return z, norm_sf(z)


def harmonic(p: list[float], weights: list[float] | None = None) -> float:
    """Weighted harmonic mean; a p of 0 makes it 0."""
    w = weights or [1.0] * len(p)
    return 0.0 if min(p) == 0 else math.fsum(w) / math.fsum(a / v for a, v in zip(w, p, strict=True))


def cmh_components(table: DataFrame) -> DataFrame:
    """(i, k, d, cov): per category but the last, the summed difference and the summed covariance of each pair.

    Strata of one or no observation do not count; the last category is the greatest.
    """
    w = Window.partitionBy("j")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    t = table.select("j", "i", a.alias("a"), (a + b).alias("c"), F.sum(a).over(w).alias("na"), F.sum(b).over(w).alias("nb"))
    t = t.withColumn("n", F.col("na") + F.col("nb")).where("n > 1")
    last = table.agg(F.max("i").alias("_last"))
    t = t.join(F.broadcast(last), F.col("i") != F.col("_last")).drop("_last")  # one row
    u = t.select(F.col("j").alias("_j"), F.col("i").alias("k"), F.col("c").alias("ck"))
    pairs = t.join(u, F.col("j") == F.col("_j"))
    same = F.when(F.col("i") == F.col("k"), F.col("n") * F.col("c")).otherwise(0.0)
    cov = F.col("na") * F.col("nb") * (same - F.col("c") * F.col("ck")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    d = F.when(F.col("i") == F.col("k"), F.col("a") - F.col("c") * F.col("na") / F.col("n")).otherwise(0.0)
    return pairs.groupBy("i", "k").agg(F.sum(d).alias("d"), F.sum(cov).alias("cov"))


def cmh(table: DataFrame) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of the generalized Cochran-Mantel-Haenszel test."""
    rows = cmh_components(table).collect()  # (R - 1)^2 rows
    names = sorted({r.i for r in rows})
    at = {x: n for n, x in enumerate(names)}
    d, v = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in rows:
        v[at[r.i], at[r.k]] = r["cov"]
        d[at[r.i]] += r.d
    x = float(d @ np.linalg.pinv(v) @ d)
    return x, len(names), chi2_sf(x, len(names))


def g_of_replicates(table: DataFrame, replicate: str = "r") -> DataFrame:
    """(replicate, g, dof): the summed G of each replicate's strata, from rows (replicate, j, i, a, b)."""
    return per_stratum(table, (replicate, "j")).groupBy(replicate).agg(F.sum("g").alias("g"), F.sum("dof").alias("dof"))


def _g(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """G of tables whose categories lie along the last axis."""
    c, na, nb = a + b, a.sum(-1, keepdims=True), b.sum(-1, keepdims=True)
    total = 0
    for x, n in ((a, na), (b, nb)):
        e = c * n / (na + nb)
        total = total + np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.where(e > 0, e, 1)), 0).sum(-1)
    return 2 * total


def _cells(table: DataFrame) -> tuple[list, list[np.ndarray]]:
    """Strata in order, and each one's counts (categories by groups); one row a cell reaches the driver."""
    cells = table.select("j", "i", F.col("a").cast("double"), F.col("b").cast("double")).toPandas()
    strata = sorted(cells["j"].unique())
    return strata, [cells[cells["j"] == j].sort_values("i")[["a", "b"]].to_numpy() for j in strata]


def _drawn(data: list[np.ndarray], block: int, n: int, seed: int) -> np.ndarray:
    """G by (stratum, simulation) of the simulations of a block: both groups redrawn from the stratum's pooled shares."""
    rng = np.random.default_rng([seed, block])
    out = []
    for m in data:
        p = m.sum(1) / m.sum()
        out.append(_g(rng.multinomial(int(m[:, 0].sum()), p, n).astype(float), rng.multinomial(int(m[:, 1].sum()), p, n).astype(float)))
    return np.array(out)


def _blocks(table: DataFrame, sims: int, block: int) -> DataFrame:
    """Blocks of simulations, each with a seeded stream of its own, so results do not depend on how Spark deals them out."""
    return table.sparkSession.range(-(-sims // block))


def null_distribution(table: DataFrame, sims: int = 200_000, seed: int = 20260726, block: int = 2_000) -> tuple[DataFrame, float]:
    """(sim, g): the summed G of each simulation under pooled proportions; and the summed G observed."""
    _, data = _cells(table)

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                n = min(block, sims - int(k) * block)
                yield pd.DataFrame({"sim": np.arange(n) + int(k) * block, "g": _drawn(data, int(k), n, seed).sum(0)})

    return _blocks(table, sims, block).mapInPandas(run, "sim long, g double"), float(sum(_g(m[:, 0], m[:, 1]) for m in data))


def monte_carlo(table: DataFrame, sims: int = 200_000, seed: int = 20260726, block: int = 2_000) -> tuple[dict, float]:
    """p of each stratum (without correction) and of the summed G (with +1), under pooled proportions.

    table has one row a cell and is small; sims may be large, and only counts of exceedances leave the tasks.
    """
    strata, data = _cells(table)
    seen = np.array([float(_g(m[:, 0], m[:, 1])) for m in data])

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                drawn = _drawn(data, int(k), min(block, sims - int(k) * block), seed)
                each = (drawn >= seen[:, None] - 1e-9).sum(1).tolist()
                yield pd.DataFrame({"s": [*range(len(each)), -1], "n": [*each, int((drawn.sum(0) >= seen.sum() - 1e-9).sum())]})

    n = {r.s: r.n for r in _blocks(table, sims, block).mapInPandas(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return {j: n[k] / sims for k, j in enumerate(strata)}, (n[-1] + 1) / (sims + 1)


def margins(table: DataFrame) -> DataFrame:
    """Totals of rows, columns and all, by grouping sets: (i, j, a, b), null where summed over."""
    t = table.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), "a", "b")
    return t.groupingSets([[F.col("i")], [F.col("j")], []], "i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def proportions(table: DataFrame) -> DataFrame:
    w = Window.partitionBy("j")
    p, q = F.col("a") / F.nullif(F.sum("a").over(w), F.lit(0)), F.col("b") / F.nullif(F.sum("b").over(w), F.lit(0))
    return table.select("j", "i", p.alias("pa"), q.alias("pb"), (q - p).alias("difference"))


def row_consistency(table: DataFrame) -> DataFrame:
    """(i, consistent): whether a category's share moves the same way in all strata."""
    d = F.col("difference")
    return proportions(table).groupBy("i").agg((F.bool_and(d > 0) | F.bool_and(d < 0)).alias("consistent"))


def pooled_chi2(table: DataFrame) -> DataFrame:
    """One row (chi2, dof): Pearson test of the categories' totals; Yates' correction with one degree of freedom."""
    t = table.groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") > 0)
    w = Window.partitionBy(F.lit(1))  # one row a category
    na, nb = F.sum("a").over(w), F.sum("b").over(w)
    t = t.select("a", "b", ((F.col("a") + F.col("b")) * na / (na + nb)).alias("ea"), ((F.col("a") + F.col("b")) * nb / (na + nb)).alias("eb"), F.count("*").over(w).alias("r"))
    off = lambda o, e: F.when(F.col("r") == 2, F.abs(F.col(o) - F.col(e)) - F.least(F.lit(0.5), F.abs(F.col(o) - F.col(e)))).otherwise(F.abs(F.col(o) - F.col(e)))
    x = F.sum(F.pow(off("a", "ea"), 2) / F.col("ea") + F.pow(off("b", "eb"), 2) / F.col("eb"))
    return t.agg(x.alias("chi2"), (F.count("*") - 1).alias("dof"))


def paired_t(table: DataFrame) -> DataFrame:
    """One row (t, dof) of the paired test over all cells."""
    d = F.col("a") - F.col("b")
    return table.agg((F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"), (F.count("*") - 1).alias("dof"))


def wilcoxon(table: DataFrame) -> DataFrame:
    """One row (w, n, z): signed ranks over all cells; zero differences go, ties get mean ranks and correct the variance."""
    d = F.col("a") - F.col("b")
    t = table.select(d.alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ties = t.groupBy("m").agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    ties = running(ties, [], ["m"], F.col("k"), "upto").withColumn("rank", F.col("upto") - (F.col("k") - 1) / 2)
    s = ties.agg(F.sum("k").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(F.col("down") * F.col("rank")).alias("minus"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("tie"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    low = F.least("plus", "minus")
    return s.select(low.alias("w"), "n", ((low - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("z"))


def paired_tests(table: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Statistic and two-sided p of the paired t and the Wilcoxon test; None where undefined."""
    t, w = paired_t(table).first(), wilcoxon(table).first()
    return {
        "t": (t.t, None if t.t is None else t_two_sided(t.t, t.dof)),
        "wilcoxon": (w.w, None if w.z is None else 2 * norm_sf(abs(w.z))),
    }


def compare(table: DataFrame, sims: int = 0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The per-stratum and the combined results as pandas tables; sims > 0 adds the Monte Carlo p."""
    rows = with_pvalues(with_pvalues(per_stratum(table), "g", "g_p"), "chi2", "chi2_p").orderBy("j").toPandas()
    p, n = rows["g_p"].tolist(), rows["n"].tolist()
    pooled = pooled_chi2(table).first()
    tests = paired_tests(table)
    x, dof, fp = fisher(p)
    c, cd, cp = cmh(table)
    (su, sup), (sw, swp) = stouffer(p), stouffer(p, n)
    total, tdof = float(rows["g"].sum()), int(rows["dof"].sum())
    combined = [
        ("naive_flatten_paired_t", tests["t"][0], None, tests["t"][1]),
        ("naive_flatten_wilcoxon", tests["wilcoxon"][0], None, tests["wilcoxon"][1]),
        ("naive_pooled_chi2", pooled.chi2, pooled.dof, chi2_sf(pooled.chi2, pooled.dof)),
        ("fisher_combined", x, dof, fp),
        ("stouffer_unweighted", su, None, sup),
        ("stouffer_weighted", sw, None, swp),
        ("harmonic_mean_p", None, None, harmonic(p)),
        ("generalized_cmh", c, cd, cp),
        ("summed_g", total, tdof, chi2_sf(total, tdof)),
    ]
    if sims:
        each, all_p = monte_carlo(table, sims)
        rows["monte_carlo_p"] = rows["j"].map(each)
        combined.append(("monte_carlo_combined", total, None, all_p))
    return rows, pd.DataFrame(combined, columns=["method", "statistic", "dof", "pvalue"])
