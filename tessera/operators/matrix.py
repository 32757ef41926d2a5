"""Expression matrices as long tables (gene, sample, v): quality control, filter, normalisation, z-scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import quantiles, row_numbers
from tessera.sources.scratch import cut

#: Least mean, least samples at LEAST_VALUE, and that value.
LEAST_MEAN, LEAST_SAMPLES, LEAST_VALUE = 1.0, 3, 1.0


def from_wide(wide: DataFrame, key: str = "gene") -> DataFrame:
    """Long table of a wide one; every other column is a sample, row_id (if there) gives the genes' order."""
    samples = [c for c in wide.columns if c not in (key, "row_id")]
    ids = [c for c in ("row_id", key) if c in wide.columns]
    return wide.unpivot(ids, samples, "sample", "v").withColumn("v", F.col("v").cast("double"))


def to_wide(rows: DataFrame, samples: list[str], value: str = "v") -> DataFrame:
    """One row a gene, one column a sample."""
    return rows.groupBy("gene").agg(*[F.max(F.when(F.col("sample") == s, F.col(value))).alias(s) for s in samples])


def samples_of(rows: DataFrame) -> list[str]:
    """Sample names in order; a matrix has as many as it has columns."""
    return [r.sample for r in rows.select("sample").distinct().orderBy("sample").collect()]


def qc(rows: DataFrame) -> DataFrame:
    """One row a sample: zeros, least, greatest, total, median of log2(v + 1)."""
    rows = cut(rows, "matrix")
    medians = quantiles(log2p1(rows), ["sample"], "v", [0.5]).select(F.col("sample").alias("_s"), F.col("value").alias("log_median"))
    per = rows.groupBy("sample").agg(F.count_if(F.col("v") == 0).alias("zeros"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum("v").alias("total"))
    return per.join(medians, F.col("sample") == F.col("_s"), "left").drop("_s")


def qc_overall(rows: DataFrame) -> DataFrame:
    """One row: genes, samples, all-zero genes, variation of the totals, spread of the log medians, share of the top ten means."""
    per = qc(rows).agg(
        F.count("*").alias("n_samples"), (F.stddev_pop("total") / F.nullif(F.avg("total"), F.lit(0.0))).alias("total_cv"), (F.max("log_median") - F.min("log_median")).alias("median_spread")
    )
    genes = rows.groupBy("gene").agg(F.avg("v").alias("m"), F.max(F.abs("v")).alias("top"))
    top = genes.orderBy(F.desc("m"), "gene").limit(10).agg(F.sum("m").alias("t"))
    every = genes.agg(F.count("*").alias("n_genes"), F.count_if(F.col("top") == 0).alias("n_all_zero"), F.sum("m").alias("s"))
    return per.crossJoin(every).crossJoin(top).select("n_genes", "n_samples", "n_all_zero", "total_cv", "median_spread", (F.col("t") / F.nullif(F.col("s"), F.lit(0.0))).alias("top10_share"))


def gene_filter(rows: DataFrame, mean: float = LEAST_MEAN, samples: int = LEAST_SAMPLES, value: float = LEAST_VALUE) -> DataFrame:
    """Genes with the mean, seen in enough samples, and not constant; on raw values."""
    w = Window.partitionBy("gene")
    ok = (F.avg("v").over(w) >= mean) & (F.count_if(F.col("v") >= value).over(w) >= samples) & (F.min("v").over(w) < F.max("v").over(w))
    return rows.withColumn("_ok", ok).where("_ok").drop("_ok")


def log2p1(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.log2(F.col("v") + 1))


def normalise(rows: DataFrame, method: str = "median") -> DataFrame:
    """Columns made comparable: ``median`` shifts each to the median of medians, ``quantile`` gives all one distribution.

    Ranks of tied values are told apart by gene.
    """
    if method == "none":
        return rows
    if method == "median":
        rows = cut(rows, "matrix")
        medians = quantiles(rows, ["sample"], "v", [0.5]).select(F.col("sample").alias("_s"), F.col("value").alias("_m"))
        overall = medians.agg(F.median("_m").alias("_o"))
        shift = medians.crossJoin(F.broadcast(overall))  # one row
        return rows.join(shift, F.col("sample") == F.col("_s")).withColumn("v", F.col("v") - (F.col("_m") - F.col("_o"))).select(*rows.columns)
    if method == "quantile":
        ranked = row_numbers(rows, ["sample"], ["v", "gene"], "_r")
        means = ranked.groupBy(F.col("_r").alias("_k")).agg(F.avg("v").alias("_v"))
        return ranked.join(means, F.col("_r") == F.col("_k")).withColumn("v", F.col("_v")).select(*rows.columns)
    raise ValueError(f"unknown normalisation {method!r}")


def zscore(rows: DataFrame) -> DataFrame:
    """Values by gene in population standard deviations; a constant gene has zeros."""
    w = Window.partitionBy("gene")
    sd = F.stddev_pop("v").over(w)
    return rows.withColumn("v", F.when(F.min("v").over(w) == F.max("v").over(w), 0.0).otherwise((F.col("v") - F.avg("v").over(w)) / F.nullif(sd, F.lit(0.0))))


def preprocess(rows: DataFrame, method: str = "median") -> dict[str, DataFrame]:
    """The chain: qc of the raw table, filter, log2(x + 1), normalisation, z-scores."""
    kept = gene_filter(rows)
    log = normalise(log2p1(kept), method)
    return {"qc": qc(rows), "overall": qc_overall(rows), "kept": kept, "log": log, "z": zscore(log)}


def variable_genes(rows: DataFrame, most: int = 2000) -> DataFrame:
    """(gene, variance) of the genes with the largest sample variance."""
    return rows.groupBy("gene").agg(F.var_samp("v").alias("variance")).orderBy(F.desc("variance"), "gene").limit(most)


def centred(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("gene")))


def sample_correlation(rows: DataFrame, centre: bool = False, samples: list[str] | None = None) -> DataFrame:
    """(s1, s2, r) for every pair of samples, Pearson over genes, in one aggregation."""
    rows = centred(rows) if centre else rows
    names = samples or samples_of(rows)
    wide = to_wide(rows, names)
    pairs = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :]]
    got = wide.agg(*[F.corr(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("s1"), F.lit(y).alias("s2"), F.col(f"c{n}").alias("r")) for n, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    cells += [F.struct(F.lit(a).alias("s1"), F.lit(a).alias("s2"), F.lit(1.0).alias("r")) for a in names]
    return got.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correlation_distance(correlations: DataFrame) -> DataFrame:
    return correlations.select("s1", "s2", F.greatest(1 - F.col("r"), F.lit(0.0)).alias("d"))


def signatures(rows: DataFrame, labels: dict[str, int], most: int = 50, epsilon: float = 0.1) -> DataFrame:
    """(cluster, direction, rank, gene, snr, log2_fold, mean_in, mean_out): genes that mark each cluster of samples.

    A cluster of one sample has no spread; one of all samples, or none, is left out.
    """
    clusters = [c for c in sorted(set(labels.values())) if 0 < list(labels.values()).count(c) < len(labels)]

    def one(c: int) -> list[Column]:
        inside = F.col("sample").isin([s for s, k in labels.items() if k == c])
        v_in, v_out = F.when(inside, F.col("v")), F.when(~inside, F.col("v"))
        sd = lambda v: F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0))
        return [F.avg(v_in).alias(f"i{c}"), F.avg(v_out).alias(f"o{c}"), (sd(v_in) + sd(v_out)).alias(f"s{c}")]

    per = rows.groupBy("gene").agg(*[x for c in clusters for x in one(c)])
    cells = F.array(*[F.struct(F.lit(c).alias("cluster"), F.col(f"i{c}").alias("mean_in"), F.col(f"o{c}").alias("mean_out"), F.col(f"s{c}").alias("sd")) for c in clusters])
    t = per.select("gene", F.explode(cells).alias("c")).select("gene", "c.*").withColumn("log2_fold", F.col("mean_in") - F.col("mean_out"))
    t = t.withColumn("snr", F.col("log2_fold") / (F.col("sd") + epsilon))
    out = []
    for direction, key in (("up", F.desc("snr")), ("down", F.asc("snr"))):
        w = Window.partitionBy("cluster").orderBy(key, "gene")
        out.append(t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("direction", F.lit(direction)))
    return reduce(DataFrame.unionByName, out).select("cluster", "direction", "rank", "gene", "snr", "log2_fold", "mean_in", "mean_out")


def bridge(z: DataFrame, gene_clusters: DataFrame, labels: dict[str, int]) -> DataFrame:
    """(gene_cluster, sample_cluster, mean_z); genes without a cluster have -1."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    t = z.join(gene_clusters.select(F.col("gene").alias("_g"), "cluster"), F.col("gene") == F.col("_g"), "left")
    return t.groupBy(F.coalesce("cluster", F.lit(-1)).alias("gene_cluster"), names[F.col("sample")].alias("sample_cluster")).agg(F.avg("v").alias("mean_z"))
