"""The tables behind the figures: what a plot shows, without drawing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import linkage as L
from tessera.operators import cluster as K
from tessera.operators import contingency as C
from tessera.operators import matrix as M
from tessera.operators import tree as R
from tessera.operators.order import quantiles
from tessera.sources.scratch import cut


def qc_boxes(rows: DataFrame) -> DataFrame:
    """(sample, low, q25, median, q75, high) of log2(v + 1), before or after normalising."""
    rows = cut(M.log2p1(rows), "log")
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    q = quantiles(rows, ["sample"], "v", [*names.values()]).groupBy(F.col("sample").alias("_s"))
    q = q.agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in names.items()])
    ends = rows.groupBy("sample").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.join(q, F.col("sample") == F.col("_s")).select("sample", "low", *names, "high")


def amplitudes(log: DataFrame, labels: DataFrame, width: float = 0.25) -> DataFrame:
    """(cluster, low, n): genes by the range of their log2 values."""
    r = log.groupBy(F.col("gene").alias("_g")).agg((F.max("v") - F.min("v")).alias("range"))
    rows = r.join(labels, F.col("_g") == F.col("gene"))
    return rows.groupBy("cluster", (F.floor(F.col("range") / width) * width).alias("low")).agg(F.count("*").alias("n"))


def flat_clusters(summaries: DataFrame, below: float = 0.5) -> DataFrame:
    """Clusters whose genes hardly move."""
    return summaries.where(F.col("mean_log2_range") < below)


def heatmap_order(z: DataFrame, labels: DataFrame, samples: list[str]) -> DataFrame:
    """(gene, sample, v, row, column): genes by cluster and correlation with its profile, samples by leaf order."""
    names, d = K.sample_distances(z, False)
    leaf = [names[i] for i in L.leaves(L.linkage(d, "average"))] if len(names) > 1 else names
    column = F.create_map(*[F.lit(v) for i, s in enumerate(leaf) for v in (s, i)])
    order = K.gene_table(z, z, labels).select(F.col("gene").alias("_g"), "cluster", "correlation_to_centroid")
    rows = z.where(F.col("sample").isin(samples)).join(order, F.col("gene") == F.col("_g"))
    return rows.select("gene", "sample", "v", F.struct("cluster", (-F.col("correlation_to_centroid")).alias("c"), F.col("gene").alias("g")).alias("row"), column[F.col("sample")].alias("column"))


def signature_heatmap(z: DataFrame, signatures: DataFrame, most: int = 20) -> DataFrame:
    """(cluster, direction, rank, gene, sample, v) of the first genes of each signature."""
    top = signatures.where(F.col("rank") <= most).select("cluster", "direction", "rank", F.col("gene").alias("_g"))
    return z.join(top, F.col("gene") == F.col("_g")).select("cluster", "direction", "rank", "gene", "sample", "v")


def mean_profile_overview(log: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, n, share): sizes of the clusters."""
    n = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.crossJoin(labels.agg(F.count("*").alias("_all"))).select("cluster", "n", (F.col("n") / F.col("_all")).alias("share"))


def naive_against_structured(table: DataFrame) -> DataFrame:
    """(method, statistic, dof, pvalue) of the tests that ignore strata and those that heed them."""
    rows = C.compare(table)[1]
    rows = rows.astype({"statistic": float, "dof": float, "pvalue": float})
    return table.sparkSession.createDataFrame(rows)


def k_panels(metrics: DataFrame) -> DataFrame:
    """(panel, k, value, best): the measures by k, one panel each; best where a panel is highest (lowest for davies_bouldin, none for inertia)."""
    panels = ("inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "stability")
    rows = metrics.unpivot(["k"], [F.col(c).cast("double").alias(c) for c in panels], "panel", "value")
    sign = F.when(F.col("panel") == "davies_bouldin", -1.0).otherwise(1.0)
    first = rows.groupBy(F.col("panel").alias("_p")).agg(F.max_by("k", F.struct(sign * F.col("value"), -F.col("k"))).alias("_k"))  # one row a panel
    return rows.join(first, F.col("panel") == F.col("_p")).select("panel", "k", "value", ((F.col("k") == F.col("_k")) & (F.col("panel") != "inertia")).alias("best"))


def null_histogram(simulated: DataFrame, observed: float, bins: int = 80) -> DataFrame:
    """(bin, low, high, n, observed): simulated statistics (g) in bins of one width from the least to the greatest; observed marks the bin of the real one.

    Every bin is there. A statistic outside the simulated ones is in no bin; equal statistics are all in the first.
    """
    ends = simulated.agg(F.min("g").alias("least"), F.max("g").alias("most"))  # one row
    width = (F.col("most") - F.col("least")) / bins
    at = lambda v: F.when(width > 0, F.least(F.lit(bins - 1), F.floor((v - F.col("least")) / width))).otherwise(0).cast("int")
    counts = simulated.crossJoin(F.broadcast(ends)).groupBy(at(F.col("g")).alias("_b")).agg(F.count("*").alias("n"))
    spine = ends.select("least", width.alias("w"), F.when((F.lit(observed) >= F.col("least")) & (F.lit(observed) <= F.col("most")), at(F.lit(observed))).alias("o"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = spine.join(counts, F.col("bin") == F.col("_b"), "left")
    return rows.select("bin", (F.col("least") + F.col("bin") * F.col("w")).alias("low"), (F.col("least") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("o") == F.col("bin"), F.lit(False)).alias("observed"))


def dendrogram(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(step, x, y): the four corners of each step's bracket, in the order they are drawn."""
    b = R.dendrogram(tree, leaves)
    corner = lambda n, x, y: F.struct(F.lit(n).alias("corner"), F.col(x).alias("x"), F.col(y).alias("y"))
    return b.select("step", F.inline(F.array(corner(1, "x_left", "y_left"), corner(2, "x_left", "y"), corner(3, "x_right", "y"), corner(4, "x_right", "y_right"))))
