"""The result tables of an analysis: for each file name its rows, ready to be written or put into a report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import contingency as C
from tessera.operators import matrix as M
from tessera.operators import tree as R
from tessera.sources.scratch import cut
from tessera.sources.text import write_table


def genes(matrix: DataFrame, ks: Iterable[int] = range(2, 16), k: int | None = None, final_restarts: int = K.FINAL_RESTARTS, **options) -> dict[str, DataFrame]:
    """gene_clusters, profiles, cluster_summaries, k_metrics and agreement of a long matrix: filtered, normalised, standardised and clustered.

    k is chosen from the metrics unless given; options go to ``evaluate_k``. gene_clusters has each gene's z-scores and
    log2 values besides; agreement is the ARI with as many clusters of Ward's linkage, and the mean silhouette.
    """
    log = cut(M.normalise(M.log2p1(M.gene_filter(matrix))), "log")
    z = cut(M.zscore(log), "z")
    names = M.samples_of(z)
    points = cut(K.vectors(z, names), "points")
    metrics = K.evaluate_k(points, list(ks), **options)
    chosen = k or K.choose_k(metrics).first().most_granular
    centres, _ = K.kmeans(points, chosen, final_restarts)
    assigned = K.assign(points, centres)
    scores = K.silhouettes(assigned).select(F.col("id").alias("_id"), "silhouette")
    labels = cut(assigned.join(scores, F.col("id") == F.col("_id"), "left").select(F.col("id").alias("gene"), "cluster", "silhouette"), "labels")
    ward = R.cut_tree(*R.linkage_table(points), chosen).select(F.col("id").alias("_id"), F.col("cluster").alias("ward"))
    both = labels.join(ward, F.col("gene") == F.col("_id"))
    wide = K.gene_table(z, log, labels)
    for prefix, rows in (("z_", z), ("log2_", log)):
        values = M.to_wide(rows, names).select(F.col("gene").alias("_g"), *[F.col(f"`{s}`").alias(prefix + s) for s in names])
        wide = wide.join(values, F.col("gene") == F.col("_g")).drop("_g")
    return {
        "gene_clusters": wide,
        "profiles": K.profiles(z, log, labels),
        "cluster_summaries": K.summaries(z, log, labels),
        "k_metrics": metrics.withColumn("chosen", F.col("k") == chosen),
        "agreement": K.ari(both, "cluster", "ward").select(F.lit(chosen).alias("k"), F.col("ari").alias("ward_ari")).crossJoin(labels.agg(F.avg("silhouette").alias("mean_silhouette"))),  # one row each
    }


def samples(matrix: DataFrame, most: int = 2_000, k: int | None = None, replicates: int = 1_000) -> dict[str, DataFrame]:
    """sample_clusters, signatures, support and weak_pairs of a long matrix's most variable genes."""
    spark = matrix.sparkSession
    log = cut(M.normalise(M.log2p1(M.gene_filter(matrix))), "log")
    top = M.variable_genes(log, most).select(F.col("gene").alias("_g"))
    variable = cut(log.join(top, F.col("gene") == F.col("_g"), "left_semi"), "variable")
    metrics = K.evaluate_sample_k(variable)
    chosen = k or metrics.orderBy(F.desc_nulls_last("silhouette"), "k").first().k
    labels = K.sample_clusters(variable, chosen)
    together = K.coassignment(variable, chosen, replicates)
    return {
        "sample_clusters": spark.createDataFrame(sorted((s, int(c)) for s, c in labels.items()), "sample string, cluster int"),
        "k_metrics": metrics.withColumn("chosen", F.col("k") == chosen),
        "signatures": M.signatures(log, labels),
        "support": K.support(together, labels),
        "weak_pairs": K.weak_pairs(together, labels),
    }


def comparison(table: DataFrame, sims: int = 200_000) -> dict[str, DataFrame]:
    """per_column (one row a stratum) and combined (one row a method) of a stratified count table (j, i, a, b)."""
    spark = table.sparkSession
    each, combined = (rows.astype(object).where(rows.notna(), None) for rows in C.compare(table, sims))
    numbers = [c for c in each.columns if c not in ("j", "dof")]
    kinds = dict(C.per_stratum(table).dtypes)
    return {
        "per_column": spark.createDataFrame(each[["j", "dof", *numbers]].values.tolist(), f"j {kinds['j']}, dof long, " + ", ".join(f"{c} double" for c in numbers)),
        "combined": spark.createDataFrame([(r.method, r.statistic, None if r.dof is None else int(r.dof), r.pvalue) for r in combined.itertuples()], "method string, statistic double, dof long, pvalue double"),
        "proportions": C.proportions(table),
        "consistency": C.row_consistency(table),
    }


def write(tables: dict[str, DataFrame], folder: str, decimals: int = 4) -> None:
    """Each table as a tab-separated folder of its name."""
    for name, rows in tables.items():
        write_table(rows, f"{folder.rstrip('/')}/{name}", decimals)
