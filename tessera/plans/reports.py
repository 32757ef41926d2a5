"""Text reports: named sections, each a small summary table, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import annotate as A
from tessera.operators import contingency as C
from tessera.operators import features as G
from tessera.operators import interpret as T
from tessera.operators import matrix as M

#: Rows of a section that are shown; the summaries are smaller but for names of genes and chromosomes.
MOST = 50


def section(title: str, rows: DataFrame, most: int = MOST) -> str:
    """Title, header and the first rows, columns aligned; says how many rows it leaves out, if any."""
    got = rows.limit(most + 1).collect()
    cells = [rows.columns, *([_cell(v) for v in r] for r in got[:most])]
    width = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in cells]
    more = ["(more rows)"] if len(got) > most else []
    return "\n".join([title, "-" * len(title), *lines, *more])


def _cell(v: object) -> str:
    if v is None:
        return "n/a"
    return f"{v:,.4f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


def report(parts: dict[str, DataFrame]) -> str:
    return "\n\n".join(section(t, df) for t, df in parts.items()) + "\n"


def annotation(annotated: DataFrame) -> str:
    """Labels, details, combinations, context, strands, chromosomes and genes of annotated regions."""
    return report({
        "Regions": A.summary(annotated),
        "Labels": T.tally(annotated, "feature_type"),
        "Details": T.tally(annotated, "feature_detail"),
        "Combinations": T.tally(annotated, "all_features_hit", 10),
        "By chromosome": T.per_chromosome(annotated).orderBy(*T.chrom_order()),
        "Genes": T.gene_frequency(annotated, 20),
    })


def extraction(transcripts: DataFrame, exons: DataFrame, cds: DataFrame, shipped: DataFrame | None = None) -> str:
    """Counts of transcripts and their parts, and, where untranslated regions came with the annotation, how ours agree."""
    parts = {"Transcripts": G.transcript_stats(transcripts, exons, cds)}
    if shipped is not None:
        parts["Agreement of untranslated regions"] = G.agreement(G.utr_check(exons, cds, shipped))
    return report(parts)


def interpretation(annotated: DataFrame, space: DataFrame, measured: DataFrame, blocks: DataFrame, genes: DataFrame) -> str:
    """Enrichment of labels over their space, unmapped sites near ends, places in 3' untranslated regions, and gene types."""
    bins = T.metagene(annotated, blocks)
    return report({
        "Enrichment": T.enrichment(space, annotated),
        "Unmapped": T.unmapped_enrichment(space, annotated),
        "Distance bands": T.distance_bands(measured).orderBy("band"),
        "Near an end": T.distance_counts(measured),
        "Metagene": bins.orderBy("bin"),
        "First and last tenth": T.deciles(bins),
        "Gene types": T.biotypes(annotated, genes),
    })


def genes(matrix: DataFrame, tables: dict[str, DataFrame]) -> str:
    """Quality, the choice of k and the clusters of ``tables.genes``."""
    return report({
        "Samples": M.qc(matrix).orderBy("sample"),
        "Matrix": M.qc_overall(matrix),
        "Numbers of clusters": tables["k_metrics"].orderBy("k"),
        "Clusters": tables["cluster_summaries"].orderBy("cluster"),
        "Agreement with Ward's linkage": tables["agreement"],
        "Profiles": tables["profiles"].orderBy("cluster", "sample"),
    })


def samples(tables: dict[str, DataFrame]) -> str:
    """The clusters of ``tables.samples``, their support and their first signature genes."""
    return report({
        "Numbers of clusters": tables["k_metrics"].orderBy("k"),
        "Clusters": tables["sample_clusters"].orderBy("cluster", "sample"),
        "Support": tables["support"],
        "Weak pairs": tables["weak_pairs"].orderBy("support", "s1", "s2"),
        "Signatures": tables["signatures"].where("rank <= 5").orderBy("cluster", "direction", "rank"),
    })


def comparison(tables: dict[str, DataFrame], alpha: float = 0.05) -> str:
    """The strata, those below alpha and the others, and the combined tests of ``tables.comparison``."""
    low, high = C.significance_split(tables["per_column"], "g_p", alpha)
    return report({
        "Strata": tables["per_column"].orderBy("j"),
        f"Significant at {alpha}": low.select("j", "g_p").orderBy("j"),
        "Not significant": high.select("j", "g_p").orderBy("j"),
        "Combined": tables["combined"],
        "Shares": tables["proportions"].orderBy("j", "i"),
        "Same direction everywhere": tables["consistency"].orderBy("i"),
    })
