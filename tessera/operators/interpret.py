"""Interpretation of annotated regions: space and enrichment, distance bands, metagene, biotypes, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.annotate import DETAIL, UNMAPPED
from tessera.operators.intervals import claim, nearest

#: Size of the genome assembly, and the limits of the distance bands.
GENOME = 3_088_269_832
BANDS = (0, 100, 500, 1_000, 5_000, 10_000, 50_000, 10**12)


def class_space(features: DataFrame, sites: DataFrame) -> DataFrame:
    """(cl, bp): bases owned by each class, by priority and strand, on the chromosomes that sites have."""
    chroms = sites.select("chrom").distinct()
    rows = features.where(F.col("strand").isin("+", "-") & (F.col("e") > F.col("s"))).join(chroms, "chrom", "left_semi")
    owned = claim(rows, ["chrom", "strand"], sorted(DETAIL)).groupBy("cl").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))
    spine = features.sparkSession.range(len(DETAIL)).select(F.col("id").cast("int").alias("k"))
    return spine.join(owned, F.col("k") == F.col("cl"), "left").select(F.col("k").alias("cl"), F.coalesce("bp", F.lit(0)).alias("bp"))


def enrichment(space: DataFrame, annotated: DataFrame) -> DataFrame:
    """(feature, bp, share, observed, expected, log2_fold): mapped sites against the classes' share of bases."""
    seen = annotated.where(F.col("feature_detail") != UNMAPPED).groupBy("feature_detail").agg(F.count("*").alias("observed"))
    names = F.array(*[F.lit(DETAIL[k]) for k in sorted(DETAIL)])
    rows = space.withColumn("feature", F.get(names, F.col("cl"))).join(seen, F.col("feature") == F.col("feature_detail"), "left")
    rows = rows.withColumn("observed", F.coalesce("observed", F.lit(0)))
    every = Window.partitionBy(F.lit(1))  # one row a class
    rows = rows.withColumn("share", F.coalesce(F.col("bp") / F.nullif(F.sum("bp").over(every), F.lit(0)), F.lit(0.0)))
    rows = rows.withColumn("expected", F.col("share") * F.sum("observed").over(every))
    fold = F.when((F.col("expected") > 0) & (F.col("observed") > 0), F.log2(F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0))))
    return rows.select("feature", "bp", "share", "observed", "expected", fold.alias("log2_fold"))


def unmapped_enrichment(space: DataFrame, annotated: DataFrame, genome: int = GENOME) -> DataFrame:
    """One row for the unmapped sites, against the bases of both strands that no class owns."""
    counts = annotated.agg(F.count("*").alias("sites"), F.count_if(F.col("feature_type") == UNMAPPED).alias("observed"))
    rows = space.agg(F.greatest(F.lit(0), 2 * genome - F.sum("bp")).alias("bp")).crossJoin(counts)
    rows = rows.withColumn("expected", F.col("sites") * F.col("bp") / (2 * genome))
    fold = F.when((F.col("expected") > 0) & (F.col("observed") > 0), F.log2(F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0))))
    return rows.select("bp", "observed", "expected", fold.alias("log2_fold"))


def oriented(sites: DataFrame, ends: DataFrame) -> DataFrame:
    """sites with distance to the nearest 3' end, positive downstream; position is the site's last base, 1-based."""
    rows = nearest(sites.withColumn("p", F.col("e").cast("long")), ends, ["chrom", "strand"])
    return rows.withColumn("distance", F.when(F.col("strand") == "-", -F.col("distance")).otherwise(F.col("distance")))


def distance_bands(measured: DataFrame) -> DataFrame:
    """(band, low, downstream, upstream): unmapped sites by distance; 0 is downstream; all seven bands are there."""
    size = F.abs("distance")
    band = F.coalesce(*[F.when((size >= a) & (size < b), i) for i, (a, b) in enumerate(zip(BANDS, BANDS[1:]))])
    rows = measured.where((F.col("feature_type") == UNMAPPED) & F.col("distance").isNotNull()).withColumn("b", band)
    rows = rows.groupBy("b").agg(F.count_if(F.col("distance") >= 0).alias("downstream"), F.count_if(F.col("distance") < 0).alias("upstream"))
    spine = measured.sparkSession.range(len(BANDS) - 1).select(F.col("id").cast("int").alias("band"))
    lows = F.array(*[F.lit(x) for x in BANDS[:-1]])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(rows, F.col("band") == F.col("b"), "left").select("band", F.get(lows, F.col("band")).alias("low"), zero("downstream"), zero("upstream"))


def distance_counts(measured: DataFrame) -> DataFrame:
    """One row: sites tested, exactly on an end, within 50, and unmapped ones without a reference."""
    d = F.col("distance")
    return measured.agg(
        F.count("distance").alias("n_tested"), F.count_if(d == 0).alias("n_exact"), F.count_if(F.abs(d) <= 50).alias("n_within_50"),
        F.count_if(d.isNull() & (F.col("feature_type") == UNMAPPED)).alias("n_no_reference"),
    )


def metagene(annotated: DataFrame, blocks: DataFrame, bins: int = 20, prefix: str = "") -> DataFrame:
    """(bin, n): 3'UTR sites by place in the spliced 3'UTR of their representative transcript, all bins there.

    Sites whose transcript's name does not start with the prefix (ENST for one annotation's own) are left out.
    blocks are (tx, strand, s, e); the offset runs over them in the direction of transcription.
    """
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    w = Window.partitionBy("tx").orderBy(sign * F.col("s"), sign * F.col("e"))
    size = F.col("e") - F.col("s")
    placed = blocks.withColumns({"before": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(size).over(Window.partitionBy("tx"))})
    placed = placed.select(F.col("tx").cast("string").alias("_tx"), F.col("strand").alias("_strand"), F.col("s").alias("bs"), F.col("e").alias("be"), "before", "total")
    sites = annotated.where("feature_detail = '3UTR'").where(F.col("first_tx").startswith(prefix)).select("id", F.col("first_tx"), F.col("s").alias("at"))
    met = sites.join(placed, (F.col("first_tx") == F.col("_tx")) & (F.col("bs") <= F.col("at")) & (F.col("at") < F.col("be")))
    within = F.when(F.col("_strand") == "-", F.col("be") - 1 - F.col("at")).otherwise(F.col("at") - F.col("bs"))
    # overlapping blocks can hold a site twice; the first in transcription counts
    met = met.groupBy("id").agg(F.min_by(F.struct(F.col("before"), within.alias("within"), F.col("total")), F.struct("before", "bs")).alias("x"))
    met = met.withColumn("b", F.least(F.lit(bins - 1), F.floor((F.col("x.before") + F.col("x.within")) / F.col("x.total") * bins)).cast("int"))
    spine = annotated.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(met.groupBy("b").agg(F.count("*").alias("n")), F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def deciles(bins: DataFrame) -> DataFrame:
    """One row (placed, n_first, n_last, ratio) of ``metagene``'s bins: sites in the first and the last tenth, and last to first; null without a first."""
    share = F.col("bin") / F.col("of")
    rows = bins.crossJoin(bins.agg(F.count("*").alias("of")))  # one row
    first, last = F.sum(F.when(share < 0.1, F.col("n")).otherwise(0)), F.sum(F.when(share >= 0.9, F.col("n")).otherwise(0))
    return rows.agg(F.sum("n").alias("placed"), first.alias("n_first"), last.alias("n_last"), (last / F.nullif(first, F.lit(0))).alias("ratio"))


def biotypes(annotated: DataFrame, genes: DataFrame, most: int = 15) -> DataFrame:
    """(gene_type, n): mapped sites by type of their first gene, unknown without one; the ``most`` frequent."""
    first = F.element_at(F.split("gene_ids", ","), 1)
    sites = annotated.where(F.col("feature_type") != UNMAPPED).select(first.alias("gene"))
    types = genes.select(F.col("gene").cast("string").alias("_g"), "gene_type").dropDuplicates(["_g"])
    rows = sites.join(types, F.col("gene") == F.col("_g"), "left").groupBy(F.coalesce("gene_type", F.lit("unknown")).alias("gene_type")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "gene_type").limit(most)


def tally(rows: DataFrame, column: str, most: int | None = None, order: str = "id") -> DataFrame:
    """(column, n) by frequency, ties by first occurrence."""
    got = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first")
    return (got.limit(most) if most else got).drop("_first")


def per_chromosome(annotated: DataFrame) -> DataFrame:
    """Sites of each label by chromosome, one column a label."""
    labels = ["5UTR", "3UTR", "exon", "intron", UNMAPPED]
    rows = annotated.groupBy("chrom").pivot("feature_type", labels).count()
    return rows.select("chrom", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"n_{x.lower()}") for x in labels])


def gene_frequency(annotated: DataFrame, most: int | None = None) -> DataFrame:
    """(gene, n): how many sites name each gene."""
    rows = annotated.where(F.col("gene_names") != "NA").select("id", F.explode(F.split("gene_names", ",")).alias("gene"))
    return tally(rows, "gene", most)


def chrom_order(chrom: str = "chrom") -> list:
    """Sort columns of the natural order: numbers, X and Y, M and MT, the rest; a leading chr does not count."""
    bare = F.regexp_replace(F.col(chrom), "^chr", "")
    tier = F.when(bare.rlike("^[0-9]+$"), 0).when(bare.isin("X", "Y"), 1).when(bare.isin("M", "MT"), 2).otherwise(3)
    return [tier, F.when(tier == 0, bare.try_cast("decimal(38,0)")), F.when(tier < 3, bare).otherwise(F.col(chrom))]
