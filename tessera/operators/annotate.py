"""Annotation of regions with feature classes, by stranded overlap and class priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import nearest_of_points, overlap
from tessera.sources.scratch import cut

# The classes in order of priority, their detail names and the labels these collapse to.
DETAIL = {0: "CDS", 1: "5UTR", 2: "3UTR", 3: "noncoding_exon", 4: "intron"}
LABEL = {0: "exon", 1: "5UTR", 2: "3UTR", 3: "exon", 4: "intron"}
UNMAPPED, MISSING, INTERGENIC = "UN", "NA", "intergenic"
#: Rows of ends of features (64 positions a row, about 15 MB in all) that are broadcast.
BROADCAST = 250_000


def _named(names: dict[int, str], c: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(names[k]) for k in sorted(names)]), c), F.lit(UNMAPPED))


def isoforms(features: DataFrame) -> DataFrame:
    """One row for each (cl, chrom, strand, s, e, gene): representative transcript (smallest name) and count."""
    name = "name" if "name" in features.columns else "tx"
    return features.groupBy("cl", "chrom", "strand", "s", "e", "gene").agg(F.min_by("tx", name).alias("rep"), F.count("*").alias("n"))


def zero_length(rows: DataFrame, mode: str = "pos1") -> DataFrame:
    """Regions (s, e) with e <= s made one base long: (s - 1, s) for 1-based positions, (s, s + 1) for bed0."""
    if mode not in ("pos1", "bed0"):
        raise ValueError(f"unknown point mode {mode!r}")
    flat = F.col("e") <= F.col("s")
    s, e = (F.col("s") - 1, F.col("s")) if mode == "pos1" else (F.col("s"), F.col("s") + 1)
    return rows.withColumns({"s": F.when(flat, s).otherwise(F.col("s")), "e": F.when(flat, e).otherwise(F.col("e"))})


def _joined(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ",")


def _short(names: Column) -> Column:
    """The first three names and how many more there are."""
    some = F.array_join(F.slice(names, 1, 3), ",")
    return F.when(F.size(names) > 3, F.concat(some, F.lit(",(+"), (F.size(names) - 3).cast("string"), F.lit(" more)"))).otherwise(some)


def _placed(regions: DataFrame, features: DataFrame, most: int = BROADCAST) -> DataFrame:
    """regions with _place: those with the same chrom, strand and _place overlap the same features (chrom, s, e); null without a base.

    A feature overlaps unless it starts after the last base or ends at the first or before. So a place is, for each of the
    two bases, the stretch of 64 positions that holds it and how many starts and ends of features this has up to the base.
    """
    ends = features.where("e > s").select(F.col("chrom").alias("_of"), F.explode(F.array(F.col("s").cast("long"), F.col("e").cast("long"))).alias("_p"))
    bits = F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("_bits")
    ends = cut(ends.groupBy("_of", F.shiftright("_p", 6).alias("_stretch")).agg(bits), "ends")
    ends = F.broadcast(ends) if ends.count() <= most else ends
    upto = []
    for n, base in enumerate((F.col("s"), F.col("e") - 1)):
        side = ends.select(*[F.col(c).alias(f"{c}{n}") for c in ends.columns])
        regions = regions.withColumn("_base", base.cast("long"))
        regions = regions.join(side, (F.col("chrom") == F.col(f"_of{n}")) & (F.shiftright("_base", 6) == F.col(f"_stretch{n}")), "left")
        count = F.expr(f"coalesce(bit_count(_bits{n} & shiftrightunsigned(-1L, 63 - cast(_base & 63 as int))), 0)")
        regions = regions.withColumn(f"_upto{n}", F.struct(F.shiftright("_base", 6).alias("stretch"), count.alias("n")))
        upto.append(f"_upto{n}")
    place = F.when(F.col("e") > F.col("s"), F.struct(*upto))
    return regions.withColumn("_place", place).drop("_base", *upto, *[f"{c}{n}" for c in ends.columns for n in (0, 1)])


def annotate(regions: DataFrame, features: DataFrame, genes: DataFrame | None = None, stranded: bool = True, names: DataFrame | None = None) -> DataFrame:
    """One row for each region (id, chrom, strand, s, e): labels, winners and counts; unmapped regions are UN.

    features are rows of ``isoforms``; gene bodies (chrom, strand, s, e, gene_name) give gene_context; names (gene,
    gene_name) gives gene names, else the gene id stands for its name. A region of strand ``.`` agrees with any strand.
    alt_strand_label is the label of the other view (strands ignored, or heeded). What regions overlap is found once for
    all regions of the same place.
    """
    own = regions.columns
    features = cut(features, "features")
    bodies = features.select("chrom", "s", "e")
    if genes is not None:
        genes = cut(genes, "genes")
        bodies = bodies.unionByName(genes.select("chrom", "s", "e"))
    regions = _placed(regions, bodies)
    at = ["_chrom", "qstrand", "_at"]
    q = regions.where("_place is not null").groupBy("chrom", F.col("strand").alias("qstrand"), F.col("_place").alias("_at")).agg(F.min(F.struct("s", "e")).alias("_r"))
    q = q.select("chrom", F.col("chrom").alias("_chrom"), "qstrand", "_at", F.col("_r.s").alias("qs"), F.col("_r.e").alias("qe"))
    here = (F.col("chrom") == F.col("_chrom")) & F.col("strand").eqNullSafe(F.col("qstrand")) & (F.col("_place") == F.col("_at"))
    agrees = (F.col("qstrand") == ".") | (F.col("qstrand") == F.col("strand"))
    hits = overlap(q, features, ["chrom"]).withColumn("agrees", agrees)
    if names is not None:
        hits = hits.join(names.select(F.col("gene").alias("_g"), "gene_name"), F.col("gene") == F.col("_g"), "left").drop("_g")
    else:
        hits = hits.withColumn("gene_name", F.col("gene").cast("string"))
    view = F.col("agrees") if stranded else F.lit(True)
    other = F.lit(True) if stranded else F.col("agrees")
    hits = hits.withColumn("v", view)
    # per class first, so that the winners need no second pass over the hits
    per = hits.groupBy(*at, "cl").agg(
        F.count_if("v").alias("in_view"),
        F.count_if(other).alias("in_other"),
        F.collect_set(F.when(F.col("v"), F.col("gene").cast("string"))).alias("genes"),
        F.collect_set(F.when(F.col("v"), F.col("gene_name"))).alias("names"),
        F.collect_set(F.when(F.col("v"), F.col("rep").cast("string"))).alias("reps"),
        F.sum(F.when(F.col("v"), F.col("n")).otherwise(0)).alias("n"),
    )
    won = F.col("in_view") > 0
    top = lambda c: F.min_by(F.when(won, F.col(c)), F.when(won, F.col("cl")))
    best = per.groupBy(*at).agg(
        F.min(F.when(won, F.col("cl"))).alias("cl"),
        F.min(F.when(F.col("in_other") > 0, F.col("cl"))).alias("alt"),
        top("genes").alias("genes"), top("names").alias("names"), top("reps").alias("reps"), top("n").alias("n_transcripts"),
        F.array_sort(F.collect_set(F.when(won, F.col("cl")))).alias("classes"),
    )
    mapped = F.col("cl").isNotNull()
    named = {
        "feature_type": (_named(LABEL, F.col("cl")), UNMAPPED),
        "feature_detail": (_named(DETAIL, F.col("cl")), UNMAPPED),
        "gene_ids": (F.when(mapped, _joined(F.col("genes"))), MISSING),
        "gene_names": (F.when(mapped, _joined(F.col("names"))), MISSING),
        "transcript_ids": (F.when(mapped, _short(F.array_sort("reps"))), MISSING),
        "first_tx": (F.when(mapped, F.array_sort("reps")[0]), MISSING),
        "n_transcripts": (F.when(mapped, F.col("n_transcripts")), 0),
        "n_genes": (F.when(mapped, F.size("genes").cast("long")), 0),
        "all_features_hit": (F.when(mapped, F.array_join(F.transform("classes", lambda c: _named(DETAIL, c)), ";")), UNMAPPED),
        "alt_strand_label": (_named(LABEL, F.col("alt")), UNMAPPED),
    }
    of = best.select(*[F.col(c).alias(f"_of{c}") for c in at], *[v.alias(f"_v_{k}") for k, (v, _) in named.items()])
    alike = lambda side: [F.col(c).eqNullSafe(F.col(f"{side}{c}")) for c in at]
    places = q.select(*at).join(of, alike("_of"), "left").drop(*[f"_of{c}" for c in at])
    if genes is not None:
        near = overlap(q, genes, ["chrom"]).where(agrees if stranded else F.lit(True))
        context = near.groupBy(*[F.col(c).alias(f"_in{c}") for c in at]).agg(_joined(F.collect_set("gene_name")).alias("_v_gene_context"))
        places = places.join(context, alike("_in"), "left").drop(*[f"_in{c}" for c in at])
    rows = regions.join(places, here, "left")
    out = rows.select(*own, *[F.coalesce(f"_v_{k}", F.lit(none)).alias(k) for k, (_, none) in named.items()], *(["_v_gene_context"] if genes is not None else []))
    return out if genes is None else out.withColumn("gene_context", F.coalesce("_v_gene_context", F.lit(INTERGENIC))).drop("_v_gene_context")


def summary(annotated: DataFrame) -> DataFrame:
    """One row: regions, mapped ones, those of several genes, and those whose label the strand view changes."""
    return annotated.agg(
        F.count("*").alias("n_regions"),
        F.count_if(F.col("feature_type") != UNMAPPED).alias("n_mapped"),
        F.count_if(F.col("n_genes") > 1).alias("n_multi_gene"),
        F.count_if(F.col("feature_type") != F.col("alt_strand_label")).alias("n_strand_flips"),
    )


def three_prime(rows: DataFrame, end: str = "3") -> DataFrame:
    """(chrom, strand, p): 1-based 3' ends (or 5' ends) of intervals; any strand but ``-`` reads as ``+``."""
    minus = F.col("strand") == "-"
    up, down = (F.col("s") + 1, F.col("e"))
    p = F.when(minus, up if end == "3" else down).otherwise(down if end == "3" else up)
    return rows.select("chrom", "strand", p.cast("long").alias("p"))


def end_histogram(positions: DataFrame, references: DataFrame, window: int = 10) -> DataFrame:
    """(offset, n, share): sites by signed distance to the nearest reference end, every offset of the window there.

    share is in percent of the sites that have a reference; the offset with the highest n, first if tied, is the peak.
    """
    keys = ["chrom", "strand"]
    points = positions.groupBy(*keys, "p").agg(F.count("*").alias("_n"))
    counts = cut(nearest_of_points(points, references, keys).where("distance is not null").groupBy("distance").agg(F.sum("_n").alias("n")), "distances")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    spine = positions.sparkSession.range(-window, window + 1).select(F.col("id").alias("offset"))
    rows = spine.join(F.broadcast(counts.where(F.abs("distance") <= window)), F.col("offset") == F.col("distance"), "left")  # at most 2 * window + 1 rows
    rows = rows.crossJoin(F.broadcast(total))  # one row
    return rows.select("offset", F.coalesce("n", F.lit(0)).alias("n"), (100 * F.coalesce("n", F.lit(0)) / F.nullif(F.col("total"), F.lit(0))).alias("share"))


def histogram_peak(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("peak"), F.max("n").alias("n"))
