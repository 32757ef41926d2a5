"""Features derived from a transcript's exons and coding blocks: introns, untranslated regions, self check.

Exons are rows (tx, strand, s, e, xn) and more; coding blocks rows (tx, s, e).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.intervals import merge


def introns(exons: DataFrame, keep: tuple[str, ...] = ("gene", "chrom", "strand")) -> DataFrame:
    """Gaps between consecutive exons of a transcript, numbered in the direction of transcription.

    Exons are ordered by (s, e, xn); abutting or overlapping neighbours leave no gap and take no number.
    """
    w = Window.partitionBy("tx").orderBy("s", "e", "xn")
    gaps = exons.withColumn("nx", F.lead("s").over(w)).where("nx > e").select("tx", *keep, F.col("e").alias("s"), F.col("nx").alias("e"))
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    order = Window.partitionBy("tx").orderBy(sign * F.col("s"), sign * F.col("e"))
    return gaps.withColumn("intron", F.row_number().over(order))


def with_stop_codons(cds: DataFrame, stops: DataFrame) -> DataFrame:
    """Coding blocks merged with the stop codons of the same transcript."""
    return merge(cds.select("tx", "s", "e").unionByName(stops.select("tx", "s", "e")), ["tx"])


def utr_pieces(exons: DataFrame, cds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tx, strand, ps, pe, side) and the columns of exons to keep: parts of exons outside the coding blocks of coding transcripts.

    side is U before the coding span, D after it, A where a piece reaches into it. A transcript's coding blocks, of which
    there are no more than it has exons, come to each of its exons as one array.
    """
    block = F.struct("s", "e")
    coding = cds.groupBy(F.col("tx").alias("_tx")).agg(F.min("s").alias("cmin"), F.max("e").alias("cmax"), F.array_sort(F.collect_set(block)).alias("_holes"))
    rows = exons.select("tx", *keep, "strand", "s", "e").distinct().join(coding, F.col("tx") == F.col("_tx"))
    met = F.filter("_holes", lambda h: (h["e"] > F.col("s")) & (h["s"] < F.col("e")))
    end = F.array(F.struct(F.col("e").alias("s"), F.col("e").alias("e")))
    none = F.array().cast("array<struct<ps: bigint, pe: bigint>>")
    start = F.struct(F.col("s").cast("long").alias("at"), none.alias("out"))
    # from hole to hole: what lies between the furthest end so far and the next start is a piece
    step = lambda a, h: F.struct(
        F.greatest(a["at"], h["e"].cast("long")).alias("at"),
        F.when(h["s"] > a["at"], F.concat(a["out"], F.array(F.struct(a["at"].alias("ps"), h["s"].cast("long").alias("pe"))))).otherwise(a["out"]).alias("out"),
    )
    pieces = rows.select("tx", *keep, "strand", "cmin", "cmax", F.inline(F.aggregate(F.concat(met, end), start, step, lambda a: a["out"])))
    side = F.when(F.col("pe") <= F.col("cmin"), "U").when(F.col("ps") >= F.col("cmax"), "D").otherwise("A")
    return pieces.withColumn("side", side).select("tx", *keep, "strand", "ps", "pe", "side", "cmin", "cmax")


def utrs(exons: DataFrame, cds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(cls, tx, strand, s, e, blk) and the columns of exons to keep: 5UTR and 3UTR blocks numbered from 5' to 3'.

    A piece that reaches into the coding span is clipped to its parts outside; what lies inside gives no row.
    """
    p = utr_pieces(exons, cds, keep)
    before = F.struct(F.col("ps"), F.least("pe", "cmin").alias("pe"), F.lit("U").alias("side"))
    after = F.struct(F.greatest("ps", "cmax").alias("ps"), F.col("pe"), F.lit("D").alias("side"))
    parts = p.select("tx", *keep, "strand", F.inline(F.filter(F.array(before, after), lambda x: x["ps"] < x["pe"])))
    cls = F.when((F.col("side") == "U") == (F.col("strand") != "-"), "5UTR").otherwise("3UTR")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    order = Window.partitionBy("tx", "cls").orderBy(sign * F.col("ps"), sign * F.col("pe"))
    return parts.withColumn("cls", cls).withColumn("blk", F.row_number().over(order)).select("cls", "tx", *keep, "strand", F.col("ps").alias("s"), F.col("pe").alias("e"), "blk")


def utr_check(exons: DataFrame, cds: DataFrame, shipped: DataFrame) -> DataFrame:
    """(tx, n_both, n_ours, n_theirs): derived pieces, unclipped, against shipped (tx, s, e) blocks of coding transcripts."""
    ours = utr_pieces(exons, cds).select("tx", F.col("ps").alias("s"), F.col("pe").alias("e")).distinct().withColumn("o", F.lit(1))
    theirs = shipped.select("tx", "s", "e").distinct().join(cds.select("tx").distinct(), "tx", "left_semi").withColumn("t", F.lit(1))
    both = ours.join(theirs, ["tx", "s", "e"], "full")
    o, t = F.col("o").isNotNull(), F.col("t").isNotNull()
    return both.groupBy("tx").agg(F.count_if(o & t).alias("n_both"), F.count_if(o & ~t).alias("n_ours"), F.count_if(t & ~o).alias("n_theirs"))


def agreement(check: DataFrame) -> DataFrame:
    """One row: transcripts, transcripts that differ, and the share of derived blocks that are shipped too, in percent."""
    ours = F.sum(F.col("n_both") + F.col("n_ours"))
    return check.agg(
        F.count("*").alias("n_transcripts"),
        F.count_if((F.col("n_ours") > 0) | (F.col("n_theirs") > 0)).alias("n_differing"),
        F.coalesce(F.sum("n_both"), F.lit(0)).alias("n_both"),
        F.round(100 * F.sum("n_both") / F.nullif(ours, F.lit(0)), 4).alias("agreement"),
    )


def noncoding_exons(exons: DataFrame, cds: DataFrame) -> DataFrame:
    return exons.join(cds.select("tx").distinct(), "tx", "left_anti")


def transcript_stats(transcripts: DataFrame, exons: DataFrame, cds: DataFrame) -> DataFrame:
    """One row: transcripts, coding, without exons, of a single exon, with an ambiguous untranslated piece."""
    n = exons.groupBy("tx").agg(F.count("*").alias("n_exons"))
    coding = cds.select("tx").distinct().withColumn("c", F.lit(1))
    odd = utr_pieces(exons, cds).where("side = 'A'").select("tx").distinct().withColumn("a", F.lit(1))
    rows = transcripts.select("tx").distinct().join(n, "tx", "left").join(coding, "tx", "left").join(odd, "tx", "left")
    return rows.agg(
        F.count("*").alias("n_transcripts"), F.count("c").alias("n_coding"), F.count_if(F.col("n_exons").isNull()).alias("n_no_exon"),
        F.count_if(F.col("n_exons") == 1).alias("n_single_exon"), F.count("a").alias("n_ambiguous"),
    )
