"""GTF: scan, attributes, and the gene, transcript and child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.text import indexed

# The feature types read, the attributes kept, and the pattern of an attribute.
FEATURES = ("gene", "transcript", "exon", "CDS", "UTR", "stop_codon")
KEYS = ("gene_id", "gene_name", "gene_type", "transcript_id", "transcript_name", "transcript_type", "exon_number")
ATTRIBUTE = r'(\S+)\s+"?([^";]+)"?;'


def attributes(text: Column, keys: tuple[str, ...] | list[str] = KEYS) -> list[Column]:
    """One column for each wanted key: its last value, null if the key is missing."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))

    def last(key: str) -> Column:
        return F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(-1)).alias(key)

    return [last(k) for k in keys]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files, gzip or plain by extension; line_no orders lines as the files do."""
    return indexed(spark, path).withColumnRenamed("row_id", "line_no")


def scan(spark: SparkSession, path: str, types: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows (line_no, chrom, feature, s, e, strand, one column an attribute); s is 0-based, the interval half-open.

    Comments and lines without nine fields are skipped; the feature type is tested before attributes are parsed.
    """
    f = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").startswith("#")).select("line_no", f.alias("f")).where((F.size("f") == 9) & F.get("f", F.lit(2)).isin(*types))
    f = lambda i: F.get("f", F.lit(i))  # noqa: E731  conditions may be tested in any order, so short lines must not raise
    return rows.select(
        "line_no", f(0).alias("chrom"), f(2).alias("feature"), (f(3).cast("long") - 1).alias("s"), f(4).cast("long").alias("e"), f(6).alias("strand"),
        *attributes(f(8)),
    )


def genes(gtf: DataFrame) -> DataFrame:
    """Genes by id, the last line of an id counting; a missing name is the id, a missing type NA."""
    rows = gtf.where((F.col("feature") == "gene") & F.col("gene_id").isNotNull())
    row = F.struct("chrom", "s", "e", "strand", F.coalesce("gene_name", "gene_id").alias("gene_name"), F.coalesce("gene_type", F.lit("NA")).alias("gene_type"))
    return rows.groupBy("gene_id").agg(F.max_by(row, "line_no").alias("r")).select("gene_id", "r.*")


def transcripts(gtf: DataFrame) -> DataFrame:
    """Transcripts by id, the last line of an id counting; line_no is that line."""
    rows = gtf.where((F.col("feature") == "transcript") & (F.coalesce("transcript_id", F.lit("")) != ""))
    row = F.struct(
        "chrom", "s", "e", "strand", "line_no", F.coalesce("transcript_name", "transcript_id").alias("transcript_name"),
        F.coalesce("gene_id", F.lit("NA")).alias("gene_id"), F.coalesce("gene_name", "gene_id", F.lit("NA")).alias("gene_name"),
        F.coalesce("transcript_type", F.lit("NA")).alias("transcript_type"),
    )
    return rows.groupBy("transcript_id").agg(F.max_by(row, "line_no").alias("r")).select("transcript_id", "r.*")


def children(gtf: DataFrame, feature: str) -> DataFrame:
    """Rows (tx, gene, gene_name, tx_name, tx_type, chrom, strand, s, e, xn) of one child type, after their transcript's line.

    Children of no transcript are dropped; exon numbers stay text, "0" if missing.
    """
    t = transcripts(gtf).select(F.col("transcript_id").alias("tx"), F.col("gene_id").alias("gene"), "gene_name", F.col("transcript_name").alias("tx_name"), F.col("transcript_type").alias("tx_type"), "chrom", "strand", F.col("line_no").alias("_at"))
    rows = gtf.where(F.col("feature") == feature).select("transcript_id", "s", "e", F.coalesce("exon_number", F.lit("0")).alias("xn"), "line_no")
    return rows.join(t, (F.col("transcript_id") == F.col("tx")) & (F.col("line_no") > F.col("_at"))).select("tx", "gene", "gene_name", "tx_name", "tx_type", "chrom", "strand", "s", "e", "xn")


def orphans(gtf: DataFrame) -> DataFrame:
    """Number of child lines, by feature, whose transcript is missing or comes later."""
    t = transcripts(gtf).select(F.col("transcript_id").alias("_t"), F.col("line_no").alias("_at"))
    rows = gtf.where(~F.col("feature").isin("gene", "transcript")).join(t, (F.col("transcript_id") == F.col("_t")) & (F.col("line_no") > F.col("_at")), "left_anti")
    return rows.groupBy("feature").agg(F.count("*").alias("n"))
