"""BED and region scans, and sorted or annotated BED sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.annotate import zero_length
from tessera.operators.interpret import chrom_order
from tessera.sources.text import indexed

# The columns after chrom, start, end, name, score, strand of each feature file.
TX = ("transcript_id", "transcript_name", "gene_id", "gene_name", "transcript_type")
LAYOUTS = {
    "genes": ("gene_id", "gene_name", "gene_type"),
    "transcripts": ("transcript_id", "transcript_name", "gene_id", "gene_name", "transcript_type"),
    "exons": ("exon_number", *TX),
    "coding_exons": ("exon_number", *TX),
    "five_prime_utrs": ("block_number", *TX),
    "three_prime_utrs": ("block_number", *TX),
    "introns": ("intron_number", *TX),
}


def _fields(spark: SparkSession, path: str) -> DataFrame:
    value = F.rtrim(F.regexp_replace("value", r"[\r\n]+$", ""))
    return indexed(spark, path).select("row_id", value.alias("value"), F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t").alias("f"))


def read_features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows (chrom, s, e, name, strand, extras) of a feature BED; comments and lines of fewer than six fields are skipped."""
    f = lambda i: F.get("f", i)
    rows = _fields(spark, path).where(~F.col("value").startswith("#") & (F.size("f") >= 6))
    return rows.select(f(0).alias("chrom"), f(1).cast("long").alias("s"), f(2).cast("long").alias("e"), f(3).alias("name"), f(5).alias("strand"), *[f(6 + i).alias(c) for i, c in enumerate(LAYOUTS[kind])])


def read_regions(spark: SparkSession, path: str, mode: str = "pos1") -> DataFrame:
    """Regions (id, chrom, strand, s, e, qs0, qe0, fields) of a BED of three fields or more, ids dense in file order.

    Blank lines, comments, track and browser lines are skipped. The strand is the sixth field, else the fourth if it is
    one, else ``.``. Regions without length become one base long; zero tells them apart.
    """
    v = F.trim("value")
    rows = _fields(spark, path).where((v != "") & ~v.startswith("#") & ~v.startswith("track") & ~v.startswith("browser") & (F.size("f") >= 3))
    strand_of = lambda c: F.when(c.isin("+", "-", "."), c)
    strand = F.coalesce(strand_of(F.get("f", 5)), strand_of(F.get("f", 3)), F.lit("."))
    rows = rows.select("row_id", F.get("f", 0).alias("chrom"), strand.alias("strand"), F.get("f", 1).cast("long").alias("s"), F.get("f", 2).cast("long").alias("e"), F.col("f").alias("fields"))
    rows = zero_length(rows.withColumn("zero", F.col("e") <= F.col("s")), mode)
    return dense(rows, "row_id").withColumnRenamed("row_id", "id")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(id, chrom, strand, p): column two as it is and column four as strand, of lines with four fields or more."""
    rows = _fields(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & (F.size("f") >= 4))
    return dense(rows.select("row_id", F.get("f", 0).alias("chrom"), F.get("f", 3).alias("strand"), F.get("f", 1).cast("long").alias("p")), "row_id").withColumnRenamed("row_id", "id")


def dense(rows: DataFrame, key: str) -> DataFrame:
    """Replaces key, which orders the rows, by 0, 1, 2, ...: ranks within partitions plus the counts before.

    Only one count a partition meets in one place; the rows stay where they are.
    """
    part = rows.withColumn("_p", F.shiftright(key, 33))
    from pyspark.sql import Window

    sizes = part.groupBy("_p").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return part.withColumn("_i", within).join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(key, (F.col("_s") + F.col("_i")).cast("long")).select(*rows.columns)


def bed_name(kind: str) -> Column:
    """The packed name of a feature row."""
    if kind == "genes":
        return F.concat_ws("|", "gene_id", "gene_name")
    if kind == "transcripts":
        return F.concat_ws("|", "transcript_id", "gene_id", "gene_name")
    tag, number = {"exons": ("exon", "exon_number"), "coding_exons": ("CDS", "exon_number"), "five_prime_utrs": ("5UTR", "block_number"), "three_prime_utrs": ("3UTR", "block_number"), "introns": ("intron", "intron_number")}[kind]
    return F.concat_ws("|", "gene_name", "transcript_id", F.concat(F.lit(tag), F.col(number).cast("string")))


def _headed(spark: SparkSession, header: str | None, rows: DataFrame, order: list[str], path: str, single: bool) -> None:
    """The column value as text in the given order, the header (if any) first. The sort deals rows by range, so the parts in order are the file."""
    rows = rows.select(F.lit(1).alias("_body"), *order, "value")
    if header is not None:
        rows = rows.unionByName(spark.createDataFrame([(0, header)], "_body int, value string"), allowMissingColumns=True)
    out = rows.orderBy("_body", *[F.col(c).asc_nulls_first() for c in order]).select("value")
    (out.coalesce(1) if single else out).write.text(path)


def write_bed(rows: DataFrame, path: str, kind: str, header: bool = False, single: bool = False) -> None:
    """Feature rows (chrom, s, e, strand, extras) as BED, in natural order of chrom, then start, end and name; single gives one file.

    Empty intervals are left out.
    """
    extras = LAYOUTS[kind]
    out = rows.where("e > s").withColumn("name", bed_name(kind))
    tiers = {f"_o{i}": c for i, c in enumerate(chrom_order())}
    value = F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), "name", F.lit("0"), "strand", *[F.col(c).cast("string") for c in extras])
    names = "\t".join(["#chrom", "start", "end", "name", "score", "strand", *extras]) if header else None
    _headed(rows.sparkSession, names, out.withColumns(tiers).withColumn("value", value), [*tiers, "s", "e", "name"], path, single)


def write_annotated(annotated: DataFrame, path: str, single: bool = False) -> None:
    """The regions' own fields and the label, in input order."""
    out = annotated.orderBy("id").select(F.concat(F.array_join("fields", "\t"), F.lit("\t"), F.col("feature_type")).alias("value"))
    (out.coalesce(1) if single else out).write.text(path)


# The header of the detailed table.
DETAILED = ("chrom", "start", "end", "strand", "query_start_bed", "query_end_bed", "feature_type", "feature_detail", "gene_id", "gene_name", "transcript_ids", "n_transcripts", "n_genes", "all_features_hit", "gene_context")


def detailed(annotated: DataFrame, *more: str) -> DataFrame:
    """The fifteen columns of the detailed table, and more of the regions'."""
    f = lambda i: F.get("fields", i)
    return annotated.select(
        *more, "chrom", f(1).alias("start"), f(2).alias("end"), "strand", F.col("s").alias("query_start_bed"), F.col("e").alias("query_end_bed"), "feature_type", "feature_detail",
        F.col("gene_ids").alias("gene_id"), F.col("gene_names").alias("gene_name"), "transcript_ids", "n_transcripts", "n_genes", "all_features_hit", "gene_context",
    )


def write_detailed(annotated: DataFrame, path: str, single: bool = False) -> None:
    """The detailed table as tab-separated text, its header first, in input order; nulls are empty."""
    named = detailed(annotated, "id")
    value = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DETAILED])
    _headed(annotated.sparkSession, "\t".join(DETAILED), named.withColumn("value", value), ["id"], path, single)


def read_detailed(spark: SparkSession, path: str) -> DataFrame:
    """The detailed table by the header in its first line; rows shorter than the header are dropped."""
    rows = indexed(spark, path)
    first = rows.orderBy("row_id").limit(1).collect()
    names = first[0].value.split("\t") if first else []
    rows = rows.where(F.col("row_id") != (first[0].row_id if first else -1)).select(F.split("value", "\t").alias("f")).where(F.size("f") >= len(names))
    return rows.select(*[F.get("f", i).alias(c) for i, c in enumerate(names)])
