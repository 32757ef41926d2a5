"""Text, matrix and grid scans, table sinks."""

from __future__ import annotations

import gzip
import io
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _block_bits(spark: SparkSession) -> int:
    """Bits of the largest power of two, 4 MB at most, that no block of a file read by Spark is smaller than (but for its last)."""
    size = lambda name: int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{name}")))
    return max(0, min(22, min(size("maxPartitionBytes"), size("openCostInBytes")).bit_length() - 1))


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): lines with ids that order them as the files, by name, and their lines do.

    An id is the file's number, the place of the block read (in steps no block is smaller than, at most 128 GB), and the
    line's number among those its task has read. What one of these parts cannot hold is an error.
    """
    step = _block_bits(spark)
    rows = spark.read.text(path)
    files = sorted(rows.inputFiles())
    if len(files) > 1 << 17:
        raise ValueError(f"{path} has {len(files)} files")
    most = 9 + step  # bits of a line's number: 46 less those of the blocks
    start, line = F.col("_metadata.file_block_start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    fits = (F.shiftright(start, 37) == 0) & (F.shiftright(line, most) == 0)
    at = F.when(fits, F.shiftleft(F.shiftright(start, step), most) + line).otherwise(F.raise_error(F.lit(f"{path} has too large a file or block to number its lines")).cast("long"))
    bare = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\\+", "%2B")), "^([^:/]+):/+", "$1:/")  # noqa: E731  file:/a and file:///a are one
    rows = rows.select(bare(F.col("_metadata.file_path")).alias("_f"), at.alias("_at"), "value")
    if len(files) <= 1:
        return rows.select(F.col("_at").alias("row_id"), "value")
    ranks = spark.createDataFrame(list(enumerate(files)), "_n long, _g string").withColumn("_g", bare(F.col("_g")))
    known = F.coalesce("_n", F.raise_error(F.concat(F.lit("not a listed file: "), F.col("_f"))).cast("long"))
    rows = rows.join(F.broadcast(ranks), F.col("_f") == F.col("_g"), "left")  # one row a file
    return rows.select((F.shiftleft(known, 46) + F.col("_at")).alias("row_id"), "value")


def maybe_gzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of files that are gzip by their first bytes, whatever their names.

    A file is one task's, which holds its bytes as they are stored and unpacks them as lines are read.
    """

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                raw = io.BytesIO(content)
                lines = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, "utf-8", "replace")
                at = 0
                while part := [line.removesuffix("\n") for line in islice(lines, 10_000)]:
                    yield pd.DataFrame({"path": p, "line_no": range(at, at + len(part)), "value": part})
                    at += len(part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line_no long, value string")


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Wide matrix (row_id, gene, one double column a sample) by its header; a ragged or non-numeric row is an error."""
    rows = indexed(spark, path).where(F.trim("value") != "")
    first = rows.orderBy("row_id").limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    names = first[0].value.rstrip("\r").split(sep)
    f = F.split(F.regexp_replace("value", "\r$", ""), sep)
    body = rows.where(F.col("row_id") != first[0].row_id).select("row_id", f.alias("f"))
    bad = F.raise_error(F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(f" has not {len(names)} fields")))
    f = F.when(F.size("f") == len(names), F.col("f")).otherwise(bad)
    body = body.withColumn("f", f)
    return body.select("row_id", F.col("f")[0].alias("gene"), *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(names) if i])


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), both from 1, of a headerless grid of numbers apart by white space."""
    from tessera.sources.bed import dense

    rows = dense(indexed(spark, path).where(F.trim("value") != ""), "row_id")
    cells = rows.select((F.col("row_id") + 1).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "v"))
    return cells.select("row", (F.col("c") + 1).alias("col"), F.col("v").cast("double").alias("value"))


def read_gene_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cluster) of a table with a header."""
    return spark.read.csv(path, sep="\t", header=True).select("gene", F.col("cluster").cast("int").alias("cluster"))


def write_table(df: DataFrame, path: str, decimals: int | None = 4, single: bool = True) -> None:
    """A result table with a header, tab-separated; doubles at a fixed number of decimals."""
    cols = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if kind == "double" and decimals is not None else F.col(c) for c, kind in df.dtypes]
    out = df.select(*cols)
    (out.coalesce(1) if single else out).write.csv(path, sep="\t", header=True)
