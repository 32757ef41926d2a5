"""Whole files as rows: listing, kinds and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.documents import kind_of


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, kind, length) of the files under path, by name; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", kind_of(F.col("path")).alias("kind"), "length").orderBy("path")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text) of the files under path; bytes that are no UTF-8 become the replacement character."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", kind_of(F.col("path")).alias("kind"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
