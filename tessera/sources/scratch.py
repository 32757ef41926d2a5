"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir (under the warehouse where that is unset), removed when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    made = f"{folder.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    _made.append((spark, made))
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: what reads it several times computes it once, and a lost executor costs no earlier stage."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@atexit.register
def _clean() -> None:
    for spark, made in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(made)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return
