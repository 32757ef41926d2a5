"""Order at scale: running sums and ranks over range partitions, exact quantiles by counting.

Neither needs a task that holds all rows of a key. Running sums: rows are dealt by range of (keys, order), a range adds up
its own rows, and the sums of the ranges before it are carried in. Quantiles: values are counted by slots of their size,
the slots that hold the wanted ranks are cut finer, and so on until a slot holds a single value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import cut

#: Slots that an interval of values is cut into.
SLOTS = 65_536


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """rows with a column ``into``: the sum of value over the rows of the same keys up to this one in the order.

    Rows alike in keys and order have their values added up one after the other, in any order.
    """
    own = rows.columns
    ranged = rows.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")  # what the sums and the rows read is then the same partitioning
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_v").alias("_s"))
    sums = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), F.sum("_s").over(earlier).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumn("_in", F.sum("_v").over(within))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_part") == F.col("_of_part")]
    return inner.join(sums, same).select(*own, (F.coalesce("_before", F.lit(0)) + F.col("_in")).alias(into))


def row_numbers(rows: DataFrame, keys: list[str], order: list[str], into: str = "rank") -> DataFrame:
    """rows with their number, from 1, among the rows of the same keys."""
    return running(rows, keys, order, F.lit(1).cast("long"), into)


def average_ranks(rows: DataFrame, keys: list[str], value: str, into: str = "rank") -> DataFrame:
    """(keys, value, n, into): each distinct value, how often it occurs, and the mean of its occurrences' ranks."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, keys, [value], F.col("n"), "_upto").withColumn(into, F.col("_upto") - (F.col("n") - 1) / 2).drop("_upto")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, share, value): exact quantiles of each key's values, between two neighbouring values by linear interpolation.

    Nulls and NaN do not count; a key without values gives no rows. rows are read once for each of at most about six
    rounds, so cut what is costly to derive. What reaches the driver has two rows a quantile.
    """
    v = F.col(value).cast("double")
    cells = rows.select(*keys, v.alias("_v")).where("_v is not null and not isnan(_v)")
    kinds = [T.StructField(f"_of_{k}", rows.schema[k].dataType) for k in keys]
    magnitude = F.coalesce(F.floor(F.least(F.log2(F.abs("_v")), F.lit(2_000.0))) + 2_000, F.lit(0))
    slots = cells.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.lit(None).cast("double").alias("_lo"), (F.signum("_v") * magnitude).cast("long").alias("_slot"), "_v")
    of = [f"_of_{k}" for k in keys]
    found: dict[tuple, float] = {}  # (key, rank): value
    wanted: dict[tuple, list[tuple[float, int, float]]] = {}  # key: (share, lower rank, fraction)
    asked: dict[tuple, list[int]] = {}  # (key, lowest value of the slot): ranks within the slot
    skipped: dict[tuple, int] = {}  # rows before that slot
    first = True
    while True:
        order = Window.partitionBy(*of, "_lo").orderBy("_slot")  # SLOTS rows at most
        counts = slots.groupBy(*of, "_lo", "_slot").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        counts = counts.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(Window.partitionBy(*of, "_lo"))})
        if first:
            ranks = F.flatten(F.array(*[F.array(F.floor((F.col("_all") - 1) * s), F.ceil((F.col("_all") - 1) * s)) for s in shares]))
            counts = counts.withColumn("_rank", F.explode(F.array_distinct(ranks)))
        else:
            fields = [*kinds, T.StructField("_at", T.DoubleType()), T.StructField("_rank", T.LongType())]
            few = rows.sparkSession.createDataFrame([(*k, lo, r) for (k, lo), rs in asked.items() for r in rs], T.StructType(fields)).withColumnsRenamed({c: f"{c}2" for c in of})
            counts = counts.join(F.broadcast(few), [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in of] + [F.col("_lo") == F.col("_at")])  # two rows a quantile
        got = counts.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))).collect()
        open_, before, ends = {}, {}, {}
        for r in got:
            key = tuple(r[c] for c in of)
            if first and key not in wanted:
                spots = [(s, (r._all - 1) * s) for s in shares]
                wanted[key] = [(s, math.floor(h), h - math.floor(h)) for s, h in spots]
            skip = 0 if first else skipped[key, r._lo]
            if r._least == r._most:
                found[key, r._rank + skip] = r._least
            else:
                inside = r._upto - r._n
                open_.setdefault((key, r._least), []).append(r._rank - inside)
                before[key, r._least] = skip + inside
                ends[key, r._least] = r._most
        if not open_:
            break
        asked, skipped, first = open_, before, False
        fields = [*kinds, T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())]
        narrow = rows.sparkSession.createDataFrame([(*k, lo, ends[k, lo]) for k, lo in asked], T.StructType(fields))
        met = cells.join(F.broadcast(narrow), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")])
        slots = met.select(*of, "_lo", F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (SLOTS - 1)).alias("_slot"), "_v")
    out = []
    for key, spots in wanted.items():
        for share, low, part in spots:
            a = found[key, low]
            out.append((*key, share, a if part == 0 else a + (found[key, low + 1] - a) * part))
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField("share", T.DoubleType()), T.StructField("value", T.DoubleType())]
    return rows.sparkSession.createDataFrame(out, T.StructType(fields))
