"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most ``most`` times its size; what is above goes to the
others by weight. Complete epochs come first. The rest of a target is a weighted sample without replacement:
documents ordered by exponential keys -ln(u) / quality, taken while the running sum of words stays within the rest.
The running sum needs no global order: keys fall into ``BUCKETS`` ranges of their logarithm, none of which holds more
than about a thousandth of a source's documents whatever their quality. The ranges' sums say which one holds the cut,
and only inside this one are documents ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, cut, read

WEIGHTS, MOST, BUCKETS = (5, 2, 1), 3, 16384
#: Sources whose rows (about 60 bytes each) are broadcast; more go through a shuffle join.
BROADCAST = 50_000


def quality(text: Column, words: Column) -> Column:
    """Weight in (0, 1]: lower with more symbols a word."""
    return F.greatest(F.lit(0.05), 1 / (1 + F.regexp_count(text, F.lit(r"[#*$%&|<>!]")) / F.greatest(words, F.lit(1))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Where l is the words a unit of weight gets, a target is min(most * size, l * weight); l is found by filling the
    sources in the order of the l at which they are full. One row a source goes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("full", most * F.col("source_size") / F.col("w"))
    up = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("full"), F.col("level")))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = most * F.col("source_size").cast("double")
    return rows.select("source", "source_size", F.coalesce(F.least(full, F.col("level") * F.col("w")), full).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, key, size, source, source_size, target, copies, taken) for each row of docs.

    copies is how often the mix holds the row, taken = copies * size. key is a hash of the row's id, source and text,
    from which the sampling key comes, so reruns agree. The document at the cut is taken if that brings the source
    nearer to its target. A null text has size 0; a null source is a source of its own, ordered last; repeated rows
    are documents of their own with the same key. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("key"), size.alias("size"), text.alias("t"))
    u = (F.shiftrightunsigned("key", 11) + 0.5) / float(1 << 53)
    rows = rows.select("doc_id", "source", "key", "size", (-F.ln(u) / quality(F.col("t"), F.col("size"))).alias("wait"))
    # the density of the logarithm of an exponential variable is below 0.37 everywhere; it lies between -40 and 8
    bucket = F.floor((F.ln(F.col("wait")) + 40) * (BUCKETS / 48)).cast("int")
    rows = cut(rows.withColumn("bucket", F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), bucket))), "mix")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ordered = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(ordered)).withColumnRenamed("source", "of")
    at = sums.join(sources, F.col("of").eqNullSafe(F.col("source"))).where("upto - n < rest and upto >= rest")
    at = at.select("of", F.col("bucket").alias("cut"), (F.col("upto") - F.col("n")).alias("before"))
    sources = sources.join(at, F.col("of").eqNullSafe(F.col("source")), "left").drop("of").withColumnRenamed("source", "of")
    sources = cut(sources, "sources")
    got = rows.join(F.broadcast(sources) if sources.count() <= BROADCAST else sources, F.col("of").eqNullSafe(F.col("source")))
    within = Window.partitionBy("source").orderBy("wait", "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    got = got.where(~inside).withColumn("upto", F.lit(None).cast("long")).unionByName(got.where(inside).withColumn("upto", F.sum("size").over(within)))
    end, begin = F.col("before") + F.col("upto"), F.col("before") + F.col("upto") - F.col("size")
    here = (end <= F.col("rest")) | ((begin < F.col("rest")) & (F.col("rest") - begin > end - F.col("rest")))
    once = F.when(F.col("bucket") < F.col("cut"), 1).when((F.col("bucket") == F.col("cut")) & here, 1).otherwise(0)
    copies = (F.col("epochs") + once).cast("long")
    return got.select("doc_id", "key", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix holds it.

    Of rows alike in id, source and text, only those at the cut of their source can have different numbers of copies;
    these are dealt out among them in the order of a hash of all columns, so that their sum is the mix's.
    """
    copies = mix(docs).groupBy("key").agg(F.min("copies").alias("least"), F.sum("copies").alias("total"), F.count("*").alias("rows"))
    own = docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), F.struct(*[F.col(c) for c in docs.columns]).alias("own"))
    got = own.join(copies, "key").withColumn("more", F.col("total") - F.col("least") * F.col("rows"))
    mixed = got.where("more > 0").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("own"))))  # one key a source at most
    times = got.where("more = 0").select("own", F.col("least").alias("times"))
    times = times.unionByName(mixed.select("own", (F.col("least") + F.when(F.col("n") <= F.col("more"), 1).otherwise(0)).alias("times")))
    got = times.where("times > 0").select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return got.select(*[F.col("own")[c].alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
