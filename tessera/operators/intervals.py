"""Interval algebra on half-open (s, e) columns: merge, subtract, priority partition, overlap join, nearest.

Keys (usually chrom and strand) are column names. Overlaps are equi joins over bins. What needs an order (merge, claim,
nearest) is a scan in two levels: positions fall into slots of fixed width, windows run inside slots, and each slot gets
what it must know of the slots before and after it from their summaries, one row a slot. Rows are first reduced to
distinct positions, of which a slot has at most its width, so no task holds a whole key or a hot position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Width of the fine bins; features over LONG bins long go to bins COARSE times as wide.
BIN, LONG, COARSE = 4096, 16, 256
#: Width of the slots of a scan, and so the most distinct positions that a window sorts.
SLOT = 65_536


def div(a: str | Column, b: int) -> Column:
    """Integer division, towards minus infinity for the coordinates at hand."""
    return F.floor((F.col(a) if isinstance(a, str) else a) / b).cast("long")


def _carried(points: DataFrame, keys: list[str], totals: dict[str, Column], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, whole: dict[str, Column] | None = None) -> DataFrame:
    """points (keys, _slot, ...) with what the other slots of their keys hold.

    totals are aggregates of a slot; before, after and whole are aggregates of these over all earlier slots, all later
    ones, and all. The summaries have one row a slot, whatever the number of points.
    """
    order = Window.partitionBy(*keys).orderBy("_slot")
    spans = (
        (before, order.rowsBetween(Window.unboundedPreceding, -1)),
        (after, order.rowsBetween(1, Window.unboundedFollowing)),
        (whole, Window.partitionBy(*keys)),
    )
    slots = points.groupBy(*keys, "_slot").agg(*[v.alias(k) for k, v in totals.items()])
    own = [*keys, "_slot"]
    slots = slots.select(*[F.col(c).alias(f"_of_{c}") for c in own], *[v.over(w).alias(k) for named, w in spans for k, v in (named or {}).items()])
    return points.join(slots, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in own]).drop(*[f"_of_{c}" for c in own])


def _in_slot(keys: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, "_slot").orderBy(*order)


def merge(rows: DataFrame, keys: list[str], width: int = SLOT) -> DataFrame:
    """Union of the intervals of each key; touching intervals become one. Empty intervals are dropped.

    An interval begins where the largest end so far lies before a start. It ends at the largest end before the next
    begin, wherever that is.
    """
    points = rows.where("e > s").groupBy(*keys, "s").agg(F.max("e").alias("e")).withColumn("_slot", div("s", width))
    points = _carried(points, keys, {"_m": F.max("e")}, before={"_before": F.max("_m")}, whole={"_all": F.max("_m")})
    w = _in_slot(keys, "s")
    points = points.withColumn("_pe", F.greatest("_before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    begins = points.where(F.col("_pe").isNull() | (F.col("s") > F.col("_pe"))).select(*keys, "_slot", "s", "_pe", "_all")
    begins = _carried(begins, keys, {"_first": F.min_by("_pe", "s")}, after={"_next": F.first("_first")})
    end = F.coalesce(F.lead("_pe").over(w), F.col("_next"), F.col("_all"))
    return begins.select(*keys, "s", end.alias("e"))


def subtract(blocks: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (ps, pe) of each block (all its columns kept) that no hole of the same keys covers.

    blocks are taken as they are: repeat rows only after distinct(). Holes may overlap one another.
    """
    own = blocks.columns
    cut = holes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("s").alias("hs"), F.col("e").alias("he"))
    asked = blocks.select(F.struct(*own).alias("_own"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("s").alias("qs"), F.col("e").alias("qe"))
    met = overlap(asked, cut.withColumnsRenamed({"hs": "s", "he": "e"}), [f"_{k}" for k in keys])
    met = met.select("_own.*", F.greatest("s", "_own.s").alias("hs"), F.least("e", "_own.e").alias("he"))
    ends = blocks.select(*own, F.col("e").alias("hs"), F.col("e").alias("he"))
    w = Window.partitionBy(*own).orderBy("hs", "he").rowsBetween(Window.unboundedPreceding, -1)
    rows = met.unionByName(ends).withColumn("ps", F.coalesce(F.max("he").over(w), F.col("s")))
    return rows.where("hs > ps").select(*own, "ps", F.col("hs").alias("pe"))


def claim(rows: DataFrame, keys: list[str], classes: list[int], kind: str = "cl", width: int = SLOT) -> DataFrame:
    """Segments (keys, class, s, e): each base goes to the smallest class that covers it, by counting starts and ends."""
    ends = F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d"))))
    events = rows.select(*keys, kind, ends.alias("_x")).select(*keys, kind, "_x.*")
    events = events.groupBy(*keys, "p").agg(*[F.sum(F.when(F.col(kind) == c, F.col("d")).otherwise(0)).alias(f"d{c}") for c in classes])
    events = events.withColumn("_slot", div("p", width))
    events = _carried(
        events, keys, {f"_t{c}": F.sum(f"d{c}") for c in classes} | {"_p": F.min("p")},
        before={f"_b{c}": F.sum(f"_t{c}") for c in classes}, after={"_next": F.first("_p")},
    )
    w = _in_slot(keys, "p")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    counts = [(F.coalesce(F.col(f"_b{c}"), F.lit(0)) + F.sum(f"d{c}").over(upto)).alias(f"n{c}") for c in classes]
    segments = events.select(*keys, F.col("p").alias("s"), F.coalesce(F.lead("p").over(w), F.col("_next")).alias("e"), *counts)
    owner = F.coalesce(*[F.when(F.col(f"n{c}") > 0, c) for c in classes])
    return segments.withColumn(kind, owner).where(F.col(kind).isNotNull() & F.col("e").isNotNull()).select(*keys, kind, "s", "e")


def overlap(queries: DataFrame, features: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Every pair of a query (qs, qe) and a feature (s, e) of the same keys that share a base, once.

    Both sides enter the bins they touch; a pair counts only in the first bin that both touch. Long features use wider
    bins, so that their number of rows stays bounded; queries are looked up in both widths.
    """
    wide = width * COARSE
    bins = lambda s, e, w: F.sequence(div(s, w), div(F.col(e) - 1, w))
    long = (F.col("e") - F.col("s")) > LONG * width
    f = features.where("e > s").withColumn("_w", F.when(long, wide).otherwise(width))
    f = f.withColumn("_bin", F.explode(F.when(long, bins("s", "e", wide)).otherwise(bins("s", "e", width))))
    q = queries.where("qe > qs").withColumn("_w2", F.explode(F.array(F.lit(width), F.lit(wide))))
    q = q.withColumn("_bin2", F.explode(F.when(F.col("_w2") == width, bins("qs", "qe", width)).otherwise(bins("qs", "qe", wide))))
    q = q.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in q.columns])
    first = F.when(F.col("_w") == width, F.greatest(div("qs", width), div("s", width))).otherwise(F.greatest(div("qs", wide), div("s", wide)))
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    pairs = q.join(f, [*same, F.col("_w") == F.col("_w2"), F.col("_bin") == F.col("_bin2"), F.col("qs") < F.col("e"), F.col("s") < F.col("qe"), F.col("_bin") == first])
    return pairs.drop("_w", "_w2", "_bin", "_bin2", *[f"_k_{k}" for k in keys])


def nearest_of_points(points: DataFrame, references: DataFrame, keys: list[str], at: str = "p", width: int = SLOT) -> DataFrame:
    """points, whose (keys, at) must be distinct, with ``distance`` as in ``nearest``."""
    own = points.columns
    refs = references.select(*keys, F.col(at).alias("_ref")).distinct()
    both = points.withColumn("_ref", F.lit(None).cast(refs.schema["_ref"].dataType))
    both = both.unionByName(refs.withColumn(at, F.col("_ref")).withColumn("_is", F.lit(True)), allowMissingColumns=True).withColumn("_slot", div(at, width))
    both = _carried(
        both, keys, {"_low": F.max("_ref"), "_high": F.min("_ref")},
        before={"_below": F.max("_low")}, after={"_above": F.min("_high")},
    )
    # at one place the reference comes first, or, seen from above, last
    low = F.last("_ref", ignorenulls=True).over(_in_slot(keys, at, F.col("_is").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_ref", ignorenulls=True).over(_in_slot(keys, at, F.col("_is").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"_l": F.coalesce(low, F.col("_below")), "_h": F.coalesce(high, F.col("_above"))}).where("_is is null")
    p, lo, hi = F.col(at), F.col("_l"), F.col("_h")
    left = hi.isNull() | (lo.isNotNull() & (p - lo <= hi - p))
    return both.withColumn("distance", F.when(left, p - lo).otherwise(p - hi)).select(*own, "distance")


def nearest(queries: DataFrame, references: DataFrame, keys: list[str], at: str = "p", width: int = SLOT) -> DataFrame:
    """queries with ``distance``, the signed distance at - reference to the nearest reference of the same keys.

    Of two equally near references the lower one counts. Without a reference, or a place, the distance is null.
    Each place is measured once, however many queries ask there.
    """
    own = queries.columns
    points = nearest_of_points(queries.select(*keys, at).where(F.col(at).isNotNull()).distinct(), references, keys, at, width)
    found = points.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, at)], "distance")
    return queries.join(found, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, at)], "left").select(*own, "distance")
