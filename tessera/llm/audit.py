"""Interaction audit of five filters: a histogram of failure masks, and all orders of the filters from its cells.

A row's failures are five bits. The rows of a part fall into 32 cells, which is all that the 120 orders need: a filter
removes the cells that fail it and none before it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.quality import bound, words
from tessera.llm.shared import cut, read

FILTERS = "ABCDE"
LEAST_WORDS = 200


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8: too few words, too few distinct words, too many capitals, a symbol."""
    w = words(text)
    few = bound(w, lambda x: F.when(F.size(x) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(x)) < 50 * F.size(x), 2).otherwise(0))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)
    return few + F.when(capitals, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) for each row of docs; bit 16 of mask: a smaller id has the same text.

    Texts are grouped by their SHA-256, whose smallest id is found by partial aggregation; rows then look for themselves
    among these by id and digest together, so that copies of one text are spread over all tasks. Null texts count as
    empty and a null part is ''. A null id is smaller than no other and has none that is smaller; of rows alike in id
    and text none is a copy of the other. Several labels of an id count as one that has what any of them has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = cut(rows, "masks")  # the texts are read once
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(firsts, ["id", "digest"], "left")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 16).otherwise(0)
    none = F.lit(0)
    return rows.join(marks, "id", "left").select("part", (F.col("own") + copy).alias("mask"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, cells): for each part an array (mask, n, good, toxic) of its cells, 32 at most."""
    by = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return by.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def orders(histogram: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    every = [(order, [1 << FILTERS.index(f) for f in order]) for order in map("".join, permutations(FILTERS))]
    steps = [F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bits[k]).alias("bit"), F.lit(sum(bits[:k])).alias("before")) for o, bits in every for k in range(5)]
    rows = histogram.select("part", "cells", F.explode(F.array(*steps)).alias("s")).select("part", "cells", "s.*")
    fails = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    bit, before = F.col("bit"), F.col("before")
    total = lambda of, which: F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + c[of])
    removed = lambda c: fails(c, bit) & ~fails(c, before)
    # the orders that remove a cell by one of its filters: 120 over the number of filters that it fails
    share = F.aggregate(F.filter("cells", lambda c: fails(c, bit)), F.lit(0).cast("long"), lambda s, c: s + c["n"] * F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.bit_count(c["mask"])))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda c: ~fails(c, bit.bitwiseOR(before))).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda c: fails(c, bit) & fails(c, before)).alias("redundant"),
        total("n", lambda c: c["mask"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """All orders of the five filters over each part of docs; an empty table has no parts."""
    return orders(cells(masks(docs, labels, id_col, text_col, part_col)))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) g, max((coalesce(toxic, 0) = 1)::int) x from labels group by doc_id),
m as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] f from d),
c as (select part, f, count(*) n, sum(coalesce(g, 0)) g, sum(coalesce(x, 0)) x from m left join l using (doc_id) group by all),
k as (select unnest(range(1, 6)) k),
o as (select [a.k, b.k, c.k, d.k, e.k] o from k a join k b on b.k <> a.k join k c on c.k not in (a.k, b.k)
        join k d on d.k not in (a.k, b.k, c.k) join k e on e.k not in (a.k, b.k, c.k, d.k)),
s as (select list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') filter_order, k::int step, o[k] q, o[1:k - 1] earlier from o, k),
r as (select part, filter_order, step, q, n, g, x, f[q] fails, len(list_filter(earlier, lambda i: f[i])) > 0 gone, len(list_filter(f, lambda b: b)) many from c, s),
y as (select part, filter_order, step, any_value(q) q, coalesce(sum(n) filter (not fails and not gone), 0)::bigint kept,
        coalesce(sum(n) filter (fails and not gone), 0)::bigint removed, coalesce(sum(n) filter (fails and gone), 0)::bigint redundant,
        coalesce(sum(n) filter (fails and many = 1), 0)::bigint unique_fails, coalesce(sum(g) filter (fails and not gone), 0)::bigint good_lost,
        coalesce(sum(x) filter (fails and not gone), 0)::bigint toxic_lost from r group by part, filter_order, step)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, q))::bigint shapley from y"""
