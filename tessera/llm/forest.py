"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``TREES`` trees hashes every vector to a string of ``BITS`` sign bits; the strings sorted are the tree, and the
vectors under a prefix are a range of it. A query descends in all trees together to the longest prefix, one length for
all its trees, under which these hold ``enough`` vectors, which is the same as to ascend from the longest match in step
until there are enough: dense regions are met with long prefixes, sparse ones with short ones. How many are enough is
measured on a bounded sample of queries, whose neighbours among all rows are known exactly: the least number with a
recall of ``RECALL``. Vectors travel as bytes, one a component; whatever these say may be among the nearest is compared
exactly, by the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, read

TREES, BITS, RECALL, NEAREST = 12, 60, 0.95, 10
#: Bounds: queries of the sample, and vectors and queries of a prefix that one task compares at a time.
SAMPLE, CHUNK, ASKED = 200, 4_000, 500
#: Least number of candidates, however few the sample needs: its queries may all lie in dense regions.
LEAST = 1_000


def planes(dims: int, tree: int) -> np.ndarray:
    return np.random.default_rng(7919 * dims + tree).standard_normal((dims, BITS))


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings as integers, the first bit highest. Directions only: the length of a vector does not count."""
    return ((x @ planes(x.shape[1], tree)) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is not null or empty, has finite components only, and not all zero."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)) & F.exists("v", lambda c: c != 0)
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def _code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as signed bytes and the size of a step; a component is off by half a step at most."""
    step = np.abs(x).max(1) / 127
    return np.rint(x / step[:, None]).astype("i1"), step


def _plant(trees: int, coded: bool):
    """(tree, string, id), and with coded the vector's bytes and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), dtype=float)
            code, step = _code(x)
            more = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step)] if coded else []
            for tree in range(trees):
                h = strings(x, tree)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tree, dtype="int32")), pa.array(h), b.column(0), *more], names=["tree", "string", "id", "code", "step"][: 3 + len(more)])

    return run


PLANTED, CODED = "tree int, string bigint, id bigint", "tree int, string bigint, id bigint, code binary, step double"


def _true_neighbours(rows: DataFrame, asked: list, nearest: int) -> dict[int, list]:
    """The nearest (id, v) of each row of the sample ``asked``, among all rows; each task keeps the nearest of its rows."""
    ids, q = np.array([r.id for r in asked]), np.array([r.v for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, x = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), dtype=float)
            far = (x * x).sum(1)[None] - 2 * q @ x.T + (q * q).sum(1)[:, None]
            far[ids[:, None] == own[None]] = np.inf
            k = min(nearest, len(own))
            at = np.argpartition(far, k - 1, axis=1)[:, :k]
            some, whose = at.ravel(), np.repeat(ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(whose), pa.array(far[np.repeat(np.arange(len(ids)), k), some]), b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some))], names=["query", "far", "id", "v"])

    best = Window.partitionBy("query").orderBy("far", "id")
    found = rows.mapInArrow(run, "query bigint, far double, id bigint, v array<double>").withColumn("r", F.row_number().over(best))
    near: dict[int, list] = {}
    for r in found.where((F.col("r") <= nearest) & (F.col("far") < math.inf)).select("query", "v").collect():  # SAMPLE * nearest rows
        near.setdefault(r.query, []).append(r.v)
    return near


def _sizes(planted: DataFrame, asked: DataFrame, levels: list[int], bounded: bool = False) -> DataFrame:
    """(id, level, n): how many vectors the trees hold under each query's prefix of each length in ``levels``.

    Prefixes are counted for the longest length and added up for the others. ``asked`` has a row for each query and
    tree, here one for each length too, which Spark's estimate of its size leaves out: so it is never broadcast, unless
    ``bounded`` says that it is the sample.
    """
    keys = ["tree", "level", "prefix"]
    each = F.explode(F.array(*map(F.lit, levels))).alias("level")
    wanted = asked.select("id", "tree", "string", each).select("id", "tree", "level", F.expr(f"shiftright(string, {BITS} - level)").alias("prefix"))
    top = max(levels)
    base = cut(planted.groupBy("tree", F.shiftrightunsigned("string", BITS - top).alias("p")).agg(F.count("*").alias("n")), "prefixes")
    held = base.select("tree", "p", "n", each).select("tree", "level", F.expr(f"shiftright(p, {top} - level)").alias("prefix"), "n")
    if bounded:  # rows that no query of the sample meets stay out of the shuffle
        held = held.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
    counts = held.groupBy(*keys).agg(F.sum("n").alias("n"))
    return wanted.join(counts.hint("merge"), keys).groupBy("id", "level").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, queries: DataFrame, planted: DataFrame, nearest: int, trees: int, recall: float = RECALL) -> tuple[int, list[int]]:
    """(enough, levels): the least number of candidates that reaches ``recall`` on the sample, and the prefix lengths to count."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    near = _true_neighbours(rows, asked, nearest) if asked else {}
    asked = [r for r in asked if r.id in near]
    if not asked:
        return 1, [0]
    x = np.array([r.v for r in asked])
    shared = [np.zeros(len(near[r.id]), dtype=int) for r in asked]
    own = np.stack([strings(x, tree) for tree in range(trees)])
    for tree in range(trees):
        for i, r in enumerate(asked):
            differ = strings(np.array(near[r.id]), tree) ^ own[tree, i]
            shared[i] = np.maximum(shared[i], [BITS - int(d).bit_length() for d in differ])
    every = sorted({int(s) for x in shared for s in x} | {0})
    spark = rows.sparkSession
    sample = spark.createDataFrame([(tree, int(own[tree, i]), r.id) for i, r in enumerate(asked) for tree in range(trees)], PLANTED)
    sizes: dict[int, dict[int, int]] = {r.id: {} for r in asked}
    for r in _sizes(planted, sample, every, bounded=True).collect():  # SAMPLE * levels rows
        sizes[r.id][r.level] = r.n

    def reached(enough: int) -> tuple[float, list[int]]:
        at = [max([level for level, n in sizes[r.id].items() if n >= enough], default=0) for r in asked]
        return float(np.mean(np.concatenate([s >= level for s, level in zip(shared, at, strict=True)]))), at

    tries = sorted({n for x in sizes.values() for n in x.values()})
    low, high = 0, len(tries) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(tries[middle])[0] >= recall else (middle + 1, high)
    deep = max(reached(tries[low])[1])
    return tries[low], sorted({*range(0, min(deep + 4, BITS), max(1, (deep + 4) // 16)), deep, BITS})  # a score of lengths at most


def _search(nearest: int):
    """Of a prefix's rows those that may be among a query's nearest, by the bounds that the bytes leave."""

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(rows):
            of = lambda t: np.frombuffer(b"".join(t["code"]), dtype="i1").reshape(len(t), -1) * t["step"].to_numpy()[:, None]
            ids, x, steps = rows["id"].to_numpy(), of(rows), rows["step"].to_numpy()
            for at in range(0, len(queries), ASKED):
                part = queries.iloc[at : at + ASKED]
                q = of(part)
                far = np.sqrt(np.maximum((x * x).sum(1)[None] - 2 * q @ x.T + (q * q).sum(1)[:, None], 0))
                off = (steps[None] + part["step"].to_numpy()[:, None]) / 2 * math.sqrt(x.shape[1]) + 1e-6 * (1 + far)
                k = min(nearest + 1, len(ids)) - 1
                bound = np.partition(far + off, k, axis=1)[:, k]
                i, j = np.nonzero(far - off <= bound[:, None])
                out.append(pd.DataFrame({"query": part["id"].to_numpy()[i], "id": ids[j]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})

    return run


def candidates(rows: DataFrame, asked: DataFrame, at: DataFrame, levels: list[int], nearest: int, trees: int) -> DataFrame:
    """(query, id), each once: what the trees hold under each query's prefix, but for what is surely not among its nearest.

    ``asked`` are the queries' coded strings, ``at`` their levels. A prefix's rows and queries are dealt out by salts too,
    a task's share being CHUNK rows and ASKED queries.
    """
    prefix = F.expr(f"shiftright(string, {BITS} - level)")
    asked = cut(asked.join(at, "id").withColumn("prefix", prefix), "asked")
    keys = ["tree", "level", "prefix"]
    wanted = asked.groupBy(*keys).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    used = [r.level for r in asked.select("level").distinct().collect()]  # of levels
    planted = rows.mapInArrow(_plant(trees, False), PLANTED).withColumn("level", F.explode(F.array(*map(F.lit, used or [0])))).withColumn("prefix", prefix)
    sizes = cut(planted.join(wanted, keys).groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"), F.max("parts").alias("parts")), "salts")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    coded = rows.mapInArrow(_plant(trees, True), CODED).withColumn("level", F.explode(F.array(*map(F.lit, used or [0])))).withColumn("prefix", prefix)
    coded = coded.join(sizes, keys).withColumn("salt", deal("salts")).withColumn("part", spread("parts")).drop("string", "salts", "parts")
    asked = asked.join(sizes, keys).withColumn("part", deal("parts")).withColumn("salt", spread("salts")).drop("string", "salts", "parts")
    keys = [*keys, "salt", "part"]
    return asked.groupBy(*keys).cogroup(coded.groupBy(*keys)).applyInPandas(_search(nearest), "query bigint, id bigint").distinct()


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``nearest`` rows by Euclidean distance, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, as do rows without an id and rows
    whose vector has another length than most have. Rows with one vector are searched as one: of copies only the
    smallest ids can be among the nearest, and copies among the queries share a search. Of rows with one id the
    smallest vector counts. A query finds all other rows if these are fewer than ``nearest``; empty tables give no rows.
    """
    once = lambda t: t.groupBy("id").agg(F.min("v").alias("v"))
    rows, queries = once(valid(rows, id_col, vector_col)), once(valid(queries, id_col, vector_col))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    of_length = F.size("v") == (most.d if most else 1)
    first = Window.partitionBy("v").orderBy("id")  # Spark limits the ranks before the shuffle too, so copies do not pile up
    rows = cut(rows.where(of_length).withColumn("n", F.row_number().over(first)).where(F.col("n") <= nearest + 1).drop("n"), "rows")
    queries = cut(queries.where(of_length).withColumn("k", F.xxhash64("v")), "queries")
    one = cut(queries.groupBy("k").agg(F.min("id").alias("id")), "one")  # copies share a search
    asked = queries.join(one, ["k", "id"], "left_semi").select("id", "v")
    planted = cut(rows.mapInArrow(_plant(trees, False), PLANTED), "forest")
    enough, levels = fit(rows, asked, planted, nearest, trees)
    coded = cut(asked.mapInArrow(_plant(trees, True), CODED), "asked")
    sizes = _sizes(planted, coded, levels).where(F.col("n") >= max(enough, LEAST, nearest + 1))
    at = asked.select("id").join(sizes.groupBy("id").agg(F.max("level").alias("level")), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
    pairs = cut(candidates(rows, coded, cut(at, "levels"), levels, nearest, trees), "candidates")
    mine = queries.join(one.withColumnRenamed("id", "query"), "k").select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "query")
    scored = pairs.join(rows, "id").join(mine, "query").where("id != query_id")
    score = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    scored = scored.select("query_id", "id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")).cast("int")
    return scored.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))
