"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints at 4 or fewer differing bits differ in at most 2 bits of
one segment, so the Hamming balls of radius 1 around both segments share a point: every fingerprint enters the
table of a segment under the 33 points of its ball, and fingerprints that meet under a point are verified by their
whole distance. Under a point the links found are a spanning forest, not all pairs. Points with more than
``BUCKET`` fingerprints are left to a second exact step: the balls of radius 2 around the whole fingerprints,
whose points are cliques, so that a link to the clique's smallest fingerprint is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import connected_components, cut, read

BITS, MOST = 64, 4
#: Fingerprints under one point of a segment's ball that are compared in memory (8 bytes each).
BUCKET = 4096
SHINGLE, SEED = 4, 42
_CHUNK = 8192
#: Tasks that a component's fingerprints are dealt out to when they get its smallest id.
SALTS = 16


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    w = (text or b"").lower().split()
    n = max(1, len(w) - words + 1)
    if not w:
        return 0
    bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(at, min(n, at + _CHUNK))], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp) per row; fp is the fingerprint's 64 bits as a long. A null or blank text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect whatever is connected at MOST bits among fps: at most len(fps) - 1."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= MOST
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    return left, right


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: links (a, b), and (fp, null) for the fingerprints of larger runs."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.ascontiguousarray(b).view("<i8"))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view("<i8")), b], names=["a", "b"])

    def closed() -> Iterator[pa.RecordBatch]:
        if not hot and len(held) > 1 and (links := _forest(held))[0]:
            yield out(np.concatenate(links[0]), np.concatenate(links[1]))

    key, held, hot = None, np.empty(0, "<u8"), False
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("<u8")
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        last = len(starts) - 1
        for n in np.union1d(np.flatnonzero(ends - starts > 1), [0, last]):  # a single fingerprint inside the batch has no link
            run = fps[starts[n] : ends[n]]
            if n == 0 and keys[0] == key:
                run = run if hot else np.concatenate([held, run])
            else:
                yield from closed()
                key, hot = keys[starts[n]], False
            if hot or len(run) > BUCKET:
                yield out(run, None)
                run, hot = run[:0], True
            held = run.copy()
    yield from closed()


def hamming_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct longs in ``fp`` at MOST or fewer bits."""
    ball = F.array(*[F.lit(m).cast("bigint") for m in (0, *(1 << k for k in range(32)))])
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    tables = F.array(low.bitwiseXOR(F.col("m")), high.bitwiseXOR(F.col("m")).bitwiseOR(1 << 32))
    probes = fps.select("fp", F.explode(ball).alias("m")).select(F.explode(tables).alias("key"), "fp")
    found = cut(probes.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link, "a bigint, b bigint").distinct(), "links")
    points = [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(BITS), 2))]
    masks = F.array(*[F.lit(p - (1 << 64) if p >> 63 else p) for p in points]).cast("array<bigint>")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    cliques = hot.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    low = cliques.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first < last")
    more = cliques.join(low.select("key", "first"), "key").where("fp > first").select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    return found.where("b is not null").unionByName(more)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) per row of docs.

    component_id is the smallest id reachable over links of MOST or fewer bits, the row's own included. Rows
    without words have fingerprint 0 and link like others. Repeated rows share their component. A null id is no
    candidate for component_id (null only if the component has no id). An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col), "fp")
    firsts = rows.groupBy("fp").agg(F.min(id_col).alias("low"))
    comps = connected_components(hamming_links(firsts.select("fp")))
    at = firsts.join(comps, firsts.fp == comps.node, "left").select("fp", "low", "root")
    lows = at.where("root is not null").groupBy("root").agg(F.min("low").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = at.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))  # a large component's fingerprints go apart
    named = salted.join(lows, ["root", "salt"], "left").select(F.col("fp").alias("of"), F.coalesce("least", "low").alias("component_id"))
    return rows.join(named, rows.fp == named.of).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id. Rows with a null id stay as they are.

    Rows that share an id but not a text are documents of their own. Of rows alike in id and text, that with the
    smallest hash of all its columns stays, so the result does not depend on how rows are dealt.
    """
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"))
    known = keyed.where(F.col("key")["id"].isNotNull())
    links = components(known.select("key", F.col("own")[text_col].alias("text")), "key", "text")
    kept = links.where(F.col("key") == F.col("component_id")).select(F.col("key").alias("k")).distinct()
    one = known.join(kept, (F.col("key")["id"] == F.col("k")["id"]) & (F.col("key")["h"] == F.col("k")["h"]), "left_semi")
    one = one.groupBy(F.col("key")["id"].alias("id"), F.col("key")["h"].alias("h")).agg(F.min_by("own", F.xxhash64("own")).alias("own"))
    return one.select("own.*").unionByName(docs.where(F.col(id_col).isNull()))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))
