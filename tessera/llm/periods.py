"""Periodic runs of words: a harmonic grid of (period, grid point) pairs and hashed longest common extensions.

A run of period p and length max(24, 3 p) or more holds a grid point i of every grid of step max(2 p, 24 - p) such that
i and i + p both lie in it, so n words need about n ln(n) / 2 pairs. Texts of a batch are laid end to end, shortest
first, so that the pairs of a period are those of the texts long enough for it. All pairs whose words are equal search
their longest common extensions to both sides at once, by halving on prefix hashes; what is long enough is then held
against the words themselves, and pairs that found the same run are one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read

LEAST, TIMES = 24, 3
#: Pairs that are compared at once, and words of texts that are laid end to end.
PAIRS, WORDS = 1 << 20, 1 << 19
_M, _BASE = (1 << 31) - 1, 1_103_515_245

Run = tuple[int, int, int]  # start, length, period


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.int64)
    have, power = 1, _BASE
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * power % _M
        have, power = have + more, power * power % _M
    return out


class _Laid:
    """Texts laid end to end, shortest first: word numbers, each text's first and last place, prefix hashes."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.lengths = lengths
        self.ids = np.concatenate([*texts, np.empty(0, np.int32)]).astype(np.int32, copy=False)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        n = len(self.ids)
        self.power = _powers(n + 1)
        mixed = (self.ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(8)).astype(np.int64) % _M
        self.hash = np.concatenate([[0], np.cumsum(mixed * self.power[:n] % _M) % _M])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(period, place) arrays of at most about PAIRS pairs."""
        n = len(self.ids)
        p = np.arange(1, int(self.lengths.max(initial=0)) // TIMES + 1, dtype=np.int64)
        if n == 0 or not len(p):
            return
        long_enough = np.searchsorted(self.lengths, np.maximum(LEAST, TIMES * p))
        first = np.append(self.start, n)[long_enough]
        step = np.maximum((TIMES - 1) * p, LEAST - p)
        count = np.maximum(0, -(-(n - p - first) // step))
        for at in range(0, len(p)):
            if count[at] > PAIRS:  # one period of very long texts goes in parts
                for k in range(0, int(count[at]), PAIRS):
                    i = first[at] + step[at] * np.arange(k, min(k + PAIRS, int(count[at])), dtype=np.int64)
                    yield np.full(len(i), p[at]), i
        p, first, step, count = (x[count <= PAIRS] for x in (p, first, step, count))
        upto = np.cumsum(count)
        at = 0
        while at < len(p):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            c = count[at:stop]
            k = np.arange(int(c.sum()), dtype=np.int64) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(p[at:stop], c), np.repeat(first[at:stop], c) + k * np.repeat(step[at:stop], c)
            at = stop

    def extend(self, p: np.ndarray, i: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest common extension, at most most, of the words after (or before) i and i + p."""
        low, high = np.zeros_like(i), most.copy()
        shift = self.power[p]
        here, there = self.hash[i], self.hash[i + p]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            to = -mid if back else mid
            same = ((self.hash[i + to] - here) % _M * shift - (self.hash[i + p + to] - there)) % _M == 0
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def exact(self, p: int, i: int) -> tuple[int, int]:
        """The stretch around i of period p, word by word."""
        t = self.text[i]
        a, b = int(self.start[t]), int(self.end[t])
        differ = np.flatnonzero(self.ids[a : b - p] != self.ids[a + p : b]) + a
        k = int(np.searchsorted(differ, i))
        return (int(differ[k - 1]) + 1 if k else a), (int(differ[k]) + p if k < len(differ) else b)

    def holds(self, s: int, e: int, p: int) -> bool:
        """Whether [s, e) has period p and no neighbouring word keeps it."""
        t, x = self.text[s], self.ids
        inside = np.array_equal(x[s : e - p], x[s + p : e])
        return inside and (s == self.start[t] or x[s - 1] != x[s - 1 + p]) and (e == self.end[t] or x[e] != x[e - p])

    def runs(self) -> list[list[Run]]:
        found: dict[tuple[int, int], set[int]] = {}
        for p, i in self.pairs():
            keep = (self.ids[i] == self.ids[i + p]) & (self.text[i] == self.text[i + p])
            p, i = p[keep], i[keep]
            t = self.text[i]
            after = self.extend(p, i, self.end[t] - i - p, back=False)
            before = self.extend(p, i, i - self.start[t], back=True)
            s, e = i - before, i + p + after
            keep = e - s >= np.maximum(LEAST, TIMES * p)
            for a, b, q in np.unique(np.stack([s[keep], e[keep], p[keep]], 1), axis=0).tolist():
                found.setdefault((a, b), set()).add(q)
        out: list[set[Run]] = [set() for _ in self.lengths]
        for (s, e), periods in found.items():
            for p in sorted(periods):  # a longer period of the same stretch is a multiple of the smallest
                if self.holds(s, e, p):
                    t = int(self.text[s])
                    out[t].add((s - int(self.start[t]), e - s, p))
                    break
                a, b = self.exact(p, s)  # two hashes met
                if b - a >= max(LEAST, TIMES * p) and all(not self.holds(a, b, q) for q in range(1, p)):
                    t = int(self.text[a])
                    out[t].add((a - int(self.start[t]), b - a, p))
        return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """For each array of word numbers its runs (start, length, period), by start, then period."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    out: list[list[Run]] = [[] for _ in texts]
    for k, found in zip(order, _Laid([texts[k] for k in order]).runs()):
        out[k] = found
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray | None:
    """Places that no run holds after its first period; None if all."""
    if not runs:
        return None
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's periodic tails: which original word stands at each place; None where none is planted."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


Place = Callable[[int | None, int], np.ndarray | None]


def _scanned(ids: list, texts: list[bytes | None], rewrite: Place | None) -> Iterator[tuple[int, list[Run], bytes]]:
    """(number in ids, runs, kept words joined by a space), texts of up to WORDS words at a time."""
    at = 0
    while at < len(ids):
        number: dict[bytes, int] = {}
        words, laid, total = [], [], 0
        while at + len(words) < len(ids) and total < WORDS:
            w = (texts[at + len(words)] or b"").split()
            x = np.fromiter((number.setdefault(v, len(number)) for v in w), np.int32, len(w))
            places = rewrite(ids[at + len(words)], len(w)) if rewrite else None
            if places is not None:
                x, w = x[places], [w[k] for k in places]
            words.append(w)
            laid.append(x)
            total += len(w)
        for k, (w, runs) in enumerate(zip(words, find_runs(laid))):
            kept = kept_words(len(w), runs)
            yield at + k, runs, b" ".join(w if kept is None else [w[j] for j in kept])
        at += len(words)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs, collapsed): each text's runs, and its words without the repeats, joined by one space.

    A null or blank text has no runs and an empty result. Rows are read one by one: repeated rows give repeated rows,
    and null ids change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            for k, runs, text in _scanned(b.column(0).to_pylist(), b.column(1).to_pylist(), None):
                rows = [dict(zip(("start", "length", "period"), r)) for r in runs]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([rows], kind), pa.array([text.decode()])], names=[id_col, "runs", "collapsed"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def digests(docs: DataFrame, rewrite: Place | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each row.

    start, length, period and exponent_milli are those of the run with the greatest length / period (ties: smallest
    start, then period), null without runs. rewrite says which of a text's words stand where before runs are sought.
    Null and blank texts have no runs and the digests of nothing; repeated rows give repeated rows.
    """
    longs = ("n_runs", "start", "length", "period", "exponent_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, runs, text in _scanned(b.column(0).to_pylist(), b.column(1).to_pylist(), rewrite):
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows)) or [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[id_col, *longs, "runs_sha256", "collapsed_sha256"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in longs) + ", runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), planted)
