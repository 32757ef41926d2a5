"""Best-fit packing of documents into token sequences by bin completion.

Only lengths matter to a packing, so it is found on their histogram, which has one row for each length up to the
capacity whatever the number of documents. Bin completion takes the largest length left, enumerates the undominated
fillings around it, least waste first, and uses a filling for as many sequences as the documents last. A branch ends
where its waste exceeds what a packing better than the incumbent may waste; the first incumbent is best fit by
decreasing length. Pieces then get their rank within their length, and the plan says which ranks go where.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.shared import cut, read

CAPACITY = 2048
#: Lengths that the search tries at most; beyond, the best packing found so far stands.
STEPS = 3_000_000
#: Words, and chunks of other texts, whose ids a worker keeps, in two generations.
KEPT, KEPT_CHUNKS, KEPT_BYTES = 800_000, 200_000, 64
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")


class _Kept(dict):
    """Values by key, made when first met; the older of two generations goes when the newer is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_BYTES:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """A text's ids, as little-endian unsigned 32-bit integers, of a tokenizer that drops white space.

    A text of ASCII and Latin-1 letters is cut into words here, and each word goes through the library's model. Another
    text is the sequence of its chunks, as no token reaches over ASCII white space, and each chunk goes through the
    whole library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spare = iter(range(0x100, 0x200))  # byte-level vocabularies write bytes without a printable Latin-1 form so
        self.chars = {b: b if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else next(spare) for b in range(256)}
        self.words, self.chunks = _Kept(self._word, KEPT), _Kept(self._chunk, KEPT_CHUNKS)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            return b"".join(map(self.words.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) for each piece, with its ids (array of int) where keep_ids is set.

    A document is its ids and an id 0; a longer one than capacity is cut into pieces of capacity, the last may be
    shorter. A null or empty text is the single id 0. Repeated rows and null ids are documents of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = word_ids(path)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                all_ids = w.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, s in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[s : s + 4 * capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences that no packing goes below: by the sum, and by the lengths that cannot meet."""
    n = np.zeros(capacity + 1, dtype=object)
    for s, c in counts.items():
        n[s] = c
    size = np.arange(capacity + 1, dtype=object)
    upto, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    best = -(-sums[-1] // capacity)
    half = capacity // 2
    for k in range(half + 1):
        alone = upto[-1] - upto[capacity - k + 1]  # over capacity - k: nothing of k or more beside them
        wide = upto[capacity - k + 1] - upto[half + 1]
        room = wide * capacity - (sums[capacity - k + 1] - sums[half + 1])
        best = max(best, alone + wide + max(0, -(-(sums[half + 1] - sums[k] - room) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length: (lengths of a sequence, number of such sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = 0  # bit r: a sequence has room r

    def put(room: int, filled: tuple[int, ...], times: int) -> None:
        nonlocal rooms
        if times:
            open_.setdefault(room, []).append((filled, times))
            rooms |= 1 << room

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            fits = rooms >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                filled, times = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            else:
                room, filled, times = capacity, (), c
            each = min(c, room // s)
            used = min(times, c // each)
            put(room - each * s, filled + (s,) * each, used)
            if fits:
                put(room, filled, times - used)
            c -= used * each
    return [x for same in open_.values() for x in same]


def _spread(bits: int, width: int) -> int:
    """The set bits' places plus 1 to width."""
    if not width:
        return 0
    out, done = bits << 1, 1
    while done < width:
        step = min(done, width - done)
        out |= out << step
        done += step
    return out


class _Search:
    """Depth-first search for packings with ever fewer sequences."""

    def __init__(self, counts: dict[int, int], capacity: int, steps: int):
        self.counts, self.capacity, self.steps = dict(counts), capacity, steps
        self.mask = sum(1 << s for s in counts)
        self.total = sum(s * c for s, c in counts.items())
        self.path: list[tuple[tuple[int, ...], int]] = []
        self.bins = self.waste = 0

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for s in filling:
            self.counts[s] -= times
            self.mask = self.mask & ~(1 << s) | (self.counts[s] > 0) << s
        self.bins += times
        self.waste += times * (self.capacity - sum(filling))

    def fillings(self, room: int, least: int, most: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated (filling, waste) of a room by the lengths left, waste from least to most, large lengths first.

        A filling is dominated if one length outside it can take the place of some of its lengths, or of none, is as
        long as these or longer, and still fits: these then fit where that length stands in any other packing.
        """
        sizes, reach, full = [], [], (1 << room + 1) - 1  # reach[j]: sums of sizes[: j + 1]
        mask, sums = self.mask & full, 1
        while mask:
            s = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            more, step = min(self.counts[s], room // s), 1
            while more and sums != full:
                times = min(step, more)
                sums |= sums << times * s & full
                more, step = more - times, 2 * step
            sizes.append(s)
            reach.append(sums)

        def exact(rest: int, top: int, used: int) -> Iterator[tuple[int, ...]]:
            """Fillings of exactly rest, the largest of them sizes[top] at most, which stands used times already."""
            if not rest:
                yield ()
                return
            for j in range(min(top, bisect_right(sizes, rest) - 1), -1, -1):
                self.steps -= 1
                if self.steps < 0 or not reach[j] >> rest & 1:
                    return
                s, before = sizes[j], used if j == top else 0
                if before < self.counts[s] and reach[j] >> rest - s & 1:
                    for tail in exact(rest - s, j, before + 1):
                        yield (s, *tail)

        def dominated(filling: tuple[int, ...], waste: int) -> bool:
            sums, own, spare = 1, 0, 0
            for s in filling:
                sums |= sums << s
            for s in set(filling):
                own |= 1 << s
                spare |= (self.counts[s] > filling.count(s)) << s
            longer = _spread(sums, waste)
            return bool((longer | sums) & self.mask & ~own or longer & spare)

        for waste in range(least, min(most, room) + 1):
            if sums >> room - waste & 1:
                for filling in exact(room - waste, len(sizes) - 1, 0):
                    if not dominated(filling, waste):
                        yield filling, waste

    def choices(self, allowed) -> Iterator[tuple[tuple[int, ...], int]]:
        """(lengths of a sequence, times) around the largest length left; times from all that the lengths allow to one."""
        largest = self.mask.bit_length() - 1
        self.counts[largest] -= 1  # it is in the filling
        self.mask = self.mask & ~(1 << largest) | (self.counts[largest] > 0) << largest
        found = self.fillings(self.capacity - largest, 0, allowed())
        while True:
            one = next(found, None)
            self.counts[largest] += 1
            self.mask |= 1 << largest
            if one is None:
                return
            filling, waste = (largest, *one[0]), one[1]
            times = min(self.counts[s] // filling.count(s) for s in set(filling))
            while times:
                if times * waste <= allowed():
                    yield filling, times
                times //= 2
            if waste > allowed():
                return
            self.counts[largest] -= 1
            self.mask = self.mask & ~(1 << largest) | (self.counts[largest] > 0) << largest

    def run(self, incumbent: list[tuple[tuple[int, ...], int]], bound: int) -> list[tuple[tuple[int, ...], int]]:
        """The first packing as good as the incumbent takes its place, later ones if they are better."""
        target = sum(times for _, times in incumbent)
        allowed = lambda: target * self.capacity - self.total - self.waste  # noqa: E731  waste that may still come
        stack = [self.choices(allowed)]
        while stack and self.steps >= 0:
            if len(self.path) == len(stack):  # what the top of the stack chose before comes back
                filling, times = self.path.pop()
                self.take(filling, -times)
            chosen = next(stack[-1], None) if allowed() >= 0 else None
            if chosen is None:
                stack.pop()
                continue
            self.take(*chosen)
            self.path.append(chosen)
            if self.mask:
                stack.append(self.choices(allowed))
            else:
                incumbent, target = list(self.path), self.bins - 1
                if target < bound:
                    break
        return incumbent


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences): as few sequences as the search finds within steps.

    counts has the number of documents of each length from 1 to capacity; without documents there are no sequences.
    """
    counts = {s: c for s, c in counts.items() if c}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = _Search(counts, capacity, steps).run(best_fit(counts, capacity), least_bins(counts, capacity))
    packed: dict[int, int] = {}
    for filling, times in plan:
        for s in filling:
            packed[s] = packed.get(s, 0) + times
    if packed != counts or any(sum(filling) > capacity for filling, _ in plan):
        raise AssertionError("the plan does not pack each document once")
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length << 40 | first rank, first sequence, offset), by the first column: where the ranks of a length go."""
    out, rank, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for s in filling:
            first = rank.get(s, 0)
            out.append((s << 40 | first, sequence, offset))
            rank[s] = first + times
            offset += s
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)


def place(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", steps: int = STEPS) -> DataFrame:
    """parts (as pieces gives them) with sequence_id and offset (long).

    Counts by length, one row for each length up to capacity, go to the driver; the plan, whose rows are bounded by the
    lengths and not by the documents, comes back as a broadcast. Ranks within a length need no task that holds a whole
    length: pieces fall into chunks by hash, and a chunk's first rank is the running sum of the chunks' counts.
    """
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(bin_completion(counts, capacity, steps)))
    chunks = isqrt(sum(counts.values())) + 1
    rows = parts.withColumn("_chunk", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "_chunk").agg(F.count("*").alias("n"))
    firsts = firsts.select("length", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_chunk").orderBy(id_col, "piece", "ids_crc32")
    ranked = rows.withColumn("_in", F.row_number().over(within)).join(firsts, ["length", "_chunk"])
    ranked = ranked.select(*parts.columns, (F.col("_first") + F.col("_in") - 1).alias("_rank"))
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = (np.ascontiguousarray(c) for c in plan.value.T)
        for b in batches:
            key = b.column(names.index("length")).to_numpy() << 40 | b.column(len(names)).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) for each piece; an empty table has none."""
    return place(cut(pieces(docs, path, capacity, id_col, text_col), "pieces"), capacity, id_col)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids, parts): each sequence's token ids, and the pieces (id_col, piece, start, length, offset) in it."""
    placed = place(cut(pieces(docs, path, capacity, id_col, text_col, keep_ids=True), "pieces"), capacity, id_col)
    part = F.struct("offset", id_col, "piece", "start", "length", "ids")
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))  # capacity ids at most
    parts = F.transform("p", lambda x: x.dropFields("ids"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), parts.alias("parts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
