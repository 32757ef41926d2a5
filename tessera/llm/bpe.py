"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read

#: Pieces whose ids a worker keeps; longer pieces are not kept.
KEPT, KEPT_CHARS = 400_000, 48
_NONE = 1 << 62
#: Children of a node of the segment tree.
FAN = 32


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merge(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The ids left when no adjacent pair can be merged, by a segment tree over the pairs' ranks.

    Leaf i ranks the pair of the symbol at i and the next living symbol as rank * size + i, so the root is the leftmost
    of the lowest-ranked pairs. A node has FAN children, of which the least is one call of ``min``. A merge changes at
    most three leaves, each with its ancestors. ids is changed. ranks has the rank of a pair under first << 20 | second,
    made the merged symbol of a rank.
    """
    n = len(ids)
    if n < 2:
        return ids
    shift = (n - 1).bit_length()
    get = ranks.get
    leaves = [_NONE if (r := get(a << 20 | b)) is None else r << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[at : at + FAN]) for at in range(0, len(below), FAN)])
    top, inner = levels[-1], range(1, len(levels))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    last, place = n - 1, (1 << shift) - 1
    while (root := min(top)) != _NONE:
        i = root & place
        j = after[i]
        k = after[i] = after[j]
        ids[i] = symbol = made[root >> shift]
        ids[j] = -1
        leaves[i] = _NONE
        if k < n:
            before[k] = i
            if (r := get(symbol << 20 | ids[k])) is not None:
                leaves[i] = r << shift | i
        if j < last:
            leaves[j] = _NONE
        h = before[i]
        if h >= 0:
            leaves[h] = _NONE if (r := get(ids[h] << 20 | symbol)) is None else r << shift | h
        if inner:
            for at in (i, j, h) if h >= 0 else (i, j):
                for level in inner:
                    start = at // FAN * FAN
                    at //= FAN
                    least = min(levels[level - 1][start : start + FAN], default=_NONE)
                    if at >= len(levels[level]) or levels[level][at] == least:
                        break
                    levels[level][at] = least
    return [x for x in ids if x >= 0]


class _Pieces(dict):
    """Ids of pieces, merged when first met. Two generations of KEPT / 2 pieces: the older one is dropped when full."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.bpe.merge_bytes(piece.encode()))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        to_byte = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.made = [0] * len(spec["model"]["merges"])
        for rank, symbol in self.pairs.values():
            self.made[rank] = symbol
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.texts = {i: str(i) for i in self.token_bytes}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(public_tokenizers.PATTERN)
        self._pieces = _Pieces(self)

    def merge_bytes(self, data: bytes) -> list[int]:
        return merge([*map(self.byte_ids.__getitem__, data)], self.ranks, self.made)

    def encode(self, text: str) -> list[int]:
        parts = self._special.split(text) if self._special else [text]
        out: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(self._pieces.__getitem__, self._split.findall(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with a column ``ids`` (array of int): the text's token ids. A null text counts as empty and has none."""
    names = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [b.encode(t or "") for t in part.column(names.index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(run, f"{schema}, ids array<int>")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column ``decoded``; bytes that are no UTF-8 become the replacement character."""
    names = [c for c in tokens.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b.decode(i or []) for i in part.column(names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*names).schema)
    return tokens.select(*names).mapInArrow(run, f"{schema}, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both digested in one pass.

    A null text counts as empty: no tokens and the digests of nothing. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = b.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(b.texts.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(b.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
