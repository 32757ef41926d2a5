import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
OWN = bpe.bpe(PATH)
HARD = ["", " ", "  a", "a  ", "\n\n x", "don't we'll I'M", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 3000, "  　a", "\x1c\x1d\x1e\x1f \x85", "漢字かな 🙂👩‍👩‍👧", "1２٣½²", "�\u0000", "aaaa" * 500 + "!!!" * 400, "é ​­"]


def same(text: str) -> None:
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


def test_hard_texts():
    for text in HARD:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_any_ids_decode(ids):
    assert OWN.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefgh", max_size=60))
def test_tree_is_greedy_merging(text):
    ids = [OWN.byte_ids[b] for b in text.encode()]
    while True:
        ranked = [(OWN.pairs[p][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (p := a << 20 | b) in OWN.pairs]
        if not ranked:
            break
        i = min(ranked)[1]
        ids[i : i + 2] = [OWN.pairs[ids[i] << 20 | ids[i + 1]][1]]
    assert OWN.merge_bytes(text.encode()) == ids


def test_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 6)
    own = bpe.ByteBpe(PATH)
    text = " ".join(f"w{i}" for i in range(50))
    assert own.encode(text) == LIB.encode(text, add_special_tokens=False).ids
    assert len(own._pieces) <= 3 and len(own._pieces.older) <= 3


def test_query(spark):
    rows = [(1, "Hello  world"), (2, None), (None, "a<|endoftext|>b"), (1, "Hello  world"), (4, "long " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", docs_lit())
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {(r.doc_id, r.decoded) for r in back.collect()} == {(i, t or "") for i, t in rows}


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
