"""Packing, periodic runs and the filter audit against brute force on small tables with nulls, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import audit, packing, periods

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
WORDS = packing.word_ids(PATH)
HARD = ["", " \t\n", "Don't WE'LL", "naïve Éa ÀÿßÆ ×÷µªº", "<|endoftext|>", "a<|endoftext|> <|startoftext|>b<|", "x" * 3000, "a\x1cb\x85c d　e", "é ́a İI", "漢字かな 🙂", "1２³12", "\x00a\x7f", "--- $$$ ***,.", "café's"]


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def own_ids(text):
    return np.frombuffer(WORDS.ids(text), "<u4").tolist()


def test_ids_of_hard_texts():
    for text in HARD:
        assert own_ids(text) == lib_ids(text), text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB'stréÀß \n.,$1", max_size=60)))
def test_ids_of_any_text(text):
    assert own_ids(text) == lib_ids(text)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            k = rooms.index(room)
            go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest_sequences():
    r, better = random.Random(1), 0
    for _ in range(400):
        capacity = r.choice([20, 30, 50, 100])
        items = [r.randint(1, r.choice([capacity // 2, capacity])) for _ in range(r.randint(1, 12))]
        counts = Counter(items)
        got = sum(n for _, n in packing.bin_completion(counts, capacity))
        first = sum(n for _, n in packing.best_fit(counts, capacity))
        assert packing.least_bins(counts, capacity) <= got == fewest(items, capacity) <= first
        better += got < first
    assert better
    assert packing.bin_completion({}) == [] and sum(n for _, n in packing.bin_completion({7: 10**12}, 21)) == -(-(10**12) // 3)
    with pytest.raises(ValueError):
        packing.bin_completion({30: 1}, 20)


def test_a_search_without_steps_keeps_best_fit():
    counts = Counter(random.Random(3).randint(1, 60) for _ in range(200))
    assert sorted(packing.bin_completion(counts, 100, steps=0)) == sorted(packing.best_fit(counts, 100))


def documents(seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["Alpha", "beta,", "gämma", "don't", "7", "***"]) for _ in range(r.randint(0, 90)))) for i in range(150)]
    return rows + [(5, rows[5][1]), (5, "another text"), (None, "no id"), (900, None), (901, ""), (902, " \n"), (903, "word " * 5000), (904, "Alpha " * 99)] + [(1000 + i, "copies of one text") for i in range(80)]


def test_pack(spark):
    rows, capacity = documents(), 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("piece", "length", "ids", "_chunk", "offset")})
    got = packing.pack(docs, PATH, capacity).collect()
    want = Counter()
    for d, t in rows:
        ids = [*lib_ids(t), 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = Counter(r.length for r in got)
    assert len(filled) == packing.least_bins(lengths, capacity)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    real = packing.sequences(docs, PATH, capacity).collect()
    assert len(real) == len(filled) and sum(len(r.ids) for r in real) == sum(r.length for r in got)
    by = defaultdict(list)
    for r in real:
        for x in r.parts:
            by[x.doc_id, x.piece].append(tuple(r.ids[x.offset : x.offset + x.length]))
    assert by[903, 0] == [tuple((lib_ids("word ") * capacity)[:capacity])] and Counter(by[5, 0]) == Counter([tuple([*lib_ids(rows[5][1]), 0][:capacity])] * 2 + [(*lib_ids("another text"), 0)])


def brute_runs(x):
    n, found = len(x), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def strings(seed):
    r = random.Random(seed)
    for _ in range(60):
        alphabet = r.choice([1, 2, 3, 50])
        x = []
        while len(x) < r.randint(0, 260):
            piece = [r.randrange(alphabet) for _ in range(r.randint(1, 30))]
            x += piece * r.randint(1, 8) + piece[: r.randrange(len(piece))]
        yield x


@pytest.mark.parametrize(("pairs", "base"), [(1 << 20, None), (64, None), (1 << 20, 0)])
def test_runs(monkeypatch, pairs, base):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    if base is not None:  # every hash meets every other: only the words decide
        monkeypatch.setattr(periods, "_BASE", base)
    for seed in range(3):
        texts = list(strings(seed))
        got = periods.find_runs([np.array(x, np.int32) for x in texts])
        if base is None:
            assert got == [brute_runs(x) for x in texts]
        else:
            assert all(set(g) <= set(brute_runs(x)) for g, x in zip(got, texts))
    assert periods.find_runs([]) == [] and periods.find_runs([np.array([], np.int32)]) == [[]]


def test_runs_of_a_very_long_text():
    x = np.zeros(200_000, np.int32)
    assert periods.find_runs([x, np.arange(100_000, dtype=np.int32)]) == [[(0, 200_000, 1)], []]


def test_periods_query(spark, monkeypatch):
    monkeypatch.setattr(periods, "WORDS", 300)
    r = random.Random(2)
    rows = [(i, " ".join(f"w{v}" for v in x)) for i, x in enumerate([*strings(7), *([r.randrange(40) for _ in range(r.randint(1, 200))] for _ in range(80))])]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "\x85\xa0 \t\n\r x\x1c"), (903, "again and " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_runs", "start", "t")})
    want, tails = [], 0
    for d, t in rows:
        w = [x for x in "".join(" " if c in "\t\n\x0b\f\r" else c for c in t or "").split(" ") if x]
        n, h = len(w), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and n:
            g, tails = h // 10, tails + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        drop = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = sorted(runs, key=lambda x: (-(10**12 * x[1] // x[2]), x[0], x[2]))[:1]
        s, m, p = best[0] if best else (None, None, None)
        digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
        want.append((d, len(runs), s, m, p, 1000 * m // p if best else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in drop))))
    assert tails > 5
    assert Counter(map(tuple, periods.digests(docs, periods.planted).collect())) == Counter(want)
    assert periods.digests(docs.limit(0)).count() == 0 and periods.collapse(docs.limit(0)).count() == 0
    own = {x.doc_id: x for x in periods.collapse(docs).collect()}
    assert own[903].collapsed == "again and" and [tuple(x) for x in own[903].runs] == [(0, 1800, 2)] and own[900].collapsed == ""


def test_audit(spark):
    r = random.Random(5)
    langs = ["en", "de", None, ""]
    texts = [" ".join(r.choice(["One", "two", "TWO", "#", "thrée", *map(str, range(300))][: r.choice([5, 305])]) for _ in range(r.choice([0, 20, 199, 200, 260]))) for _ in range(40)]
    rows = [(i, r.choice([*texts, None]), r.choice(langs)) for i in range(300)]
    rows += [(7, rows[7][1], "en"), (7, "other text", "en"), (None, rows[8][1], "de"), (None, "x", "de"), (999, "word " * 30000, "de")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 300, 2)] + [(0, 1, None), (0, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("first", "digest", "mask", "id", "good")})
    low: dict = {}
    for d, t, _ in rows:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    parts = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = [x for x in t.split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > low[t]}
        parts[lang or ""].append((frozenset(k for k, v in fails.items() if v), d is not None and d in good, d is not None and d in toxic))
    want = {}
    for part, found in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = found
            for k, f in enumerate(order):
                out = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(out)
                want[part, "".join(order), k + 1] = [len(left), len(out), sum(f in x[0] for x in found) - len(out), sum(x[0] == {f} for x in found), sum(x[1] for x in out), sum(x[2] for x in out)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                want[part, "".join(order), k + 1].append(shapley[f])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = {(x.part, x.filter_order, x.step): list(x[3:]) for x in audit.audit(docs, marks).collect()}
    assert got == want
    assert audit.audit(docs.limit(0), marks).count() == 0
    assert len(audit.audit(docs, marks.limit(0)).collect()) == len(want)
