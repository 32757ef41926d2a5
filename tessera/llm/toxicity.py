"""Toxicity: a learned lexicon whose misspellings Levenshtein automata catch, scored with context windows.

Terms (words, and stems written ``stem*``) are mined from a bounded sample of labelled rows and stand in a trie. A
word of a text is matched by walking the trie along with the word's Levenshtein automaton. A match is weighed by its
term, its edits and its window: an opening quotation mark before and a closing one behind count as quotation, others
as abuse; an apostrophe in or behind a word opens nothing. A logistic
model over the sums, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import cut, read

#: Bounds of the fit: labelled rows; least toxic documents and least weight of a term (log odds times root of these
#: documents). Words a worker remembers.
FIT_ROWS, LEAST, EVIDENT, REMEMBERED = 6_000, 3, 9.0, 200_000
WINDOW = 40
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W_]+")
_OPENS = re.compile(r"(?<!\w)[\"'“”„«»‘’‹›](?=\w)")
_CLOSES = re.compile(r"(?<=[\w.,!?])[\"'“”„«»‘’‹›](?!\w)")


def quoted(before: str, after: str) -> bool:
    """Whether the last mark of ``before`` opens a quotation and the first one of ``after`` closes it."""
    last = lambda marks: max((m.start() for m in marks.finditer(f"{before}x")), default=-1)
    first = lambda marks: min((m.start() for m in marks.finditer(f"x{after}")), default=len(after) + 1)
    return last(_OPENS) > last(_CLOSES) and first(_CLOSES) < first(_OPENS)


class LevenshteinAutomaton:
    """Nondeterministic automaton of the strings within ``most`` edits of word.

    A state is (letters of word read, edits made). It is run along a trie, so only strings of the lexicon are tried;
    once the edits are used up, one path is left to follow.
    """

    def __init__(self, word: str, most: int = 1):
        self.word, self.most = word, most

    def intersect(self, trie: dict) -> Iterator[dict]:
        """The trie's nodes that end an accepted term (under the key ".")."""
        word, n = self.word, len(self.word)
        stack = [(trie, 0, 0)]
        while stack:
            node, i, edits = stack.pop()
            if edits == self.most:
                while node is not None and i < n:
                    node = node.get(word[i])
                    i += 1
                if node is not None and "." in node:
                    yield node
                continue
            if i == n and "." in node:
                yield node
            if i < n:
                same = node.get(word[i])
                if same is not None:
                    stack.append((same, i + 1, edits))
                stack.append((node, i + 1, edits + 1))  # a letter too many
            for c, below in node.items():
                if c != "." and c != "*":
                    stack.append((below, i, edits + 1))  # a letter too few
                    if i < n and c != word[i]:
                        stack.append((below, i + 1, edits + 1))  # another letter


class Lexicon:
    """Trie of terms with weights; ``match`` gives the best term of a word as (weight, edits), or None."""

    def __init__(self, terms: dict[str, float]):
        self.trie: dict = {}
        #: The whole words of five or more letters, which misspelled words are matched with.
        self.long: dict = {}
        self.terms = terms
        #: Halves of the terms with the lengths of these: one edit leaves one half of a term as it is.
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        for term, weight in terms.items():
            word = term.rstrip("*")
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            if term.endswith("*"):
                node["*"] = max(weight, node.get("*", 0.0))
            else:
                node["."] = weight
                if len(word) >= 5:
                    below = self.long
                    for c in word:
                        below = below.setdefault(c, {})
                    below["."] = weight
                    half = len(word) // 2
                    self.heads.setdefault(word[:half], set()).add(len(word))
                    self.tails.setdefault(word[half:], set()).add(len(word))
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.memory: dict[str, tuple[float, int] | None] = {}

    def match(self, word: str) -> tuple[float, int] | None:
        if word in self.memory:
            return self.memory[word]
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        found = self._match(word)
        if len(word) <= 64:
            self.memory[word] = found
        return found

    def _near(self, word: str) -> bool:
        """Whether a term of about the word's length shares its first or its last half."""
        n = len(word)
        near = {n - 1, n, n + 1}
        return any(near & self.heads.get(word[:k], set()) for k in self.head_sizes) or any(near & self.tails.get(word[-k:], set()) for k in self.tail_sizes)

    def _match(self, word: str) -> tuple[float, int] | None:
        node, best = self.trie, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                break
            best = max(best, node.get("*", 0.0))
        else:
            best = max(best, node.get(".", 0.0))
        if best:
            return best, 0
        if len(word) < 5 or not self._near(word):
            return None
        hits = [node["."] for node in LevenshteinAutomaton(word).intersect(self.long)]
        return (max(hits), 1) if hits else None

    def features(self, text: str) -> list[float]:
        """Weights of exact and misspelled matches, apart by quotation; matches and terms met; share of words."""
        low = text.lower()
        words = _WORDS.findall(low)
        met = {w: m for w in set(words) if (m := self.match(w))}
        if not met:
            return [0.0] * 7
        sums = [[0.0, 0.0], [0.0, 0.0]]
        n = 0
        for at in _WORDS.finditer(low):
            if m := met.get(at.group()):
                before, after = low[max(0, at.start() - WINDOW) : at.start()], low[at.end() : at.end() + WINDOW]
                sums[m[1]][quoted(before, after)] += m[0]
                n += 1
        logs = [math.log1p(x) for pair in sums for x in pair]
        return [*logs, math.log1p(n), float(min(len(met), 5)), 100 * n / (100 + len(words))]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms_of(text: str) -> set[str]:
    words = set(_WORDS.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words if len(w) > 5 for k in range(5, min(len(w), 9))}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, other documents) of a part of the sample."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        terms = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts[::-1])], names=["term", "pos", "neg"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[bool(toxic)].update(_terms_of(text.as_py() or ""))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield out()
                counts[0].clear(), counts[1].clear()
    yield out()


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")  # at most ``rows`` rows of 12 bytes


def mine(rows: DataFrame) -> dict[str, float]:
    """Terms with their weights (log odds), each in LEAST or more toxic documents and mostly there.

    The sample is bounded, and so are its terms that are evident.
    """
    total = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not total[0] or not total[1]:
        return {}
    by = rows.select("text", F.col("toxic").cast("int")).mapInArrow(_count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.ln((F.col("pos") + 0.25) / total[0]) - F.ln((F.col("neg") + 0.25) / total[1])
    chosen = by.where((F.col("pos") >= LEAST) & (F.col("pos") > F.col("neg"))).withColumn("w", odds)
    chosen = chosen.where((F.col("w") > 2.5) & (F.col("w") * F.sqrt("pos") >= EVIDENT)).orderBy("term").select("term", "pos", "w").collect()
    covered: set[tuple[str, int]] = set()  # a stem that is met in no more documents than a longer term says nothing more
    for r in chosen:
        word = r.term.rstrip("*")
        covered |= {(word[:k], r.pos) for k in range(1, len(word) + (not r.term.endswith("*")))}
    kept = [r for r in chosen if not (r.term.endswith("*") and (r.term[:-1], r.pos) in covered)]
    return {r.term: r.w for r in kept}


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a ridge logistic model, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.1
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Lexicon and model weights. Without labelled rows of both kinds: no terms, and the share of toxic rows as score."""
    rows = cut(sample(docs, labels), "labelled")
    terms = mine(rows)
    lexicon = Lexicon(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    if not got:
        return terms, [0.0] * 7 + [-30.0]
    x = np.repeat(np.array([r.x for r in got]), [r["count"] for r in got], axis=0)
    y = np.repeat(np.array([r.toxic for r in got], dtype=float), [r["count"] for r in got])
    return terms, [float(v) for v in _fit(x, y)]


def score(docs: DataFrame, terms: dict[str, float], weights: list[float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. A null or empty text scores as one without matches.

    Repeated rows score alike; a null doc_id is never held out. An empty table gives no rows.
    """
    lexicon = Lexicon(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            x = np.array([lexicon.features(t.as_py() or "") for t in batch.column(2)]).reshape(-1, 7)
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, *fit(docs, read(spark, sf_dir, "labels")))
