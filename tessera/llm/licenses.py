"""License scans with a positional rare-token index.

Templates are short licence notices; their postings are (template, word, position, weight), the weight being the word's
inverse document frequency over all files. For each template a file looks up the highest of the licence words that it
holds, and only as many that the rest together weigh less than a match needs, so that no match is missed and words as
common as "the" are seldom looked up. Postings are intersected by relative position (place in the file minus place in
the template): a position that gathers too little to be a match even with all words not looked up goes. The
remaining words are read at the positions left, and a template matched counts only if its mandatory key phrase
stands in the file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.quality import bound
from tessera.llm.shared import cut, read

#: Fixed values of the contract: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, notice, mandatory key phrase; lower case, words apart by one space.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "this software is released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this program is free software distributed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "this library is free software licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "this program is licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license cc by sa", "cc by sa"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it", "permission is granted to anyone to use this software"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2", "this program is made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("artistic-2", "you may redistribute it under the terms of the artistic license 2 0", "artistic license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "open font license"),
    ("eupl", "licensed under the european union public licence version 1 2", "european union public licence"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("ncsa", "distributed under the university of illinois ncsa open source license", "ncsa open source license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives license", "creative commons attribution noderivatives"),
    ("postgresql", "this database system is released under the postgresql license a liberal open source license", "postgresql license"),
)
#: A template's highest words, which make its weight, and the least share of that weight at its best position.
HIGHEST, LEAST_SHARE = 12, 0.5
#: Sums of weights are compared with this much to spare, for their order of addition.
_SLACK = 1 - 1e-9
_NOT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between the words of a text that is not lower-cased yet
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text with none of these holds no base phrase and no key phrase; each has its rarest words here.
_GATE = rf"(?i)licen[sc]e|permission|redistribution|unencumbered|attribution|cc{_NOT}+by"


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def tokens(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.filter(F.split(text, f"{_NOT}+"), lambda w: w != "")


def idf(met: DataFrame) -> dict[str, float]:
    """Inverse document frequencies of the templates' words from each file's array ``met`` of those it holds.

    As many values as the templates have words.
    """
    df = {r.w: r["count"] for r in met.select(F.explode("met").alias("w")).groupBy("w").count().collect()}
    n = met.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary()}


def _places(phrases: dict[str, str], spaced: Column) -> Column:
    """(label, n, first, last) for each phrase: how often it stands in the words, and its first and last start."""

    def of(phrase: str, label: str) -> Column:
        size = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))  # noqa: E731  words of a piece
        parts = F.split(spaced, f" {phrase}(?= )")
        row = lambda p: F.struct(
            F.lit(label).alias("label"),
            (F.size(p) - 1).cast("long").alias("n"),
            size(F.get(p, 0)).cast("long").alias("first"),
            (size(spaced) - size(F.get(p, F.size(p) - 1)) - len(phrase.split())).cast("long").alias("last"),
        )
        return bound(parts, row)

    return F.filter(F.array(*[of(p, label) for p, label in phrases.items()]), lambda x: x["n"] > 0)


def _literals(weight: dict[str, float]) -> Column:
    """The templates as one array: t, label, key, weight that counts as one, need, words (w, s) by rising weight, notice (w, weight).

    ``need`` is the least weight at one position of a match, s a word's weight times its places in the notice.
    """
    rows = []
    for k, (label, notice, key) in enumerate(TEMPLATES):
        words = notice.split()
        # half of the notice's highest words and of its key phrase's
        one = max(1e-9, 0.5 * (sum(sorted((weight[w] for w in words), reverse=True)[:HIGHEST]) + sum(weight.get(w, 0.0) for w in key.split())))
        rising = sorted(set(words), key=lambda w: (weight[w], w))
        rows.append(
            F.struct(
                F.lit(k).alias("t"),
                F.lit(label).alias("label"),
                F.lit(f" {key} ").alias("key"),
                F.lit(one).alias("one"),
                F.lit(LEAST_SHARE * one * _SLACK).alias("need"),
                F.array(*[F.struct(F.lit(w).alias("w"), F.lit(weight[w] * words.count(w)).alias("s")) for w in rising]).alias("words"),
                F.array(*[F.struct(F.lit(w).alias("w"), F.lit(weight[w]).alias("weight")) for w in words]).alias("notice"),
            )
        )
    return F.array(*rows)


def asked(template: Column, met: Column) -> Column:
    """(t, words, least): the words that a file holding ``met`` looks up for the template, and what they must gather at a position.

    The lowest words held are left out as long as they weigh less than a match needs together; a file that holds less
    than that in all looks up none. A match has ``need`` at its position, so the words looked up have ``least`` there.
    """
    held = F.filter(template["words"], lambda x: F.array_contains(met, x["w"]))
    nothing = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("rest"), F.array().cast("array<string>").alias("words"))

    def add(a: Column, x: Column) -> Column:
        run = a["run"] + x["s"]
        high = run >= template["need"]
        return F.struct(run.alias("run"), F.when(high, a["rest"]).otherwise(run).alias("rest"), F.when(high, F.array_append(a["words"], x["w"])).otherwise(a["words"]).alias("words"))

    return F.aggregate(held, nothing, add, lambda a: F.struct(template["t"].alias("t"), a["words"].alias("words"), (template["need"] - a["rest"]).alias("least")))


def candidates(rows: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(row, t, offset): relative positions where the words looked up gather enough, of rows (row, met, words)."""
    templates = _literals(weight)
    look = rows.where("words is not null").select("row", "words", F.filter(F.transform(templates, lambda t: asked(t, F.col("met"))), lambda a: F.size(a["words"]) > 0).alias("asked"))
    look = look.where(F.size("asked") > 0).select("row", "words", "asked", F.array_distinct(F.flatten("asked.words")).alias("any"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("any", x["w"]))
    seen = look.select("row", "asked", F.explode(places).alias("h"))
    seen = seen.select("row", "h.w", "h.i", F.explode(F.filter("asked", lambda a: F.array_contains(a["words"], F.col("h.w")))).alias("a"))
    postings = [(k, w, p, weight[w]) for k, (_, notice, _) in enumerate(TEMPLATES) for p, w in enumerate(notice.split())]
    index = rows.sparkSession.createDataFrame(postings, "t int, w string, p int, weight double")  # the templates' words, a fixed few hundred
    met = seen.select("row", "w", "i", "a.t", "a.least").join(F.broadcast(index), ["t", "w"])
    met = met.groupBy("row", "t", (F.col("i") - F.col("p")).alias("offset")).agg(F.sum("weight").alias("got"), F.first("least").alias("least"))
    return met.where(F.col("got") >= F.col("least") * _SLACK).select("row", "t", "offset")


def verify(rows: DataFrame, at: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(row, more, share): labels of the templates that match at one of the positions and whose key phrase stands in the file.

    A file's positions come together in one row, no more than it has words times templates.
    """
    templates, words = _literals(weight), F.col("words")

    def share(t: Column, offset: Column) -> Column:
        got = F.transform(t["notice"], lambda x, p: F.when(F.get(words, offset + p) == x["w"], x["weight"]).otherwise(0.0))
        return F.least(F.lit(1.0), F.aggregate(got, F.lit(0.0), lambda a, b: a + b) / t["one"])

    at = at.groupBy("row").agg(F.collect_list(F.struct("t", "offset")).alias("at"))
    rows = rows.where("words is not null").select("row", "words").join(at, "row")
    rows = rows.select("row", "words", "at", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("s"))
    keyed = F.filter(templates, lambda t: F.array_contains("at.t", t["t"]) & F.contains(F.col("s"), t["key"]))
    best = lambda t: F.array_max(F.transform(F.filter("at", lambda a: a["t"] == t["t"]), lambda a: share(t, a["offset"])))
    rows = rows.select("row", F.filter(F.transform(keyed, lambda t: F.struct(t["label"].alias("label"), best(t).alias("share"))), lambda x: x["share"] >= LEAST_SHARE).alias("found"))
    return rows.where(F.size("found") > 0).select("row", F.array_distinct("found.label").alias("more"), F.array_max("found.share").alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest start.
    labels adds the templates matched to base_labels. score is 1 with a base phrase, else the best template's share of
    weight, 0 without one. A null or empty text has no words and no labels; rows are scanned one by one, so repeated
    rows and null ids make no difference; an empty table gives no rows. Texts without any word of a key or base phrase
    (``_GATE``) can have no label and are only counted.
    """
    known = F.array(*map(F.lit, vocabulary()))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select(id_col, "t", F.split("t", _BREAK).alias("raw"))
    blank = lambda k: F.when(F.element_at("raw", k) == "", 1).otherwise(0)  # noqa: E731  a break at an end leaves an empty piece
    n = F.size("raw") - blank(1) - F.when(F.size("raw") > 1, blank(-1)).otherwise(0)
    met = F.array_intersect(F.transform(F.array_distinct("raw"), lambda w: F.lower(w)), known)
    rows = rows.select(id_col, n.cast("long").alias("n_words"), met.alias("met"), F.when(F.col("t").rlike(_GATE), tokens(lower(F.col("t")))).alias("w"))
    rows = rows.select(id_col, "n_words", "met", "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("s"))
    gated = lambda x: F.when(F.col("w").isNotNull(), x)
    rows = rows.select(
        id_col,
        F.monotonically_increasing_id().alias("row"),
        "n_words",
        "met",
        gated(_places(BASE, F.col("s"))).alias("base"),
        # other words only hold their place
        gated(F.transform("w", lambda w: F.when(F.array_contains(known, w), w).otherwise(""))).alias("words"),
    )
    rows = cut(rows, "licenses")
    weight = idf(rows)
    found = verify(rows, candidates(rows, weight), weight)
    rows = rows.drop("words", "met").join(found, "row", "left")
    mine = F.array_distinct(F.transform("base", lambda b: b["label"]))
    empty = F.array().cast("array<string>")
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    return rows.select(
        id_col,
        "n_words",
        F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        joined(F.coalesce(mine, empty)).alias("base_labels"),
        joined(F.array_union(F.coalesce(mine, empty), F.coalesce("more", empty))).alias("labels"),
        F.when(F.size(F.coalesce(mine, empty)) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
