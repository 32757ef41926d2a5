"""The pipeline against a plain Python version of what each stage must do, and its contract."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from tessera.llm import mixing, simhash


def corpus(spark, path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    vocabulary = [word() for _ in range(3000)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(30)) + "."
    shared = " ".join(r.choice(vocabulary) for _ in range(70)) + "."
    rows = []
    for i in range(60):
        lines = [line() for _ in range(4)]
        if i % 10 == 0:
            lines.append(shared)
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(200, " | ".join(vocabulary[:200])), (201, "too short"), (202, None), (203, rows[3][1].replace(" ", ", ", 5))]
    data = [(i, t, "en", f"s{i % 3}" if i != 7 else None, len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    return dict(rows), shared


def test_stages(spark, tmp_path):
    rows, shared = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in P.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing sources to target weights", "bpe encoding and decoding"]
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    kept = {r.doc_id: r.text for r in seen[0]}
    assert kept == {i: t for i, t in rows.items() if i not in (200, 201, 202)}  # clean documents stay as they are
    lines = {r.doc_id: r.text for r in seen[1]}
    assert set(lines) == set(range(60)) and sum(shared in t for t in lines.values()) == 1 and shared in lines[0]
    assert all(lines[i] == rows[i] for i in range(60) if i % 10)
    assert {r.doc_id for r in seen[2]} == set(range(60))
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    got = [r.doc_id for r in seen[3]]
    assert {i: got.count(i) for i in copies} == copies
    assert len(seen[4]) == len(got)
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[4]))


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text, "en", "s", 1), (3, text, "en", "s", 1), (9, text.replace("word7 ", "word8 "), "en", "s", 1), (3, text, "en", "s", 1), (4, "all else here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    links = simhash.components(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    out = P.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == sorted(r.component_id for r in links)


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c", "d")]
    rows = [(1, texts[0], "en"), (1, texts[1], "en"), (1, texts[1], "de"), (2, texts[1], "fr"), (3, texts[2], "en"), (None, texts[2], "en"), (3, None, "en"), (4, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("key", "own", "h", "k", "fp", "component_id")})
    seen = set()
    for n in (1, 3, 7):
        out = simhash.deduplicate(docs.repartition(n, F.rand(n)))
        assert out.columns == docs.columns
        seen.add(tuple(sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=str)))
    assert len(seen) == 1
    kept = seen.pop()
    assert len(kept) == 5  # texts a, b, c, one of the empty ones, and the row without an id
    assert {t for _, t, _ in kept if t} == set(texts[:3]) and sum(not t for _, t, _ in kept) == 1


def test_mix_with_repeated_rows_meets_its_targets(spark):
    rows = [(i, "word " * 7, "a") for i in range(20)] + [(500, "word " * 9, "a")] * 40 + [(600 + i, "word " * 11, "b") for i in range(60)] + [(700, "word " * 50, None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("key", "copies", "total", "more", "n", "times")})
    plan = mixing.mix(docs)
    want = {r.source: r.n for r in plan.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    targets = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = {r.source: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size(F.split(F.trim("text"), " "))).alias("words")).collect()}
    assert {k: r.n for k, r in got.items()} == want
    assert all(abs(r.words - targets[k]) <= 50 for k, r in got.items())


def test_stages_with_clashing_columns_null_ids_and_empty_tables(spark, tmp_path):
    corpus(spark, tmp_path)
    base = spark.read.parquet(f"{tmp_path}/documents.parquet")
    extra = {c: F.lit(f"own {c}") for c in ("own", "key", "kept", "cleaned", "n_words", "fp", "copies", "size", "row", "u", "node")}
    nameless = base.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    for docs, some in ((base.unionByName(nameless).withColumns(extra), True), (base.limit(0), False)):
        for k, (_, stage) in enumerate(P.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == columns
                if some:
                    values = docs.select(*extra).distinct().collect()
                    assert [tuple(r) for r in values] == [tuple(f"own {c}" for c in extra)]
                    assert docs.where("doc_id is null").count() > 0
            assert (docs.count() > 0) == some


def test_registry():
    found = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert "pipeline" in found and set(entry.oracle_sql()) <= set(found)
