import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import annotate as A
from tessera.operators import features as G
from tessera.operators import interpret as T
from tessera.operators import intervals as I

IV = "k string, s long, e long"


def intervals(seed, n, span=300, longest=40):
    r = random.Random(seed)
    return [(r.choice("ab"), s := r.randint(0, span), s + r.randint(1, longest)) for _ in range(n)]


def bases(rows, k):
    return {p for x, s, e in rows if x == k for p in range(s, e)}


def test_merge_and_subtract_cover_the_same_bases(spark):
    for seed in range(3):
        a, b = intervals(seed, 40), intervals(seed + 50, 25)
        m = [tuple(r) for r in I.merge(spark.createDataFrame(a, IV), ["k"]).select("k", "s", "e").collect()]
        for k in "ab":
            assert bases(m, k) == bases(a, k)
            mine = sorted(x for x in m if x[0] == k)
            assert all(p[2] < q[1] for p, q in zip(mine, mine[1:]))  # touching ones are one
        cut = I.subtract(spark.createDataFrame(m, IV), spark.createDataFrame(b, IV), ["k"]).select("k", "ps", "pe").collect()
        for k in "ab":
            assert bases([tuple(r) for r in cut], k) == bases(a, k) - bases(b, k)


def test_claim_gives_each_base_to_the_smallest_class(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 2), k, s, e) for k, s, e in intervals(9, 40)]
    got = I.claim(spark.createDataFrame(rows, "cl int, k string, s long, e long"), ["k"], [0, 1, 2]).collect()
    want = {}
    for c, k, s, e in rows:
        for p in range(s, e):
            want[k, p] = min(want.get((k, p), 9), c)
    assert {(x.k, p): x.cl for x in got for p in range(x.s, x.e)} == want


@pytest.mark.parametrize("width", [1, 7, 64])
def test_overlap_equals_brute_force(spark, width):
    q, f = intervals(3, 60), intervals(4, 60, 300, 5) + [("a", 0, 5000), ("b", 100, 900)]
    dq = spark.createDataFrame([(i, *x) for i, x in enumerate(q)], "id int, k string, qs long, qe long")
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(f)], "fid int, k string, s long, e long")
    got = sorted((r.id, r.fid) for r in I.overlap(dq, df, ["k"], width).collect())
    assert got == sorted((i, j) for i, (k, s, e) in enumerate(q) for j, (l, t, u) in enumerate(f) if k == l and s < u and t < e)


def test_nearest_takes_the_lower_of_two(spark):
    r = random.Random(2)
    refs = [(r.choice("ab"), r.randint(0, 200)) for _ in range(15)]
    qs = [(i, r.choice("abc"), r.randint(0, 200)) for i in range(60)]
    got = {x.id: x.distance for x in I.nearest(spark.createDataFrame(qs, "id int, k string, p long"), spark.createDataFrame(refs, "k string, p long"), ["k"]).collect()}
    for i, k, p in qs:
        own = sorted({x for l, x in refs if l == k})
        best = min(own, key=lambda x: (abs(p - x), x), default=None)
        assert got[i] == (None if best is None else p - best)


def test_utr_pieces_clip_ambiguous_ones(spark):
    exon = spark.createDataFrame([("t", "-", 0, 100, "1"), ("u", "+", 0, 10, "1"), ("u", "+", 10, 20, "2"), ("u", "+", 30, 40, "3")], "tx string, strand string, s long, e long, xn string")
    cds = spark.createDataFrame([("t", 20, 40), ("t", 60, 80), ("u", 12, 33)], "tx string, s long, e long")
    got = sorted((r.tx, r.cls, r.s, r.e, r.blk) for r in G.utrs(exon, cds).collect())
    assert got == [("t", "3UTR", 0, 20, 1), ("t", "5UTR", 80, 100, 1), ("u", "3UTR", 33, 40, 1), ("u", "5UTR", 0, 10, 1), ("u", "5UTR", 10, 12, 2)]
    gaps = G.introns(exon, ("strand",)).collect()
    assert [(r.tx, r.s, r.e, r.intron) for r in gaps] == [("u", 20, 30, 1)]  # abutting exons leave no intron
    check = G.utr_check(exon, cds, spark.createDataFrame([("u", 0, 10), ("u", 11, 12)], "tx string, s long, e long"))
    assert {(r.tx, r.n_both, r.n_ours, r.n_theirs) for r in check.collect()} == {("t", 0, 3, 0), ("u", 1, 2, 1)}


def test_annotation_priority_strands_and_context(spark):
    feats = spark.createDataFrame([(0, "c", "+", 10, 20, "g1", "t1"), (0, "c", "+", 10, 20, "g1", "t0"), (4, "c", "+", 0, 50, "g2", "t2"), (2, "c", "-", 12, 30, "g3", "t3")], "cl int, chrom string, strand string, s long, e long, gene string, tx string")
    genes = spark.createDataFrame([("c", "+", 0, 60, "g1"), ("c", "-", 0, 60, "g3")], "chrom string, strand string, s long, e long, gene_name string")
    sites = spark.createDataFrame([(1, "c", "+", 15, 16), (2, "c", ".", 25, 26), (3, "c", "-", 15, 16), (4, "d", "+", 1, 2)], "id int, chrom string, strand string, s long, e long")
    got = {r.id: r for r in A.annotate(sites, A.isoforms(feats), genes).collect()}
    assert (got[1].feature_type, got[1].transcript_ids, got[1].n_transcripts, got[1].all_features_hit, got[1].gene_context) == ("exon", "t0", 2, "CDS;intron", "g1")
    assert (got[2].feature_detail, got[2].gene_ids, got[2].gene_context) == ("3UTR", "g3", "g1,g3")
    assert (got[3].feature_detail, got[3].alt_strand_label) == ("3UTR", "exon")
    assert (got[4].feature_type, got[4].gene_ids, got[4].n_genes, got[4].gene_context) == ("UN", "NA", 0, "intergenic")
    flat = A.zero_length(spark.createDataFrame([(5, 5), (9, 3), (1, 2)], "s long, e long"))
    assert [tuple(r) for r in flat.collect()] == [(4, 5), (8, 9), (1, 2)]


def test_natural_order_and_histogram(spark):
    names = ["chr10", "chr2", "chrM", "chrX", "chrUn_9", "chrUn_10", "chr1", "MT"]
    got = [r.chrom for r in spark.createDataFrame([(x,) for x in names], "chrom string").orderBy(*T.chrom_order()).collect()]
    assert got == ["chr1", "chr2", "chr10", "chrX", "chrM", "MT", "chrUn_10", "chrUn_9"]
    at = spark.createDataFrame([("c", "+", 100), ("c", "+", 103), ("c", "-", 1)], "chrom string, strand string, p long")
    refs = A.three_prime(spark.createDataFrame([("c", "+", 50, 101), ("c", "+", 9, 200)], "chrom string, strand string, s long, e long"))
    h = A.end_histogram(at, refs, 2)
    assert {r.offset: r.n for r in h.collect()} == {-2: 0, -1: 1, 0: 0, 1: 0, 2: 1} and A.histogram_peak(h).first().peak == -1
    assert sum(r.n for r in T.distance_bands(at.withColumn("feature_type", F.lit("UN")).withColumn("distance", F.lit(5).cast("long"))).select(F.col("downstream").alias("n")).collect()) == 3


def test_regions_of_one_place_are_looked_up_once(spark, monkeypatch):
    rng = random.Random(11)
    features = []
    for i in range(150):
        s = rng.randrange(-130, 900)
        features.append((rng.randrange(5), rng.choice(["c1", "c2"]), rng.choice("+-"), s, s + rng.choice([0, 1, 2, 63, 64, 65, 200]), i % 7, i, 1))
    regions = [(i, rng.choice(["c1", "c2", "c3"]), rng.choice(["+", "-", ".", None]), p, p + rng.choice([0, 1, 1, 64, 130])) for i, p in enumerate(rng.choices(range(-200, 1100), k=300))]
    regions += [(1_000 + i, "c1", "+", 64, 65) for i in range(2_000)]
    asked = []
    monkeypatch.setattr(A, "overlap", lambda q, *more: asked.append(q.count()) or I.overlap(q, *more))
    f = spark.createDataFrame(features, "cl int, chrom string, strand string, s long, e long, gene long, tx long, n long").withColumnRenamed("tx", "rep")
    genes = spark.createDataFrame([("c1", "+", -50, 500, 1, "x"), ("c2", "-", 100, 101, 2, "y")], "chrom string, strand string, s long, e long, gene long, gene_name string")
    q = spark.createDataFrame(regions, "id long, chrom string, strand string, s long, e long")
    for most in (0, 250_000):  # ends of features joined by shuffle, and broadcast
        monkeypatch.setattr(A._placed, "__defaults__", (most,))
        got = {r.id: r for r in A.annotate(q, f, genes).collect()}
        assert len(got) == len(regions) and asked and max(asked) <= 300
        for i, chrom, strand, s, e in regions:
            met = [x for x in features if x[1] == chrom and x[3] < e and s < x[4] and s < e and x[3] < x[4]]
            mine = [x for x in met if strand == "." or x[2] == strand]
            best = min((x[0] for x in mine), default=None)
            won = [x for x in mine if x[0] == best]
            r = got[i]
            assert r.feature_detail == A.DETAIL.get(best, "UN") and r.n_transcripts == len(won) and r.n_genes == len({x[5] for x in won})
            assert r.gene_ids == (",".join(sorted({str(x[5]) for x in won})) or "NA") and r.first_tx == min((str(x[6]) for x in won), default="NA")
            assert r.alt_strand_label == A.LABEL.get(min((x[0] for x in met), default=None), "UN")
            near = sorted(n for c, t, a, b, n in (("c1", "+", -50, 500, "x"), ("c2", "-", 100, 101, "y")) if c == chrom and a < e and s < b and s < e and (strand == "." or strand == t))
            assert r.gene_context == (",".join(near) or "intergenic")
