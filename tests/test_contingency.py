import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.functions import pvalues as P
from tessera.operators import contingency as C

M1 = "44 74 31 40 4\n4 38 44 20 2\n14 15 0 10 5\n10 20 20 12 10\n"
M2 = "57 60 42 40 40\n5 8 7 11 4\n20 35 25 41 30\n5 20 10 5 6\n"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    from tessera.sources.text import read_grid

    d = tmp_path_factory.mktemp("grid")
    for name, text in (("a.txt", M1), ("b.txt", M2)):
        (d / name).write_text(text)
    return C.pair(read_grid(spark, f"{d}/a.txt"), read_grid(spark, f"{d}/b.txt")).cache()


def test_published_columns(table):
    # the published results of these two matrices
    want = [
        (3.135438, 0.371211, 3.122565, 0.373111, 4.0755, 0.140138, 0.014185, 0.991110),
        (28.819640, 2.44361e-06, 27.108763, 5.58621e-06, 18.2222, 0.316864, 0.077943, 0.897408),
        (68.949028, 7.16605e-15, 56.370907, 3.50098e-12, 11.7318, 0.561178, 0.276272, 0.625710),
        (24.581745, 1.88836e-05, 23.244640, 3.59084e-05, 7.7877, 0.360359, 0.100329, 0.825785),
        (18.935828, 0.00028188, 22.030833, 6.42746e-05, 1.2475, 0.467041, 0.185604, 0.621395),
    ]
    rows, _ = C.compare(table)
    got = rows[["g", "g_p", "chi2", "chi2_p", "min_expected", "cramers_v", "js_divergence", "cosine"]].to_numpy().tolist()
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-4, abs=6e-7)


def test_published_combinations(table):
    want = {
        "naive_flatten_paired_t": (-0.636946, 0.53176), "naive_flatten_wilcoxon": (72, 0.5565), "naive_pooled_chi2": (103.705230, 2.48122e-22),
        "fisher_combined": (131.067367, 2.82903e-23), "stouffer_unweighted": (9.016177, 9.73837e-20), "stouffer_weighted": (9.027612, 8.77296e-20),
        "harmonic_mean_p": (None, 3.58303e-14), "generalized_cmh": (92.086400, 7.80498e-20), "summed_g": (144.421680, 3.0786e-23),
    }
    _, rows = C.compare(table)
    got = {r.method: (r.statistic, r.pvalue) for r in rows.itertuples()}
    for name, (x, p) in want.items():
        assert got[name][1] == pytest.approx(p, rel=2e-4)
        if x is not None:
            assert got[name][0] == pytest.approx(x, rel=1e-6)


def test_monte_carlo_is_near_the_published_p_and_repeats(table):
    each, combined = C.monte_carlo(table, 40_000)
    assert each[1] == pytest.approx(0.3919, abs=4 * math.sqrt(0.39 * 0.61 / 40_000))
    assert max(each[j] for j in (2, 3, 4)) < 0.001 and each[5] < 0.002
    assert combined == 1 / 40_001
    assert C.monte_carlo(table, 4_000) == C.monte_carlo(table.repartition(3), 4_000)


def test_margins_verdicts(table):
    total = [r for r in C.margins(table).collect() if r.i is None and r.j is None]
    assert (total[0].a, total[0].b) == (417, 471)
    assert {r.i: r.consistent for r in C.row_consistency(table).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_cmh_equals_mantel_haenszel(spark):
    rng = random.Random(7)
    for _ in range(4):
        cells = [(j, i, rng.randint(2, 49), rng.randint(2, 49)) for j in range(rng.randint(3, 7)) for i in range(2)]
        d = v = 0.0
        for j in {c[0] for c in cells}:
            (a, b), (c, e) = [x[2:] for x in cells if x[0] == j]
            n = a + b + c + e
            d += a - (a + b) * (a + c) / n
            v += (a + b) * (c + e) * (a + c) * (b + e) / (n * n * (n - 1))
        x, dof, p = C.cmh(spark.createDataFrame(cells, "j int, i int, a int, b int"))
        assert (x, dof) == (pytest.approx(d * d / v, abs=1e-6), 1) and p == pytest.approx(math.erfc(math.sqrt(x / 2)))


def test_undefined_values_are_null(spark):
    t = spark.createDataFrame([(1, 1, 3, 4), (1, 2, 0, 0), (2, 1, 0, 0), (2, 2, 0, 0)], "j int, i int, a int, b int")
    got = {r.j: r for r in C.per_stratum(t).collect()}
    assert got[1].chi2 is None and got[2].cosine is None and got[1].g == pytest.approx(0)
    m = spark.createDataFrame([(1, 1, 2.0)], "row int, col int, value double")
    with pytest.raises(Exception, match="differ in shape"):
        C.pair(m, m.limit(0)).collect()


def test_tails():
    assert P.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and P.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05)
    assert P.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05) and P.norm_isf(P.norm_sf(1.5)) == pytest.approx(1.5)
    assert P.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05) and P.t_two_sided(0.0, 5) == 1.0


def test_number_formats(spark):
    values = [0.0, 1.0, -1.5, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234, 1e-300, 12.3456789, 100.0, 1e15, -0.5, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, x double")
    got = {r.i: r.g for r in df.select("i", formats.general(F.col("x")).alias("g")).collect()}
    assert got == {i: f"{v:.6g}" for i, v in enumerate(values)} | {99: None}
    r = df.where("i = 9").select(formats.percent(F.col("x"), 2), formats.fixed(F.col("x")), formats.grouped(F.col("x") * 1e6)).first()
    assert tuple(r) == ("1234.57%", "12.3457", "12,345,678")


def test_null_distribution_agrees_with_the_counted_p(spark):
    t = spark.createDataFrame([(j, i, float(10 + 3 * i + j), float(9 + 5 * i)) for j in range(2) for i in range(3)], "j int, i int, a double, b double")
    g, seen = C.null_distribution(t, 3_000, block=700)
    each, p = C.monte_carlo(t, 3_000, block=700)
    rows = [r.g for r in g.collect()]
    assert len(rows) == 3_000 and p == (sum(x >= seen - 1e-9 for x in rows) + 1) / 3_001
    assert seen == pytest.approx(C.per_stratum(t).agg(F.sum("g")).first()[0])
