"""Queries over the contingency operators, each with its SQL."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.pvalues import chi2_sf_even
from tessera.operators import contingency as C
from tessera.operators import figures as P
from tessera.plans import views as V
from tessera.plans.views import sql
from tessera.sources.scratch import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_T = """select *, (a + b) * na / n ea, (a + b) * nb / n eb, a / na p, b / nb q from (select j, i, cast(a as double) a, cast(b as double) b, cast(sum(a) over (partition by j) as double) na,
  cast(sum(b) over (partition by j) as double) nb, cast(sum(a + b) over (partition by j) as double) n from counts) z"""
_G = "select j, 2 * sum(case when a > 0 then a * ln(a / ea) else 0 end + case when b > 0 then b * ln(b / eb) else 0 end) g, sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb) x, count(*) - 1 dof, max(n) n from t group by j"
_TAIL = "exp(-{x} / 2) * (1 + {x} / 2)"  # four degrees of freedom


@query(sql(f"select j, round(g, 6) g, dof, round({_TAIL.replace('{x}', 'g')}, 6) p from g", "counts", t=_T, g=_G))
def g_test(spark, d):
    rows = C.per_stratum(V.counts(spark, d))
    return rows.select("j", F.round("g", 6).alias("g"), "dof", F.round(chi2_sf_even(F.col("g"), 4), 6).alias("p"))


@query(sql(f"select j, round(x, 6) chi2, dof, round({_TAIL.replace('{x}', 'x')}, 6) p from g", "counts", t=_T, g=_G))
def pearson(spark, d):
    rows = C.per_stratum(V.counts(spark, d))
    return rows.select("j", F.round("chi2", 6).alias("chi2"), "dof", F.round(chi2_sf_even(F.col("chi2"), 4), 6).alias("p"))


@query(sql(f"select j, p < 0.05 significant from (select j, {_TAIL.replace('{x}', 'g')} p from g) y", "counts", t=_T, g=_G))
def significance_split(spark, d):
    low, high = C.significance_split(C.with_pvalues(C.per_stratum(V.counts(spark, d)), "g", "g_p"))
    return low.select("j", F.lit(True).alias("significant")).unionByName(high.select("j", F.lit(False).alias("significant")))


@query(sql("""select t.j, round(min(least(ea, eb)), 6) min_expected, round(sqrt(max(x) / max(t.n)), 6) cramers_v, min(least(ea, eb)) < 5 low,
  round(0.5 * sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + 0.5 * sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end), 9) js_divergence,
  round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) cosine from t join g on t.j = g.j group by t.j""", "counts", t=_T, g=_G))  # fmt: skip
def effect_sizes(spark, d):
    rows = C.per_stratum(V.counts(spark, d))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return rows.select("j", r("min_expected"), r("cramers_v"), (F.col("min_expected") < 5).alias("low"), r("js_divergence", 9), r("cosine"))


@query(sql("""select round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 6) chi2, count(*) - 1 dof from (select a, b, (a + b) * sum(a) over () / sum(a + b) over () ea, (a + b) * sum(b) over () / sum(a + b) over () eb
  from (select i, cast(sum(a) as double) a, cast(sum(b) as double) b from counts group by i) y) z""", "counts"))  # fmt: skip
def pooled_chi2(spark, d):
    return C.pooled_chi2(V.counts(spark, d)).select(F.round("chi2", 6).alias("chi2"), "dof")


@query(sql("select i, bool_and(q > p) or bool_and(q < p) consistent from t group by i", "counts", t=_T))
def row_consistency(spark, d):
    return C.row_consistency(V.counts(spark, d))


@query(sql("select j, i, round(p, 6) pa, round(q, 6) pb, round(q - p, 6) difference from t", "counts", t=_T))
def proportions(spark, d):
    return C.proportions(V.counts(spark, d)).select("j", "i", *[F.round(c, 6).alias(c) for c in ("pa", "pb", "difference")])


@query(sql("select i, cast(j as varchar) j, cast(sum(a) as bigint) a, cast(sum(b) as bigint) b from counts group by grouping sets ((i), (j), ())", "counts"))
def matrix_margins(spark, d):
    return C.margins(V.counts(spark, d))


@query(sql(f"select round(sum(-2 * ln({_TAIL.replace('{x}', 'g')})), 6) statistic, cast(2 * count(*) as bigint) dof from g", "counts", t=_T, g=_G))
def fisher(spark, d):
    p = chi2_sf_even(F.col("g"), 4)
    return C.per_stratum(V.counts(spark, d)).agg(F.round(F.sum(-2 * F.ln(F.greatest(p, F.lit(1e-300)))), 6).alias("statistic"), (2 * F.count("*")).alias("dof"))


@query(sql("select round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) t, count(*) - 1 dof from counts", "counts"))
def paired_t_stat(spark, d):
    return C.paired_t(V.counts(spark, d)).select(F.round("t", 6).alias("t"), "dof")


@query(sql("""select cast(least(sum(case when up then r else 0 end), sum(case when up then 0 else r end)) as double) w, cast(count(*) as bigint) n from
  (select a > b up, rank() over (order by abs(a - b)) + (count(*) over (partition by abs(a - b)) - 1) / 2.0 r from counts where a <> b) z""", "counts"))  # fmt: skip
def wilcoxon_stat(spark, d):
    return C.wilcoxon(V.counts(spark, d)).select(F.col("w").cast("double").alias("w"), F.col("n").cast("long").alias("n"))


@query(sql("""select x.i, y.i k, round(sum(case when x.i = y.i then x.a - (x.a + x.b) * x.na / x.n else 0 end), 6) d,
  round(sum(x.na * x.nb * (case when x.i = y.i then x.n * (x.a + x.b) else 0 end - (x.a + x.b) * (y.a + y.b)) / (x.n * x.n * (x.n - 1))), 6) cov
  from t x join t y on x.j = y.j where x.i <> (select max(i) from t) and y.i <> (select max(i) from t) group by 1, 2""", "counts", t=_T))  # fmt: skip
def cmh_components(spark, d):
    return C.cmh_components(V.counts(spark, d)).select("i", "k", F.round("d", 6).alias("d"), F.round("cov", 6).alias("cov"))


def _even_tail(x: str, dof: int) -> str:
    """The chi-square tail of an even number of degrees of freedom, as SQL."""
    return f"(exp(-({x}) / 2) * (" + " + ".join(f"pow(({x}) / 2, {k}) / {math.factorial(k)}" for k in range(dof // 2)) + "))"


def _sf(x: str) -> str:
    """The normal tail as SQL: a series of positive terms for erf."""
    term = "exp(2 * n * ln(2) + lgamma(n + 1) + (2 * n + 1) * ln(greatest(abs({x}), 1e-12) / sqrt(2)) - lgamma(2 * n + 2))"
    return "(0.5 - 0.5 * sign({x}) * 2 / sqrt(pi()) * exp(-({x}) * ({x}) / 2) * list_sum([" .replace("{x}", x) + term.replace("{x}", x) + " for n in range(0, 150)]))"


def _t_tail(t: str, dof: int) -> str:
    """The two-sided tail of Student's t with an even number of degrees of freedom, as SQL."""
    cos2 = f"({dof} / ({dof} + ({t}) * ({t})))"
    terms = ["1.0"]
    for k in range(1, dof // 2):
        terms.append(f"{math.prod(range(1, 2 * k, 2)) / math.prod(range(2, 2 * k + 1, 2))!r} * pow({cos2}, {k})")
    return f"(1 - abs({t}) / sqrt({dof} + ({t}) * ({t})) * (" + " + ".join(terms) + "))"


#: The summed differences d and covariances of the components, with d as a further row and column; eliminating the
#: categories one after the other leaves -d' V^-1 d, the statistic, in its corner.
_AUGMENTED = """with k as (select x.i, y.i k, sum(case when x.i = y.i then x.a - (x.a + x.b) * x.na / x.n else 0 end) d,
    sum(x.na * x.nb * (case when x.i = y.i then x.n * (x.a + x.b) else 0 end - (x.a + x.b) * (y.a + y.b)) / (x.n * x.n * (x.n - 1))) v
    from t x join t y on x.j = y.j where x.i <> (select max(i) from t) and y.i <> (select max(i) from t) group by 1, 2),
  o as (select i, row_number() over (order by i) r from (select distinct i from k) z)
  select a.r p, b.r q, v from k join o a on a.i = k.i join o b on b.i = k.k union all
  select r, 5, d from k join o on o.i = k.i where k.i = k.k union all select 5, r, d from k join o on o.i = k.i where k.i = k.k union all select 5, 5, 0"""
_CMH = {"e0": _AUGMENTED} | {
    f"e{s}": f"select m.p, m.q, m.v - a.v * b.v / c.v v from e{s - 1} m join e{s - 1} a on a.p = m.p and a.q = {s} join e{s - 1} b on b.p = {s} and b.q = m.q join e{s - 1} c on c.p = {s} and c.q = {s} where m.p > {s} and m.q > {s}"
    for s in range(1, 5)
} | {"cm": "select -v x from e4"}


@query(sql(f"select round(x, 6) statistic, 4 dof, round({_even_tail('x', 4)}, 8) p from cm", "counts", t=_T, **_CMH))
def cmh(spark, d):
    rows = spark.createDataFrame([C.cmh(V.counts(spark, d))], "statistic double, dof int, p double")
    return rows.select(F.round("statistic", 6).alias("statistic"), "dof", F.round("p", 8).alias("p"))


#: p of each stratum's G, and its normal quantile by halving an interval.
_P = f"select j, {_TAIL.replace('{x}', 'g')} p, n from g"
_QUANTILE = f"""with recursive h(j, p, n, lo, hi, k) as (select j, p, n, cast(-9 as double), cast(9 as double), 0 from ps
  union all select j, p, n, case when {_sf('(lo + hi) / 2')} > p then (lo + hi) / 2 else lo end, case when {_sf('(lo + hi) / 2')} > p then hi else (lo + hi) / 2 end, k + 1 from h where k < 50)
  select j, p, n, lo z from h where k = 50"""
_SUMS = f"""select 'naive_flatten_paired_t' method, t statistic, null dof, {_t_tail('t', 24)} pvalue from (select avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) t from counts) y
  union all select 'naive_flatten_wilcoxon', w, null, 2 * {_sf('abs(u)')} from (select w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) u from (
    select cast(least(sum(case when up then r else 0 end), sum(case when up then 0 else r end)) as double) w, cast(count(*) as double) n, (select sum(k * k * k - k) from (select cast(count(*) as double) k from counts where a <> b group by abs(a - b)) q) tie from
    (select a > b up, rank() over (order by abs(a - b)) + (count(*) over (partition by abs(a - b)) - 1) / 2.0 r from counts where a <> b) z) y) x
  union all select 'naive_pooled_chi2', x, 4, {_even_tail('x', 4)} from (select sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb) x from (select a, b, (a + b) * sum(a) over () / sum(a + b) over () ea, (a + b) * sum(b) over () / sum(a + b) over () eb
    from (select i, cast(sum(a) as double) a, cast(sum(b) as double) b from counts group by i) y) z) w
  union all select 'fisher_combined', x, 10, {_even_tail('x', 10)} from (select sum(-2 * ln(p)) x from ps) y
  union all select 'stouffer_unweighted', z, null, {_sf('z')} from (select sum(z) / sqrt(count(*)) z from zs) y
  union all select 'stouffer_weighted', z, null, {_sf('z')} from (select sum(n * z) / sqrt(sum(n * n)) z from zs) y
  union all select 'harmonic_mean_p', null, null, count(*) / sum(1 / p) from ps
  union all select 'generalized_cmh', x, 4, {_even_tail('x', 4)} from cm
  union all select 'summed_g', x, 20, {_even_tail('x', 20)} from (select sum(g) x from g) y"""


@query(sql("select method, round(statistic, 6) statistic, cast(dof as bigint) dof, round(pvalue, 6) pvalue from sums", "counts", t=_T, g=_G, ps=_P, zs=_QUANTILE, **_CMH, sums=_SUMS))
def combined_tests(spark, d):
    got = C.compare(V.counts(spark, d))[1]
    none = lambda v: None if pd.isna(v) else v
    rows = [(r.method, none(r.statistic), None if pd.isna(r.dof) else int(r.dof), none(r.pvalue)) for r in got.itertuples()]
    rows = spark.createDataFrame(rows, "method string, statistic double, dof long, pvalue double")
    return rows.select("method", F.round("statistic", 6).alias("statistic"), "dof", F.round("pvalue", 6).alias("pvalue"))


@query()
def monte_carlo(spark, d):
    each, combined = C.monte_carlo(V.counts(spark, d))
    return spark.createDataFrame([(str(k), v) for k, v in each.items()] + [("all", combined)], "j string, p double")


_REPLICATES = """select r, j, i, cast(sum(1 - h) as bigint) a, cast(sum(h) as bigint) b from (select r, user_id % 5 j, event_type i, cast(concat('0x', substr(md5(concat(cast(event_id as varchar), ':', cast(r as varchar))), 1, 8)) as bigint) % 2 h
  from events, (select unnest(range(40)) r) x) y group by r, j, i"""
_SUMMED = """select r, sum(g) g, cast(sum(dof) as bigint) dof from (select r, j, 2 * sum(case when a > 0 then a * ln(a / ea) else 0 end + case when b > 0 then b * ln(b / eb) else 0 end) g, count(*) - 1 dof
  from (select *, (a + b) * na / n ea, (a + b) * nb / n eb from (select r, j, cast(a as double) a, cast(b as double) b, cast(sum(a) over w as double) na, cast(sum(b) over w as double) nb, cast(sum(a + b) over w as double) n from reps window w as (partition by r, j)) z) y group by r, j) x group by r"""


def _replicates(spark, d):
    """Forty tables of the events with each event's group drawn anew, by a hash that both engines have."""
    half = F.conv(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("long") % 2
    e = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("j"), F.col("event_type").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("r"))
    return e.groupBy("r", "j", "i").agg(F.count_if(half == 0).alias("a"), F.count_if(half == 1).alias("b"))


@query(sql("select r, round(g, 6) g, dof from summed", "counts", reps=_REPLICATES, summed=_SUMMED))
def batched_g(spark, d):
    """The summed G of many tables at once."""
    return C.g_of_replicates(_replicates(spark, d)).select("r", F.round("g", 6).alias("g"), "dof")


@query(sql("""select k.bin, round(least_ + k.bin * w, 6) low, round(least_ + (k.bin + 1) * w, 6) high, count(s.g) n, coalesce(k.bin = min(least(7, floor((o.g - least_) / w))) and min(o.g) between least_ and most_, false) observed
  from (select unnest(range(8)) bin) k cross join (select min(g) least_, max(g) most_, (max(g) - min(g)) / 8 w from summed) e cross join (select g from summed where r = 0) o
  left join summed s on least(7, floor((s.g - least_) / w)) = k.bin group by k.bin, least_, most_, w""", "counts", reps=_REPLICATES, summed=_SUMMED))  # fmt: skip
def null_histogram(spark, d):
    """The figure of a null distribution: the replicates' statistics in bins, the first replicate taken as observed."""
    g = cut(C.g_of_replicates(_replicates(spark, d)), "g")
    return P.null_histogram(g, g.where("r = 0").first().g, 8).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n", "observed")


@query(sql("select j, i, a, b from counts where a * 2 < b * 3 and b > a", "counts"))
def significant_rows(spark, d):
    """A compound predicate over two columns."""
    return V.counts(spark, d).where((F.col("a") * 2 < F.col("b") * 3) & (F.col("b") > F.col("a")))


@query(sql("select j, arg_min(i, rank) i, max(abs(a - b)) gap from (select *, row_number() over (partition by j order by abs(a - b) desc, i) rank from counts) z group by j", "counts"))
def argmax_row(spark, d):
    """The category with the largest gap in each stratum, first name if tied."""
    gap = F.abs(F.col("a") - F.col("b"))
    return V.counts(spark, d).groupBy("j").agg(F.min_by("i", F.struct(-gap, "i")).alias("i"), F.max(gap).alias("gap"))
