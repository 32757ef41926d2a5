"""Queries over the interval operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import annotate as A
from tessera.operators import features as G
from tessera.operators import interpret as T
from tessera.operators import intervals as I
from tessera.plans import views as V
from tessera.plans.views import sql
from tessera.sources.gtf import attributes
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


DETAIL_SQL = "case {c} when 0 then 'CDS' when 1 then '5UTR' when 2 then '3UTR' when 3 then 'noncoding_exon' when 4 then 'intron' else 'UN' end"
LABEL_SQL = "case {c} when 0 then 'exon' when 1 then '5UTR' when 2 then '3UTR' when 3 then 'exon' when 4 then 'intron' else 'UN' end"
detail, label = (lambda c: DETAIL_SQL.replace("{c}", c)), (lambda c: LABEL_SQL.replace("{c}", c))


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return A.annotate(V.sites(spark, d), V.labelled(spark, d))


@query(sql(f"select {detail('cl')} feature_detail, count(*) n from lab group by 1", "lab"))
def site_labels(spark, d):
    """Sites of each class: the flagship."""
    return _annotated(spark, d).groupBy("feature_detail").agg(F.count("*").alias("n"))


@query(sql(f"""select site.id, {label('lab.cl')} feature_type, {detail('lab.cl')} feature_detail, {label('lab.alt')} alt_strand_label,
  coalesce(w.gene_ids, 'NA') gene_ids, coalesce(case when w.k > 3 then concat(w.first3, ',(+', cast(w.k - 3 as varchar), ' more)') else w.first3 end, 'NA') transcript_ids,
  coalesce(w.n, 0) n_transcripts, coalesce(w.ng, 0) n_genes, coalesce(a.hit, 'UN') all_features_hit, coalesce(c.ctx, 'intergenic') gene_context
  from site join lab on site.id = lab.id
  left join (select id, string_agg(distinct cast(gene as varchar), ',' order by cast(gene as varchar)) gene_ids, cast(count(distinct gene) as bigint) ng, cast(sum(n) as bigint) n,
      count(distinct rep) k, array_to_string(list_sort(list_distinct(list(cast(rep as varchar))))[1:3], ',') first3
    from (select hit.*, min(cl) over (partition by id) best from hit where same) z where cl = best group by id) w on w.id = site.id
  left join (select id, array_to_string(list_transform(list_sort(list_distinct(list(cl))), lambda c: {detail('c')}), ';') hit from hit where same group by id) a on a.id = site.id
  left join (select site.id, string_agg(distinct cast(gene as varchar), ',' order by cast(gene as varchar)) ctx from site join gene
    on site.chrom = gene.chrom and (site.strand = gene.strand or site.strand = '.') and gene.s < site.e and site.s < gene.e group by site.id) c on c.id = site.id""", "lab", "gene"))  # fmt: skip
def site_annotation_detail(spark, d):
    """The whole annotation record of each site."""
    exon = V.exons(spark, d)
    rows = A.annotate(V.sites(spark, d), V.labelled(spark, d, exon), V.genes(exon))
    return rows.select("id", "feature_type", "feature_detail", "alt_strand_label", "gene_ids", "transcript_ids", F.col("n_transcripts").cast("long").alias("n_transcripts"), "n_genes", "all_features_hit", "gene_context")


@query(sql(f"""select count(*) n_regions, count(cl) n_mapped, cast(sum(case when {label('cl')} <> {label('alt')} then 1 else 0 end) as bigint) n_strand_flips,
  (select count(*) from (select id from (select hit.*, min(cl) over (partition by id) best from hit where same) z where cl = best group by id having count(distinct gene) > 1) y) n_multi_gene from lab""", "lab"))  # fmt: skip
def strand_flip(spark, d):
    return A.summary(_annotated(spark, d))


@query(sql(f"select chrom, {', '.join(f'''cast(sum(case when {label('cl')} = '{x}' then 1 else 0 end) as bigint) n_{x.lower()}''' for x in ('5UTR', '3UTR', 'exon', 'intron', 'UN'))} from lab group by chrom", "lab"))
def per_chromosome(spark, d):
    return T.per_chromosome(_annotated(spark, d))


@query(sql("select cast(gene as varchar) gene, cast(count(*) as bigint) n from (select distinct id, gene from (select hit.*, min(cl) over (partition by id) best from hit where same) z where cl = best) y group by 1", "hit"))
def gene_frequency(spark, d):
    return T.gene_frequency(_annotated(spark, d))


@query(sql("select tx, gene, chrom, strand, s, e, intron from intron", "intron"))
def introns(spark, d):
    return G.introns(V.exons(spark, d)).select("tx", "gene", "chrom", "strand", "s", "e", F.col("intron").cast("long").alias("intron"))


@query(sql("select cls, tx, strand, s, e, blk from utr", "utr"))
def utr_blocks(spark, d):
    exon = V.exons(spark, d)
    return G.utrs(exon, V.cds(exon)).withColumn("blk", F.col("blk").cast("long"))


_SHIPPED = "select tx, s, e from utr where not (tx % 50 = 0 and blk = 1) union all select tx, s + 1, e from utr where tx % 70 = 0"


@query(sql("""select coalesce(o.tx, t.tx) tx, cast(sum(case when o.tx is not null and t.tx is not null then 1 else 0 end) as bigint) n_both,
  cast(sum(case when t.tx is null then 1 else 0 end) as bigint) n_ours, cast(sum(case when o.tx is null then 1 else 0 end) as bigint) n_theirs
  from (select distinct tx, ps s, pe e from piece) o full join (select distinct tx, s, e from shipped) t on o.tx = t.tx and o.s = t.s and o.e = t.e group by 1""", "utr", shipped=_SHIPPED))  # fmt: skip
def utr_self_check(spark, d):
    """Derived blocks against blocks as another source would ship them, some missing and some shifted."""
    exon = V.exons(spark, d)
    u = G.utrs(exon, V.cds(exon))
    shipped = u.where("not (tx % 50 = 0 and blk = 1)").select("tx", "s", "e").unionAll(u.where("tx % 70 = 0").selectExpr("tx", "s + 1", "e"))
    return G.utr_check(exon, V.cds(exon), shipped)


@query(sql("""select 'exon' feature, count(*) n from exon union all select 'cds', count(*) from cds union all select 'intron', count(*) from intron
  union all select '5UTR', count(*) from utr where cls = '5UTR' union all select '3UTR', count(*) from utr where cls = '3UTR'
  union all select 'gene', count(*) from gene union all select 'transcript', count(distinct tx) from exon""", "cds", "intron", "utr", "gene"))  # fmt: skip
def feature_counts(spark, d):
    exon = V.exons(spark, d)
    named = {"exon": exon, "cds": V.cds(exon), "intron": G.introns(exon), "gene": V.genes(exon), "transcript": exon.select("tx").distinct()}
    rows = None
    for name, df in named.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("feature"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(G.utrs(exon, V.cds(exon)).groupBy(F.col("cls").alias("feature")).agg(F.count("*").alias("n")))


@query(sql("""select (select count(distinct o_orderkey) from orders) n_transcripts, (select count(distinct tx) from cds) n_coding,
  (select count(*) from (select distinct o_orderkey from orders) o where o_orderkey not in (select tx from exon)) n_no_exon,
  (select count(*) from (select tx from exon group by tx having count(*) = 1) z) n_single_exon,
  (select count(distinct tx) from piece where pe > cmin and ps < cmax) n_ambiguous""", "piece"))  # fmt: skip
def transcript_stats(spark, d):
    exon = V.exons(spark, d)
    return G.transcript_stats(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("tx")), exon, V.cds(exon))


_MERGED = """select chrom, strand, min(s) s, max(e) e from (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by chrom, strand order by s, e rows between unbounded preceding and current row) g
  from (select *, max(e) over (partition by chrom, strand order by s, e rows between unbounded preceding and 1 preceding) pe from (select distinct chrom, strand, s, e from {t}) t) a) b group by chrom, strand, g"""


@query(sql(_MERGED.replace("{t}", "exon"), "exon"))
def merged_intervals(spark, d):
    return I.merge(V.exons(spark, d), ["chrom", "strand"])


@query(sql("""select chrom, strand, cur s, hs e from (select *, coalesce(max(he) over (partition by chrom, strand, s, e order by hs, he rows between unbounded preceding and 1 preceding), s) cur from
  (select g.chrom, g.strand, g.s, g.e, greatest(m.s, g.s) hs, least(m.e, g.e) he from body g join me m on g.chrom = m.chrom and g.strand = m.strand and m.s < g.e and g.s < m.e
   union all select chrom, strand, s, e, e, e from body) h) z where hs > cur""", "gene", body=_MERGED.replace("{t}", "gene"), me=_MERGED.replace("{t}", "exon")))  # fmt: skip
def subtracted_intervals(spark, d):
    """Parts of gene bodies without exons."""
    exon = V.exons(spark, d)
    keys = ["chrom", "strand"]
    return I.subtract(I.merge(V.genes(exon), keys), I.merge(exon, keys), keys).select(*keys, F.col("ps").alias("s"), F.col("pe").alias("e"))


@query(sql("""select site.id, iso.cl, iso.gene, iso.s, iso.e from site join iso on site.chrom = iso.chrom and site.strand = iso.strand and iso.s < site.e and site.s < iso.e""", "site", "iso"))
def overlap_pairs(spark, d):
    q = V.sites(spark, d).withColumnRenamed("s", "qs").withColumnRenamed("e", "qe")
    return I.overlap(q, V.labelled(spark, d), ["chrom", "strand"]).select("id", "cl", "gene", "s", "e")


_SPACE = """with ev as (select chrom, strand, p, {sums} from (select cl, chrom, strand, s p, 1 d from feat union all select cl, chrom, strand, e, -1 from feat) x group by chrom, strand, p),
  seg as (select chrom, strand, p, lead(p) over (partition by chrom, strand order by p) q, {runs} from ev),
  own as (select q - p bp, case {cases} end cl from seg where q is not null)
  select k.cl, cast(coalesce(sum(bp), 0) as bigint) bp from (values (0), (1), (2), (3), (4)) k(cl) left join own on own.cl = k.cl group by k.cl"""
_SPACE = _SPACE.replace("{sums}", ", ".join(f"sum(case when cl = {c} then d else 0 end) d{c}" for c in range(5)))
_SPACE = _SPACE.replace("{runs}", ", ".join(f"sum(d{c}) over (partition by chrom, strand order by p) n{c}" for c in range(5)))
_SPACE = _SPACE.replace("{cases}", " ".join(f"when n{c} > 0 then {c}" for c in range(5)))


@query(sql("select cl, bp from space", "feat", space=_SPACE))
def class_space(spark, d):
    return T.class_space(V.features(V.exons(spark, d)), V.sites(spark, d))


@query(sql(f"""select {detail('cl')} feature, bp, round(share, 6) share, observed, round(share * mapped, 6) expected,
  round(case when share * mapped > 0 and observed > 0 then log2(observed / (share * mapped)) end, 6) log2_fold from
  (select space.cl, bp, bp / sum(bp) over () share, coalesce(n, 0) observed, sum(coalesce(n, 0)) over () mapped from space left join (select cl, count(*) n from lab group by cl) c on c.cl = space.cl) z""", "feat", "lab", space=_SPACE))  # fmt: skip
def enrichment(spark, d):
    features = cut(V.features(V.exons(spark, d)), "features")
    rows = T.enrichment(T.class_space(features, V.sites(spark, d)), A.annotate(V.sites(spark, d), A.isoforms(features)))
    return rows.select("feature", "bp", F.round("share", 6).alias("share"), "observed", F.round("expected", 6).alias("expected"), F.round("log2_fold", 6).alias("log2_fold"))


@query(sql(f"""select {2 * T.GENOME} - (select sum(bp) from space) bp, count(*) - count(cl) observed, round(count(*) * cast({2 * T.GENOME} - (select sum(bp) from space) as double) / {2 * T.GENOME}, 4) expected,
  round(log2((count(*) - count(cl)) / (count(*) * cast({2 * T.GENOME} - (select sum(bp) from space) as double) / {2 * T.GENOME})), 6) log2_fold from lab""", "feat", "lab", space=_SPACE))  # fmt: skip
def unmapped_enrichment(spark, d):
    features = cut(V.features(V.exons(spark, d)), "features")
    rows = T.unmapped_enrichment(T.class_space(features, V.sites(spark, d)), A.annotate(V.sites(spark, d), A.isoforms(features)))
    return rows.select("bp", "observed", F.round("expected", 4).alias("expected"), F.round("log2_fold", 6).alias("log2_fold"))


_ENDS = "select distinct chrom, strand, case when strand = '-' then s + 1 else e end p from (select chrom, strand, tx, min(s) s, max(e) e from exon group by chrom, strand, tx) t"
_STARTS = "select distinct chrom, strand, case when strand = '-' then e else s + 1 end p from (select chrom, strand, tx, min(s) s, max(e) e from exon group by chrom, strand, tx) t"
_NEAR = """select * from (select id, chrom, strand, p, q, case when h is null or (l is not null and p - l <= h - p) then p - l else p - h end distance from
  (select *, last_value(r ignore nulls) over (partition by chrom, strand order by p, q rows between unbounded preceding and current row) l,
     first_value(r ignore nulls) over (partition by chrom, strand order by p, q desc rows between current row and unbounded following) h
   from (select id, chrom, strand, e p, null r, 1 q from site union all select null, chrom, strand, p, p, 0 from ends) u) v) w where q = 1"""


def _ends(spark, d, exon=None, end="3"):
    t = (V.exons(spark, d) if exon is None else exon).groupBy("chrom", "strand", "tx").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return A.three_prime(t, end)


@query(sql("select id, distance from near", "exon", "site", ends=_ENDS, near=_NEAR))
def nearest_end(spark, d):
    rows = V.sites(spark, d).select("id", "chrom", "strand", F.col("e").alias("p"))
    return I.nearest(rows, _ends(spark, d), ["chrom", "strand"]).select("id", "distance")


_HIST = """select o.x "offset", coalesce(n, 0) n, round(100 * coalesce(n, 0) / (select count(distance) from near), 6) share
  from (select unnest(range(-10, 11)) x) o left join (select distance, count(*) n from near group by distance) c on c.distance = o.x"""


@query(sql(_HIST, "exon", "site", ends=_ENDS, near=_NEAR))
def nearest_end_hist(spark, d):
    rows = V.sites(spark, d).select("chrom", "strand", F.col("e").alias("p"))
    return A.end_histogram(rows, _ends(spark, d)).withColumn("share", F.round("share", 6))


@query(sql(_HIST, "exon", "site", ends=_STARTS, near=_NEAR))
def nearest_start_hist(spark, d):
    """The control: distances to the other end of transcripts."""
    rows = V.sites(spark, d).select("chrom", "strand", F.col("e").alias("p"))
    return A.end_histogram(rows, _ends(spark, d, end="5")).withColumn("share", F.round("share", 6))


@query(sql(f"""select "offset" peak, n from ({_HIST}) h order by n desc, "offset" limit 1""", "exon", "site", ends=_ENDS, near=_NEAR))
def nearest_end_peak(spark, d):
    return A.histogram_peak(nearest_end_hist(spark, d))


def _measured(spark, d):
    exon = V.exons(spark, d)
    rows = A.annotate(V.sites(spark, d), V.labelled(spark, d, exon))
    return T.oriented(rows.select("id", "chrom", "strand", "s", "e", "feature_type"), _ends(spark, d, exon))


_ORIENTED = "select near.id, case when near.strand = '-' then -distance else distance end distance, cl from near join lab on near.id = lab.id"


@query(sql("""select b.band, b.low, cast(coalesce(sum(case when distance >= 0 then 1 else 0 end), 0) as bigint) downstream, cast(coalesce(sum(case when distance < 0 then 1 else 0 end), 0) as bigint) upstream
  from (values (0, 0, 100), (1, 100, 500), (2, 500, 1000), (3, 1000, 5000), (4, 5000, 10000), (5, 10000, 50000), (6, 50000, 1000000000000)) b(band, low, high)
  left join (select * from ori where cl is null and distance is not null) o on abs(distance) >= low and abs(distance) < high group by b.band, b.low""", "lab", "exon", ends=_ENDS, near=_NEAR, ori=_ORIENTED))  # fmt: skip
def un_distance_bands(spark, d):
    return T.distance_bands(_measured(spark, d))


@query(sql("""select count(distance) n_tested, cast(sum(case when distance = 0 then 1 else 0 end) as bigint) n_exact, cast(sum(case when abs(distance) <= 50 then 1 else 0 end) as bigint) n_within_50,
  cast(sum(case when distance is null and cl is null then 1 else 0 end) as bigint) n_no_reference from ori""", "lab", "exon", ends=_ENDS, near=_NEAR, ori=_ORIENTED))  # fmt: skip
def distance_counts(spark, d):
    return T.distance_counts(_measured(spark, d))


_UTR_SITE = """select id, s, min(cast(rep as varchar)) tx from (select site.id, site.s, f.cl, f.rep, min(f.cl) over (partition by site.id) best from site join iso f
  on site.chrom = f.chrom and (site.strand = f.strand or site.strand = '.') and f.s < site.e and site.s < f.e) z where cl = best and cl = 2 group by id, s"""
_PLACED = """select *, sum(e - s) over (partition by tx) total, coalesce(sum(e - s) over (partition by tx order by case when strand = '-' then -s else s end, case when strand = '-' then -e else e end
  rows between unbounded preceding and 1 preceding), 0) before from utr where cls = '3UTR'"""


_METAGENE = """select b.bin, count(o.id) n from (select unnest(range(0, 20)) bin) b left join
  (select id, least(19, floor((before + w) / total * 20)) bin from (select us.id, p.before, p.total, case when p.strand = '-' then p.e - 1 - us.s else us.s - p.s end w,
     row_number() over (partition by us.id order by p.before, p.s) r from us join placed p on us.tx = cast(p.tx as varchar) and p.s <= us.s and us.s < p.e) z where r = 1) o on o.bin = b.bin group by b.bin"""


@query(sql(_METAGENE, "site", "iso", "utr", us=_UTR_SITE, placed=_PLACED))
def metagene(spark, d):
    exon = V.exons(spark, d)
    rows = cut(A.annotate(V.sites(spark, d), V.labelled(spark, d, exon)).select("id", "s", "feature_detail", "first_tx"), "annotated")
    return T.metagene(rows, cut(G.utrs(exon, V.cds(exon)).where("cls = '3UTR'"), "utrs")).withColumn("n", F.col("n").cast("long"))


@query(sql("""select cast(sum(n) as bigint) placed, cast(sum(case when bin < 2 then n else 0 end) as bigint) n_first, cast(sum(case when bin >= 18 then n else 0 end) as bigint) n_last,
  round(sum(case when bin >= 18 then n else 0 end) / nullif(sum(case when bin < 2 then n else 0 end), 0), 6) ratio from bins""", "site", "iso", "utr", us=_UTR_SITE, placed=_PLACED, bins=_METAGENE))  # fmt: skip
def metagene_deciles(spark, d):
    return T.deciles(metagene(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(sql("""select gene_type, count(*) n from (select id, min(cast(gene as varchar)) g from (select hit.*, min(cl) over (partition by id) best from hit where same) z where cl = best group by id) s
  join (select distinct cast(gene as varchar) gene, gene_type from gene) t on t.gene = s.g group by gene_type order by n desc, gene_type limit 15""", "hit", "gene"))  # fmt: skip
def biotypes(spark, d):
    exon = V.exons(spark, d)
    return T.biotypes(A.annotate(V.sites(spark, d), V.labelled(spark, d, exon)), V.genes(exon))


@query("""with v as (select distinct o_custkey from orders),
  l as (select concat('gene_id "G', cast(o_custkey % 200 as varchar), '"; gene_name "N', cast(o_custkey as varchar), '"; level ', cast(o_custkey % 3 as varchar), '; tag "a"; tag "b', cast(o_custkey % 7 as varchar), '";') a, o_custkey from v)
  select o_custkey, regexp_extract(a, 'gene_id "([^"]+)"', 1) gene_id, regexp_extract(a, 'gene_name "([^"]+)"', 1) gene_name, regexp_extract(a, 'level ([0-9]+)', 1) "level", regexp_extract(a, 'tag "(b[^"]+)"', 1) tag from l""")
def gtf_attributes(spark, d):
    """Attribute strings parsed back: wanted keys, last value of a repeated key."""
    k = V.table(spark, d, "orders").select("o_custkey").distinct()
    text = F.format_string('gene_id "G%d"; gene_name "N%d"; level %d; tag "a"; tag "b%d";', F.col("o_custkey") % 200, F.col("o_custkey"), F.col("o_custkey") % 3, F.col("o_custkey") % 7)
    return k.select("o_custkey", *attributes(text, ["gene_id", "gene_name", "level", "tag"]))


@query(sql("""select chrom, row_number() over (order by case when regexp_matches(b, '^[0-9]+$') then 0 when b in ('X', 'Y') then 1 when b in ('M', 'MT') then 2 else 3 end, try_cast(b as bigint), b) pos
  from (select distinct chrom, substr(chrom, 4) b from (select chrom from site union all select unnest(['chrX', 'chrM', 'chrY', 'chrUn_1', 'chrMT'])) u) z""", "site"))  # fmt: skip
def natural_chrom_sort(spark, d):
    from pyspark.sql import Window

    more = spark.createDataFrame([(x,) for x in ("chrX", "chrM", "chrY", "chrUn_1", "chrMT")], "chrom string")
    rows = V.sites(spark, d).select("chrom").unionByName(more).distinct()
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*T.chrom_order())).cast("long"))
