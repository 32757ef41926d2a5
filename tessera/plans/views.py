"""Views that shape the benchmark tables as transcripts, sites, a matrix and counts, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.features import introns, noncoding_exons, utrs
from tessera.operators.annotate import isoforms
from tessera.sources.scratch import cut

TABLES = ("lineitem", "orders", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exons(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    gene = F.col("o_custkey") % 200
    base = F.floor(gene / 24) * 200000 + (F.col("o_orderkey") % 10) * 5000
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("tx"), gene.alias("gene"), F.concat(F.lit("chr"), (gene % 24 + 1).cast("string")).alias("chrom"),
        F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("o_orderstatus").alias("st"),
        F.col("l_linenumber").alias("xn"), base.alias("base"),
        (base + F.col("l_linenumber") * 1000 + (F.col("l_partkey") % 3) * 100).alias("s"), F.col("l_quantity").cast("long").alias("q"),
    )
    return cut(rows.withColumn("e", F.col("s") + (F.col("q") % 5 + 1) * 50).drop("q"), "exons")


def cds(exon: DataFrame) -> DataFrame:
    s, e = F.greatest("s", F.col("base") + 2125), F.least("e", F.col("base") + 5125)
    # some transcripts lack coding blocks within their coding span
    return exon.where("st <> 'F' and not (tx % 40 = 0 and xn % 2 = 0)").select("tx", "gene", "chrom", "strand", "xn", s.alias("s"), e.alias("e")).where("s < e")


def sites(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("event_id") * 7919 % 9) * 200000 + (F.col("event_id") * 104729) % 55000
    strand = F.when(F.col("event_id") % 97 == 0, ".").when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("chr"), (F.col("user_id") % 24 + 1).cast("string")).alias("chrom"), strand.alias("strand"), at.alias("s"), (at + 1).alias("e"))


def features(exon: DataFrame) -> DataFrame:
    """Rows (cl, chrom, strand, s, e, gene, tx): coding blocks, 5' and 3' UTRs, exons of non-coding transcripts, introns."""
    own = ["chrom", "strand", "s", "e", "gene", "tx"]
    coding = cds(exon)
    rows = coding.select(F.lit(0).alias("cl"), *own)
    rows = rows.unionByName(noncoding_exons(exon, coding).select(F.lit(3).alias("cl"), *own))
    rows = rows.unionByName(introns(exon).select(F.lit(4).alias("cl"), *own))
    u = utrs(exon, coding, ("gene", "chrom")).select(F.when(F.col("cls") == "5UTR", 1).otherwise(2).alias("cl"), *own)
    return rows.unionByName(u)


def genes(exon: DataFrame) -> DataFrame:
    """Gene bodies (chrom, strand, s, e, gene, gene_name, gene_type)."""
    rows = exon.groupBy("chrom", "strand", "gene").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    kind = F.when(F.col("gene") % 3 == 0, "protein_coding").when(F.col("gene") % 3 == 1, "lncRNA").otherwise("pseudogene")
    return rows.select("chrom", "strand", "s", "e", "gene", F.col("gene").cast("string").alias("gene_name"), kind.alias("gene_type"))


def labelled(spark: SparkSession, d: str, exon: DataFrame | None = None) -> DataFrame:
    return isoforms(features(exons(spark, d) if exon is None else exon))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """Long matrix (gene, sample, v): a gene for every four parts (500 at scale factor 0.01) by 9 samples."""
    genes = max(1, table(spark, d, "part").count() // 4)
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    gene, sample = F.concat(F.lit("G"), (F.col("l_partkey") % genes).cast("string")), F.concat(F.lit("S"), (F.col("l_orderkey") % 9 + 1).cast("string"))
    return rows.groupBy(gene.alias("gene"), sample.alias("sample")).agg(F.sum("l_quantity").alias("v"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of counts (j, i, a, b): stratum, category, and the count of each group."""
    early = F.dayofmonth("ts") <= 15
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("j"), F.col("event_type").alias("i")).agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))


#: The same views as SQL common table expressions, in the order in which they build on one another.
SQL = {
    "exon": """select o_orderkey tx, o_custkey % 200 gene, concat('chr', cast(o_custkey % 200 % 24 + 1 as varchar)) chrom,
      case when o_custkey % 2 = 0 then '+' else '-' end strand, o_orderstatus st, l_linenumber xn,
      (o_custkey % 200 // 24) * 200000 + (o_orderkey % 10) * 5000 base,
      (o_custkey % 200 // 24) * 200000 + (o_orderkey % 10) * 5000 + l_linenumber * 1000 + (l_partkey % 3) * 100 s,
      (o_custkey % 200 // 24) * 200000 + (o_orderkey % 10) * 5000 + l_linenumber * 1000 + (l_partkey % 3) * 100
        + (cast(l_quantity as bigint) % 5 + 1) * 50 e
      from lineitem join orders on l_orderkey = o_orderkey""",
    "cds": """select tx, gene, chrom, strand, xn, greatest(s, base + 2125) s, least(e, base + 5125) e from exon
      where st <> 'F' and not (tx % 40 = 0 and xn % 2 = 0) and greatest(s, base + 2125) < least(e, base + 5125)""",
    "intron": """select tx, gene, chrom, strand, s, e, row_number() over (partition by tx
        order by case when strand = '-' then -s else s end, case when strand = '-' then -e else e end) intron
      from (select tx, gene, chrom, strand, e s, nx e from (select *, lead(s) over (partition by tx order by s, e, xn) nx from exon) z where nx > e) y""",
    "site": """select event_id id, concat('chr', cast(user_id % 24 + 1 as varchar)) chrom,
      case when event_id % 97 = 0 then '.' when event_id % 2 = 0 then '+' else '-' end strand,
      (event_id * 7919 % 9) * 200000 + (event_id * 104729) % 55000 s, (event_id * 7919 % 9) * 200000 + (event_id * 104729) % 55000 + 1 e from events""",
    "piece": """with cr as (select tx, min(s) cmin, max(e) cmax from cds group by tx),
      b as (select distinct exon.tx, gene, chrom, strand, s, e, cmin, cmax from exon join cr on exon.tx = cr.tx),
      h as (select b.*, greatest(cds.s, b.s) hs, least(cds.e, b.e) he from b join cds on b.tx = cds.tx and cds.s < b.e and b.s < cds.e
        union all select b.*, b.e hs, b.e he from b),
      g as (select *, coalesce(max(he) over (partition by tx, s, e order by hs, he rows between unbounded preceding and 1 preceding), s) cur from h)
      select tx, gene, chrom, strand, cur ps, hs pe, cmin, cmax from g where hs > cur""",
    "utr": """with f as (select tx, gene, chrom, strand, ps, least(pe, cmin) pe, 'U' side from piece where ps < cmin union all
        select tx, gene, chrom, strand, greatest(ps, cmax), pe, 'D' from piece where pe > cmax)
      select cls, tx, gene, chrom, strand, ps s, pe e, row_number() over (partition by tx, cls
        order by case when strand = '-' then -ps else ps end, case when strand = '-' then -pe else pe end) blk
      from (select *, case when (side = 'U') = (strand <> '-') then '5UTR' else '3UTR' end cls from f) k""",
    "feat": """select 0 cl, chrom, strand, s, e, gene, tx from cds
      union all select 3, chrom, strand, s, e, gene, tx from exon where tx not in (select tx from cds)
      union all select 4, chrom, strand, s, e, gene, tx from intron
      union all select case cls when '5UTR' then 1 else 2 end, chrom, strand, s, e, gene, tx from utr""",
    "iso": "select cl, chrom, strand, s, e, gene, min(tx) rep, count(*) n from feat group by cl, chrom, strand, s, e, gene",
    "gene": "select chrom, strand, gene, min(s) s, max(e) e, case gene % 3 when 0 then 'protein_coding' when 1 then 'lncRNA' else 'pseudogene' end gene_type from exon group by chrom, strand, gene",
    "hit": """select site.id, iso.*, (iso.strand = site.strand or site.strand = '.') same from site join iso on site.chrom = iso.chrom and iso.s < site.e and site.s < iso.e""",
    "lab": """select site.*, h.cl, h.alt from site left join
      (select id, min(case when same then cl end) cl, min(cl) alt from hit group by id) h on h.id = site.id""",
    "matrix": """select concat('G', cast(l_partkey % (select greatest(1, count(*) // 4) from part) as varchar)) gene, concat('S', cast(l_orderkey % 9 + 1 as varchar)) sample,
      sum(l_quantity) v from lineitem group by 1, 2""",
    "counts": """select user_id % 5 j, event_type i, cast(sum(case when day(ts) <= 15 then 1 else 0 end) as bigint) a,
      cast(sum(case when day(ts) > 15 then 1 else 0 end) as bigint) b from events group by 1, 2""",
}


def sql(query: str, *views: str, **more: str) -> str:
    """query after the views it needs (and those they build on), and further expressions."""
    needs = {"cds": ["exon"], "intron": ["exon"], "feat": ["cds", "intron", "utr"], "iso": ["feat"], "gene": ["exon"], "hit": ["site", "iso"], "lab": ["hit"], "utr": ["piece"], "piece": ["exon", "cds"]}
    wanted: set[str] = set()
    queue = list(views)
    while queue:
        v = queue.pop()
        wanted.add(v)
        queue += needs.get(v, [])
    parts = {k: v for k, v in SQL.items() if k in wanted} | more
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + "\n" + query
