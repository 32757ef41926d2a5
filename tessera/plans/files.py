"""Queries over sources and sinks: the benchmark tables laid down as files, read back, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import annotate as A
from tessera.plans import views as V
from tessera.plans.genomic import ORACLE as GENOMIC
from tessera.plans.views import sql
from tessera.sources import bed, gtf, pdf, text
from tessera.sources.scratch import cut, path
from tessera.sources.table import read_table

DETAIL = GENOMIC["site_annotation_detail"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


def _written(spark: SparkSession, lines: Column, rows: DataFrame, *order: str, compression: str = "none") -> str:
    """The path of text files with a line for each row, in the order given, and a comment first."""
    at = path(spark, "lines")
    body = rows.select(*order, lines.alias("value")).unionByName(spark.createDataFrame([("# comment",)], "value string"), allowMissingColumns=True)
    body.orderBy(*[F.col(c).asc_nulls_first() for c in order]).select("value").write.option("compression", compression).text(at)
    return at


def _gtf(spark: SparkSession, d: str) -> DataFrame:
    """Genes, transcripts, exons, coding blocks and stop codons of the benchmark tables as a GTF file, gzip, scanned.

    Every tenth gene and eleventh transcript has an earlier line with other values: the last line of an id counts.
    """
    exon = V.exons(spark, d)
    coding = V.cds(exon)
    line = lambda feature, more: F.format_string(f"%s\tX\t{feature}\t%d\t%d\t.\t%s\t.\t%s", "chrom", F.col("s") + 1, F.col("e"), "strand", more).alias("line")
    gene = F.format_string('gene_id "%s"; gene_name "N%s";', "gene", "gene")
    tx = F.concat(gene, F.format_string(' transcript_id "T%s"; level 2;', "tx"))
    # a transcript's line comes before its children's, but for every 35th, which has none
    t = exon.groupBy("tx", "gene", "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    g = exon.groupBy("gene", "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn("tx", F.lit(None).cast("long"))
    stop = coding.where("tx % 3 = 0").groupBy("tx", "gene", "chrom", "strand").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    minus = F.col("strand") == "-"
    stop = stop.withColumns({"s": F.when(minus, F.col("lo") - 3).otherwise(F.col("hi")), "e": F.when(minus, F.col("lo")).otherwise(F.col("hi") + 3)})
    old = F.format_string('gene_id "%s"; gene_name "old";', "gene")
    part = lambda rows, k, text: rows.select("gene", "tx", F.lit(k).alias("k"), "s", text)
    numbered = F.concat(tx, F.format_string(" exon_number %s;", "xn"))
    rows = part(g.where("gene % 10 = 0"), 0, line("gene", old)).unionByName(part(g, 1, line("gene", gene)))
    rows = rows.unionByName(part(t.where("tx % 35 <> 0 and tx % 11 = 0"), 2, line("transcript", F.concat(old, F.format_string(' transcript_id "T%s";', "tx")))))
    rows = rows.unionByName(part(t.where("tx % 35 <> 0"), 3, line("transcript", tx)))
    rows = rows.unionByName(part(exon, 4, line("exon", numbered))).unionByName(part(coding, 5, line("CDS", numbered)))
    rows = rows.unionByName(part(stop, 6, line("stop_codon", tx))).unionByName(part(t, 7, line("Selenocysteine", tx)))
    return gtf.scan(spark, _written(spark, F.col("line"), rows, "gene", "tx", "k", "s", compression="gzip"))


_STOP = """select tx, gene, chrom, strand, case when strand = '-' then lo - 3 else hi end s, case when strand = '-' then lo else hi + 3 end e from
  (select tx, gene, chrom, strand, min(s) lo, max(e) hi from cds where tx % 3 = 0 group by tx, gene, chrom, strand) z"""


@query(sql("""select feature, count(*) n, cast(sum(s) as bigint) s, cast(sum(e) as bigint) e, count(*) n_gene, count(tx) n_tx from (
  select 'gene' feature, min(s) s, max(e) e, null tx from exon group by gene, chrom, strand union all select 'gene', min(s), max(e), null from exon where gene % 10 = 0 group by gene, chrom, strand
  union all select 'transcript', min(s), max(e), tx from exon where tx % 35 <> 0 group by tx union all select 'transcript', min(s), max(e), tx from exon where tx % 35 <> 0 and tx % 11 = 0 group by tx
  union all select 'exon', s, e, tx from exon union all select 'CDS', s, e, tx from cds union all select 'stop_codon', s, e, tx from stops) x group by feature""", "exon", "cds", stops=_STOP))  # fmt: skip
def gtf_scan(spark, d):
    """Lines kept by feature type, coordinates 0-based, attributes by key; other types and comments skipped."""
    return _gtf(spark, d).groupBy("feature").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("e").alias("e"), F.count("gene_id").alias("n_gene"), F.count("transcript_id").alias("n_tx"))


@query(sql("select concat('', cast(gene as varchar)) gene_id, chrom, min(s) s, max(e) e, strand, concat('N', cast(gene as varchar)) gene_name, 'NA' gene_type from exon group by gene, chrom, strand", "exon"))
def gtf_genes(spark, d):
    return gtf.genes(_gtf(spark, d))


@query(sql("""select concat('T', cast(tx as varchar)) transcript_id, chrom, min(s) s, max(e) e, strand, concat('T', cast(tx as varchar)) transcript_name, cast(gene as varchar) gene_id,
  concat('N', cast(gene as varchar)) gene_name, 'NA' transcript_type from exon where tx % 35 <> 0 group by tx, gene, chrom, strand""", "exon"))  # fmt: skip
def gtf_transcripts(spark, d):
    return gtf.transcripts(_gtf(spark, d)).drop("line_no")


_CHILD = "select concat('T', cast(tx as varchar)) tx, cast(gene as varchar) gene, concat('N', cast(gene as varchar)) gene_name, chrom, strand, s, e, cast(xn as varchar) xn from {t} where tx % 35 <> 0"


@query(sql(_CHILD.replace("{t}", "exon"), "exon"))
def gtf_exons(spark, d):
    """Exons with their transcript's columns; those without a transcript's line are dropped."""
    return gtf.children(_gtf(spark, d), "exon").drop("tx_name", "tx_type")


@query(sql(_CHILD.replace("{t}", "cds"), "cds"))
def gtf_coding_exons(spark, d):
    return gtf.children(_gtf(spark, d), "CDS").drop("tx_name", "tx_type")


@query(sql("""select concat('T', cast(tx as varchar)) tx, min(s) s, max(e) e from (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by tx order by s, e rows between unbounded preceding and current row) g
  from (select *, max(e) over (partition by tx order by s, e rows between unbounded preceding and 1 preceding) pe from (select tx, s, e from cds union all select tx, s, e from stops) t where tx % 35 <> 0) a) b group by tx, g""", "cds", stops=_STOP))  # fmt: skip
def gtf_stop_codons(spark, d):
    """Coding blocks with the stop codons of their transcripts, touching ones merged."""
    from tessera.operators.features import with_stop_codons

    scanned = cut(_gtf(spark, d), "gtf")
    return with_stop_codons(gtf.children(scanned, "CDS"), gtf.children(scanned, "stop_codon"))


@query(sql("select feature, count(*) n from (select 'exon' feature, tx from exon union all select 'CDS', tx from cds union all select 'stop_codon', tx from stops) x where tx % 35 = 0 group by feature", "cds", stops=_STOP))
def gtf_orphans(spark, d):
    return gtf.orphans(_gtf(spark, d))


_PACKED = """select chrom, s, e, concat('N', cast(gene as varchar), '|T', cast(tx as varchar), '|intron', cast(intron as varchar)) name, strand, cast(intron as varchar) intron_number,
  concat('T', cast(tx as varchar)) transcript_id, cast(gene as varchar) gene_id from intron"""


def _intron_bed(spark: SparkSession, d: str) -> str:
    from tessera.operators.features import introns

    t = F.format_string("T%s", "tx")
    rows = introns(V.exons(spark, d)).select(
        "chrom", "s", "e", "strand", F.col("intron").alias("intron_number"), t.alias("transcript_id"), t.alias("transcript_name"),
        F.col("gene").cast("string").alias("gene_id"), F.format_string("N%s", "gene").alias("gene_name"), F.lit("NA").alias("transcript_type"),
    )
    at = path(spark, "bed")
    bed.write_bed(rows, at, "introns")
    return at


@query(sql(_PACKED, "intron"))
def bed_round_trip(spark, d):
    """Introns written as a feature BED, its names packed, and read back by its layout."""
    return bed.read_features(spark, _intron_bed(spark, d), "introns").select("chrom", "s", "e", "name", "strand", "intron_number", "transcript_id", "gene_id")


@query(sql("select row_number() over (order by cast(substr(chrom, 4) as bigint), s, e, name) - 1 line, chrom, s, e, name from packed", "intron", packed=_PACKED))
def bed_order(spark, d):
    """The lines of a feature BED as they stand in the file: natural order of chromosomes, then start, end and name."""
    f = F.split("value", "\t")
    rows = bed.dense(text.indexed(spark, _intron_bed(spark, d)), "row_id")
    return rows.select(F.col("row_id").alias("line"), f[0].alias("chrom"), f[1].cast("long").alias("s"), f[2].cast("long").alias("e"), f[3].alias("name"))


_SITES = "select id, chrom, strand, s + 1 p from site"


@query(sql("select row_number() over (order by id) - 1 id, chrom, case when id % 2 = 0 then strand else '.' end strand, p - 1 s, p e from few", "site", few=_SITES))
def region_scan(spark, d):
    """Points of no length, strands in the fourth or no field: dense ids in file order, one base before the point."""
    rows = V.sites(spark, d).withColumn("p", F.col("s") + 1)
    line = F.concat_ws("\t", "chrom", F.col("p").cast("string"), F.col("p").cast("string"), F.when(F.col("id") % 2 == 0, F.col("strand")).otherwise("x"))
    return bed.read_regions(spark, _written(spark, line, rows, "id")).select("id", "chrom", "strand", "s", "e")


@query(sql("select row_number() over (order by id) - 1 id, chrom, strand, p from few", "site", few=_SITES))
def position_scan(spark, d):
    rows = V.sites(spark, d).withColumn("p", F.col("s") + 1)
    return bed.read_positions(spark, _written(spark, F.concat_ws("\t", "chrom", F.col("p").cast("string"), F.lit("x"), "strand"), rows, "id"))


@query(sql("select row_number() over (order by s.id) - 1 line, s.id, s.chrom, {label} feature_type from site s join lab on lab.id = s.id".replace("{label}", "case lab.cl when 0 then 'exon' when 1 then '5UTR' when 2 then '3UTR' when 3 then 'exon' when 4 then 'intron' else 'UN' end"), "lab"))
def annotated_bed(spark, d):
    """Annotated regions written in input order, their own fields and the label, and read back line by line."""
    rows = A.annotate(V.sites(spark, d), V.labelled(spark, d)).withColumn("fields", F.array("chrom", F.col("id").cast("string")))
    at = path(spark, "annotated")
    bed.write_annotated(rows, at)
    f = F.split("value", "\t")
    return bed.dense(text.indexed(spark, at), "row_id").select(F.col("row_id").alias("line"), f[1].cast("long").alias("id"), f[0].alias("chrom"), f[2].alias("feature_type"))


@query(f"""select s.chrom, cast(a.id as varchar) "start", cast(s.e as varchar) "end", s.strand, cast(s.s as varchar) query_start_bed, cast(s.e as varchar) query_end_bed, a.feature_type, a.feature_detail,
  a.gene_ids gene_id, a.gene_ids gene_name, a.transcript_ids, cast(a.n_transcripts as varchar) n_transcripts, cast(a.n_genes as varchar) n_genes, a.all_features_hit, a.gene_context
  from ({DETAIL}) a join ({V.SQL["site"]}) s on s.id = a.id""")
def detailed_tsv(spark, d):
    """The detailed table of annotated regions written with its header and read back by it."""
    exon = V.exons(spark, d)
    sites = V.sites(spark, d)
    rows = A.annotate(sites, V.labelled(spark, d, exon), V.genes(exon)).withColumn("fields", F.array("chrom", F.col("id").cast("string"), F.col("e").cast("string")))
    at = path(spark, "detailed")
    bed.write_detailed(rows, at)
    return bed.read_detailed(spark, at)


@query("""select c_custkey "key", case when c_custkey % 7 = 0 then null else round(c_acctbal, 2) end bal, case when c_custkey % 5 = 0 then null else c_custkey % 2 end flag,
  cast(date '2020-01-01' + cast(c_custkey % 900 as integer) as varchar) "day", concat('line "', cast(c_custkey as varchar), '",', chr(10), 'next') note, c_custkey + 0.5 mixed, 'bigint double boolean date string double' kinds from customer""")
def table_load(spark, d):
    """Customers laid down as a CSV file with missing tokens, quotes and line ends within quotes; types found by an aggregation."""
    rows = V.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    k, tokens = F.col("c_custkey"), F.array(F.lit("NA"), F.lit(""), F.lit("null"))
    missing = F.get(tokens, (k % 3).cast("int"))
    note = F.concat(F.lit('"line ""'), k.cast("string"), F.lit('"",\nnext"'))
    line = F.concat_ws(
        ",", k.cast("string"), F.when(k % 7 == 0, missing).otherwise(F.round("c_acctbal", 2).cast("string")), F.when(k % 5 == 0, missing).when(k % 2 == 1, "True").otherwise("False"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")).cast("string"), note, F.when(k % 2 == 0, (k + 0.5).cast("string")).otherwise(F.format_string("%d.5", k)),
    )
    head = spark.createDataFrame([("key,bal,flag,day,note,mixed",)], "value string").withColumn("k", F.lit(-1).cast("long"))
    at = path(spark, "csv")
    head.select("k", "value").unionByName(rows.select(k.alias("k"), line.alias("value"))).coalesce(1).sortWithinPartitions("k").select("value").write.text(at)  # one file
    t = read_table(spark, at)
    kinds = F.concat_ws(" ", *[F.first(F.typeof(c)).alias(c) for c in t.columns])
    t = t.crossJoin(t.agg(kinds.alias("kinds")))  # one row
    return t.select("key", "bal", F.col("flag").cast("long").alias("flag"), F.col("day").cast("string").alias("day"), "note", "mixed", "kinds")


_PAGE = 1_800
_LATIN = r"regexp_replace(coalesce(text, ''), '[^ -~\x{A1}-\x{FF}]', '?', 'g')"


def _pdfs(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as a PDF file (path, content), pages of _PAGE characters."""
    rows = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\x{A1}-\x{FF}]", "?").alias("t"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            files = [_pdf([t[i : i + _PAGE] for i in range(0, max(1, len(t)), _PAGE)]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _pdf(pages: list[str]) -> bytes:
    import re
    import zlib

    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {len(pages)} >> endobj".encode()]
    for i, page in enumerate(pages):
        data = zlib.compress(b"BT /F1 9 Tf 40 800 Td (" + re.sub(rb"([\\()])", rb"\\\1", page.encode("latin-1")) + b") Tj ET")
        out.append(f"{3 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >> endobj".encode())
        out.append(f"{4 + 2 * i} 0 obj << /Length {len(data)} /Filter /FlateDecode >> stream\n".encode() + data + b"\nendstream endobj")
    return b"\n".join([*out, b"trailer << /Root 1 0 R >>", b"%%EOF"])


_PAGES = f"select path, page, substr(t, 1 + {_PAGE} * (page - 1), {_PAGE}) txt from (select cast(doc_id as varchar) path, t, unnest(range(1, 1 + cast(greatest(1, ceil(length(t) / {_PAGE}.0)) as bigint))) page from (select doc_id, {_LATIN} t from documents) d) p"


@query(f"select path, cast(page as int) page, md5(txt) digest from ({_PAGES}) p")
def pdf_pages(spark, d):
    """The pages of all documents' PDF files."""
    return pdf.pages(_pdfs(spark, d)).select("path", "page", F.md5("text").alias("digest"))


@query(f"""select path, n pages, size <= 15000 is_full, md5(case when size <= 15000 then whole else concat(head, chr(10), chr(10), '[Cut: ', cast(least(n, 20) as varchar), ' of ', cast(n as varchar), ' pages.]') end) context from (
  select path, count(*) n, sum(length(m)) + 2 * (count(*) - 1) size, string_agg(m, concat(chr(10), chr(10)) order by page) whole, string_agg(m, concat(chr(10), chr(10)) order by page) filter (where page <= 20) head
  from (select path, page, concat('--- page ', cast(page as varchar), ' ---', chr(10), txt) m from ({_PAGES}) p) q group by path) r""")
def pdf_contexts(spark, d):
    """The context of each PDF file, whole or its first pages."""
    return pdf.contexts(pdf.pages(_pdfs(spark, d)), 15_000, 20).select("path", "pages", "is_full", F.md5("model_context").alias("context"))


@query(sql("select gene, sample, round(v, 4) v from matrix", "matrix"))
def matrix_scan(spark, d):
    """The matrix written as a wide table and scanned by its header."""
    wide = V.matrix(spark, d).groupBy("gene").pivot("sample", [f"S{i}" for i in range(1, 10)]).agg(F.first("v"))
    at = path(spark, "matrix")
    text.write_table(wide.select("gene", *[F.coalesce(F.col(f"S{i}").cast("double"), F.lit(-1.0)).alias(f"S{i}") for i in range(1, 10)]), at)
    rows = text.read_matrix(spark, at).unpivot(["gene"], [f"S{i}" for i in range(1, 10)], "sample", "v")
    return rows.where("v >= 0").withColumn("v", F.round("v", 4))


@query(sql('select j + 1 as "row", row_number() over (partition by j order by i) col, cast(a as double) "value" from counts', "counts"))
def grid_scan(spark, d):
    """Counts laid down as a headerless grid, a row a stratum, and scanned to cells."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"].cast("string")), "  ")
    rows = V.counts(spark, d).groupBy("j").agg(line.alias("line"))
    at = path(spark, "grid")
    rows.coalesce(1).sortWithinPartitions("j").select("line").write.text(at)
    return text.read_grid(spark, at).withColumn("col", F.col("col").cast("long"))


@query(sql("select gene, cast(cast(substr(gene, 2) as bigint) % 4 as integer) cluster from (select distinct gene from matrix) g", "matrix"))
def gene_cluster_scan(spark, d):
    rows = V.matrix(spark, d).select("gene").distinct().withColumn("cluster", (F.substring("gene", 2, 9).cast("long") % 4).cast("int"))
    at = path(spark, "clusters")
    text.write_table(rows, at)
    return text.read_gene_clusters(spark, at)


@query(sql("select chrom, concat(chrom, ' ', cast(id as varchar)) as \"value\", true in_order from site", "site"))
def gzip_or_plain(spark, d):
    """Gzip files read without regard to their names, told by their first bytes; in_order: line numbers follow the lines of a file."""
    rows = V.sites(spark, d).select("id", "chrom")
    at = path(spark, "gzip")
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").select(F.format_string("%s %s", "chrom", "id").alias("value")).write.option("compression", "gzip").text(at)
    got = text.maybe_gzip_lines(spark, at).withColumn("id", F.split("value", " ")[1].cast("long"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1  # a file's lines
    return got.select(F.split("value", " ")[0].alias("chrom"), "value", (order == F.col("line_no")).alias("in_order"))
