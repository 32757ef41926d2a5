import gzip
import zlib
from types import SimpleNamespace

import pytest

from tessera.operators import documents as D
from tessera.operators import features as G
from tessera.plans import files
from tessera.sources import bed, gtf, pdf, table, text

LINES = [
    "#comment",
    "c1\tx\texon\t5\t9\t.\t+\t.",
    'c1\tx\tgene\t1\t100\t.\t+\t.\tgene_id "G1"; gene_type "lnc";',
    'c1\tx\ttranscript\t1\t100\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; tag "a"; tag "b"; note "x;y";',
    'c1\tx\texon\t1\t20\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; exon_number 2;',
    'c1\tx\texon\t41\t100\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; exon_number 1;',
    'c1\tx\tCDS\t51\t60\t.\t-\t.\tgene_id "G1"; transcript_id "T1";',
    'c1\tx\tstop_codon\t48\t50\t.\t-\t.\tgene_id "G1"; transcript_id "T1";',
    'c1\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "T9";',
    'c1\tx\ttranscript\t1\t9\t.\t+\t.\ttranscript_id "T9";',
]


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("\n".join(LINES) + "\n")
    g = gtf.scan(spark, str(tmp_path / "a.gtf")).cache()
    assert g.count() == 8
    gene = gtf.genes(g).first()
    assert (gene.gene_name, gene.gene_type, gene.s, gene.e) == ("G1", "lnc", 0, 100)
    t = {r.transcript_id: r for r in gtf.transcripts(g).collect()}
    assert (t["T9"].gene_id, t["T9"].transcript_name, t["T1"].gene_name) == ("NA", "T9", "G1")
    exon, cds = gtf.children(g, "exon"), gtf.children(g, "CDS")
    assert exon.count() == 2  # the exon before its transcript is an orphan
    assert {r.feature: r.n for r in gtf.orphans(g).collect()} == {"exon": 1}
    assert [(r.s, r.e, r.intron) for r in G.introns(exon).collect()] == [(20, 40, 1)]
    merged = G.with_stop_codons(cds, gtf.children(g, "stop_codon"))
    assert [(r.s, r.e) for r in merged.collect()] == [(47, 60)]
    stats = G.transcript_stats(gtf.transcripts(g).withColumnRenamed("transcript_id", "tx"), exon, cds).first()
    assert tuple(stats) == (2, 1, 1, 0, 0)
    out = G.utrs(exon, cds).selectExpr("'G1' gene_id", "'N' gene_name", "'c1' chrom", "s", "e", "strand", "tx transcript_id", "'n' transcript_name", "'t' transcript_type", "blk block_number", "cls").where("cls = '3UTR'")
    bed.write_bed(out, str(tmp_path / "bed"), "three_prime_utrs", header=True)
    back = bed.read_features(spark, str(tmp_path / "bed"), "three_prime_utrs").orderBy("s").collect()
    assert [(r.s, r.e, r.name, r.gene_id) for r in back] == [(0, 20, "N|T1|3UTR2", "G1"), (40, 50, "N|T1|3UTR1", "G1")]


def test_regions_and_detailed_table(spark, tmp_path):
    (tmp_path / "r.bed").write_text("track x\n\n#c\nc1\t5\t5\t-\nc1\t7\t9\nc2\t1\t4\tn\t0\t+\nshort\t1\n")
    rows = bed.read_regions(spark, str(tmp_path / "r.bed")).orderBy("id").collect()
    assert [(r.id, r.chrom, r.strand, r.s, r.e, r.zero) for r in rows] == [(0, "c1", "-", 4, 5, True), (1, "c1", ".", 7, 9, False), (2, "c2", "+", 1, 4, False)]
    assert bed.read_positions(spark, str(tmp_path / "r.bed")).count() == 2
    from tessera.operators.annotate import annotate

    feats = spark.createDataFrame([(0, "c1", "-", 0, 9, "g", "t", 1)], "cl int, chrom string, strand string, s long, e long, gene string, rep string, n long")
    genes = spark.createDataFrame([("c1", "-", 0, 9, "g")], "chrom string, strand string, s long, e long, gene_name string")
    a = annotate(bed.read_regions(spark, str(tmp_path / "r.bed")), feats, genes)
    bed.write_annotated(a, str(tmp_path / "out"), single=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["c1\t5\t5\t-\texon", "c1\t7\t9\texon", "c2\t1\t4\tn\t0\t+\tUN"]
    d = bed.detailed(a)
    assert tuple(d.columns) == bed.DETAILED
    bed.write_detailed(a, str(tmp_path / "d"))
    back = bed.read_detailed(spark, str(tmp_path / "d"))
    assert tuple(back.columns) == bed.DETAILED and [(r.chrom, r.start, r.feature_type) for r in back.collect()] == [("c1", "5", "exon"), ("c1", "7", "exon"), ("c2", "1", "UN")]


def test_matrix_and_gzip(spark, tmp_path):
    (tmp_path / "m.txt").write_text("gene\tS1\tS2\nA\t1\t2.5\nB\t0\t4\n")
    m = text.read_matrix(spark, str(tmp_path / "m.txt"))
    from tessera.operators.matrix import from_wide

    assert {(r.gene, r.sample): r.v for r in from_wide(m).collect()} == {("A", "S1"): 1, ("A", "S2"): 2.5, ("B", "S1"): 0, ("B", "S2"): 4}
    (tmp_path / "bad.txt").write_text("gene\tS1\nA\t1\t2\n")
    with pytest.raises(Exception, match="has not 2 fields"):
        text.read_matrix(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "misnamed").write_bytes(gzip.compress(b"one\ntwo\n"))
    (tmp_path / "plain").write_bytes(b"three\n")
    got = text.maybe_gzip_lines(spark, str(tmp_path / "misnamed")).unionAll(text.maybe_gzip_lines(spark, str(tmp_path / "plain")))
    assert [r.value for r in got.collect()] == ["one", "two", "three"]
    (tmp_path / "g.tsv").write_text("gene\tcluster\nA\t2\n")
    assert tuple(text.read_gene_clusters(spark, str(tmp_path / "g.tsv")).first()) == ("A", 2)


class Fake:
    def __init__(self, fail=None):
        self.calls, self.fail, self.messages = [], fail, self

    def create(self, **k):
        self.calls.append(k)
        if self.fail:
            raise self.fail
        return SimpleNamespace(content=[SimpleNamespace(type="thinking"), SimpleNamespace(type="text", text="yes"), SimpleNamespace(type="text", text="!")], usage=SimpleNamespace(input_tokens=3, output_tokens=2))


def test_budget_edges(spark):
    for n in (14_999, 15_000, 15_001):
        doc = D.load(spark, "a.md", b"x" * n)
        assert doc.is_full == (n <= 15_000) and doc.metadata["characters"] == n
        row = D.text_context(spark.createDataFrame([("x" * n,)], "text string")).first()
        assert (row.model_context, row.is_full, row.preview) == (doc.model_context, doc.is_full, doc.preview)
    assert D.load(spark, "b.txt", b"a\xffb").model_context == "a�b"
    assert D.text_context(spark.createDataFrame([(None,)], "text string")).first().model_context == ""


def test_tables(spark):
    raw = b"id\tname\tv\n" + b"\n".join(b"%d\tn%d\t%s" % (i, i % 3, b"NA" if i == 5 else b"1.5") for i in range(2000))
    doc = D.load(spark, "t.csv", raw)  # tabs in spite of the name
    assert doc.kind == "csv" and doc.metadata["rows"] == 2000 and not doc.is_full
    assert "count 1999" in doc.model_context and "3 distinct values" in doc.model_context
    assert D.load(spark, "r.csv", b"a,b\n1,2\n3,4,5\n").metadata["parse_error"]
    assert D.load(spark, "e.csv", b"").metadata["parse_error"]
    full = D.load(spark, "s.tsv", b"a\tb\n1\tx\n")
    assert full.is_full and full.metadata["column_names"] == ["a", "b"]
    assert D.pdf_document("p.pdf", ["x" * 20_000] + ["y"] * 30).model_context.count("--- page") == 20
    with pytest.raises(ValueError, match="page tree"):
        pdf._own_pages(b"%PDF")


def test_typed_tables(spark, tmp_path):
    raw = 'id,score,ok,day,mixed,big,"na""me\nx",empty,id\n1,2.5,True,2020-02-29,1,9223372036854775807,"a\n""b"", c",NA,7\n\n-2,1e3,FALSE,2021-01-01,x,9223372036854775808, d ,,8\n3,NaN,,NA,.5,1,null,null\n'
    t = table.of_text(spark, raw)
    assert t.dtypes == [("id", "bigint"), ("score", "double"), ("ok", "boolean"), ("day", "date"), ("mixed", "string"), ("big", "double"), ('na"me\nx', "string"), ("empty", "string"), ("id_8", "bigint")]
    rows = t.orderBy("id").collect()
    assert [r[1] for r in rows] == [1000.0, 2.5, None] and [r[2] for r in rows] == [False, True, None] and [r[8] for r in rows] == [8, 7, None]
    assert [r[6] for r in rows] == [" d ", 'a\n"b", c', None] and {r[7] for r in rows} == {None} and str(rows[1][3]) == "2020-02-29"
    assert table.of_text(spark, "a;b\n1;2\n").columns == ["a", "b"] and table.of_text(spark, "a,b\n").count() == 0
    with pytest.raises(Exception, match="more than 2 fields"):
        table.of_text(spark, "a,b\n1,2\n1,2,3\n").collect()
    for bad in ("", " \n"):
        with pytest.raises(ValueError, match="no columns"):
            table.of_text(spark, bad)
    assert table.typed(spark.createDataFrame([("1d",), ("2",)], "x string")).dtypes == [("x", "string")]


def test_pdf_pages_and_contexts(spark, tmp_path):
    pages = ["First (page) \\ of é", "", "x" * 40]
    raw = files._pdf(pages)
    assert pdf._own_pages(raw) == pages
    lines = b"BT (one) Tj 0 -12 Td [(tw) -20 (o)] TJ T* <7468726565> Tj (\\101\\n) ' ET"
    body = b"%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 5 0 R>> endobj\n9 0 obj <</Length 8 0 R>> stream\n" + lines + b"\nendstream endobj\n"
    inner = b"5 0 6 40 <</Type /Pages /Kids [6 0 R 6 0 R] >>     <</Type /Page /Contents [9 0 R]>>"
    first = inner.index(b"<<")
    inner = b"5 0 6 %d " % (inner.rindex(b"<<") - first) + inner[inner.index(b"<<"):]
    packed = zlib.compress(inner)
    body += b"7 0 obj <</Type /ObjStm /N 2 /First %d /Filter /FlateDecode>> stream\n" % inner.index(b"<<") + packed + b"\nendstream endobj\n"
    assert pdf._own_pages(body) == ["one\ntwo\nthree\nA"] * 2
    (tmp_path / "a.PDF").write_bytes(raw)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.txt").write_bytes(raw)
    rows = {(r.path.rsplit("/", 1)[1], r.page): r.text for r in pdf.read_pages(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in rows.items() if k[0] == "a.PDF"} == {("a.PDF", i + 1): p for i, p in enumerate(pages)} and "page tree" in rows["b.pdf", None] and len(rows) == 4
    texts = {"small": ["a", "b"], "large": ["y" * 900] * 30}
    df = spark.createDataFrame([(k, i + 1, t) for k, ts in texts.items() for i, t in enumerate(ts)] + [("bad", None, "error")], "path string, page int, text string")
    got = {r.path: r for r in pdf.contexts(df, 15_000, 20).collect()}
    for k, ts in texts.items():
        doc = D.pdf_document(k, ts)
        assert (got[k].model_context, got[k].is_full, got[k].pages) == (doc.model_context, doc.is_full, len(ts))
    assert len(got) == 2
    assert D.load(spark, "p.PDF", raw).metadata["pages"] == 3


def test_gzip_lines_are_streamed_in_order(spark, tmp_path):
    lines = [f"line {i} é" for i in range(25_000)]
    (tmp_path / "big").write_bytes(gzip.compress("\r\n".join(lines).encode()))
    got = text.maybe_gzip_lines(spark, str(tmp_path / "big")).orderBy("line_no").collect()
    assert [r.value for r in got] == lines and [r.line_no for r in got] == list(range(25_000))


def test_line_ids_follow_files_whatever_their_sizes(spark, tmp_path):
    for n, name in enumerate(("a b", "b%20c+d", "ü")):  # the last files are the largest, which Spark reads first
        (tmp_path / name).write_text("".join(f"{n}:{i}\n" for i in range(10 ** (n + 1))))
    rows = bed.dense(text.indexed(spark, str(tmp_path)), "row_id").orderBy("row_id").collect()
    assert [r.value for r in rows] == [f"{n}:{i}" for n in range(3) for i in range(10 ** (n + 1))] and [r.row_id for r in rows] == list(range(1_110))


def test_small_blocks_of_a_file_keep_their_lines_apart(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("gene\tS1\n" + "".join(f"G{i}\t{i}\n" for i in range(60_000)))  # 0.8 MB
    for cost in ("65536", "100000"):
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        try:
            rows = text.read_matrix(spark, str(tmp_path / "m.tsv"))
            got = bed.dense(rows, "row_id").collect()
            assert rows.rdd.getNumPartitions() > 4
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((r.row_id, r.gene, r.S1) for r in got) == [(i, f"G{i}", float(i)) for i in range(60_000)]


def test_detailed_table_keeps_lines_like_its_header(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a\tb\n1\t2\na\tb\nshort\n3\t\n")
    assert [tuple(r) for r in bed.read_detailed(spark, str(tmp_path / "d.tsv")).collect()] == [("1", "2"), ("a", "b"), ("3", "")]


def test_conversation(spark):
    client = Fake()
    s = D.Session(spark, client)
    s.open("a.txt", b"text")
    turn = s.question("q?", baseline=True)
    assert turn["answer"] == "yes!" and turn["baseline"] == "yes!" and turn["usage"]["input_tokens"] == 3 and turn["usage"]["cache_read_input_tokens"] == 0
    assert [m["role"] for m in s.history] == ["user", "assistant"] and "text" in client.calls[0]["system"][0]["text"]
    assert client.calls[1]["messages"] == [{"role": "user", "content": "q?"}]
    s.open("a.txt", b"text")
    assert s.history
    s.open("a.txt", b"other bytes")
    assert not s.history and not s.turns
    s.client = Fake(type("RateLimitError", (Exception,), {})("slow"))
    assert "later" in s.question("again")["error"] and s.history == []
    assert D.example_questions("Differential_Expression_results.csv") and D.example_questions("x") == ()
