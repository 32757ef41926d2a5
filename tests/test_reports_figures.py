from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import contingency as C
from tessera.operators import features as G
from tessera.operators import figures as V
from tessera.operators import interpret as I
from tessera.operators import matrix as M
from tessera.operators import tree as R
from tessera.plans import counts, genomic, registry, reports, tables
from tessera.plans import views
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def test_annotation_report(spark):
    text = reports.annotation(genomic._annotated(spark, SF))
    assert text.count("\n---") == 6 and "intron" in text and "chr1 " in text, text
    assert reports.section("T", spark.range(60)).endswith("(more rows)")
    assert "n/a" in reports.section("T", spark.sql("select cast(null as int) x"))


def test_extraction_and_interpretation_reports(spark):
    exon = views.exons(spark, SF).cache()
    cds = views.cds(exon)
    utrs = G.utrs(exon, cds).cache()
    text = reports.extraction(exon.select("tx").distinct(), exon, cds, utrs.select("tx", "s", "e"))
    assert text.count("\n---") == 2 and "n_coding" in text
    features = views.features(exon)
    text = reports.interpretation(genomic._annotated(spark, SF), I.class_space(features, views.sites(spark, SF)), genomic._measured(spark, SF), utrs.where("cls = '3UTR'"), views.genes(exon))
    assert text.count("\n---") == 7 and "protein_coding" in text and "ratio" in text


def test_figures(spark):
    m = views.matrix(spark, SF).cache()
    log = M.log2p1(m)
    z = M.zscore(log)
    labels = m.select("gene").distinct().withColumn("cluster", F.abs(F.hash("gene")) % 2).withColumn("silhouette", F.lit(0.1))
    names = M.samples_of(m)
    assert V.qc_boxes(m).where("low > q25 or q25 > median or median > q75 or q75 > high").count() == 0
    assert V.amplitudes(log, labels).agg(F.sum("n")).first()[0] == labels.count()
    h = V.heatmap_order(z, labels, names)
    assert h.count() == m.count() and h.select("column").distinct().count() == len(names)
    s = M.signatures(log, {n: 1 + i % 2 for i, n in enumerate(names)}, 5)
    assert V.signature_heatmap(z, s, 2).select("cluster", "direction", "rank").distinct().count() == 8
    assert abs(V.mean_profile_overview(log, labels).agg(F.sum("share")).first()[0] - 1) < 1e-9
    t = views.counts(spark, SF)
    assert V.naive_against_structured(t).count() == len(C.compare(t)[1])
    assert V.qc_boxes(m).columns == ["sample", "low", "q25", "median", "q75", "high"]


def test_k_panels_and_null_histogram(spark):
    metrics = spark.createDataFrame([(2, 9.0, 0.3, 5.0, 0.9, 0.8), (3, 7.0, 0.5, 4.0, 0.7, 0.8), (4, 6.0, 0.1, None, 0.8, 0.2)], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, stability double")
    best = {r.panel: r.k for r in V.k_panels(metrics).where("best").collect()}
    assert best == {"silhouette": 3, "calinski_harabasz": 2, "davies_bouldin": 3, "stability": 2} and V.k_panels(metrics).count() == 15
    g = spark.createDataFrame([(float(x),) for x in [0, 0, 1, 2.5, 3.9, 4]], "g double")
    h = V.null_histogram(g, 2.0, 4).orderBy("bin").collect()
    assert [(r.bin, r.low, r.high, r.n, r.observed) for r in h] == [(0, 0.0, 1.0, 2, False), (1, 1.0, 2.0, 1, False), (2, 2.0, 3.0, 1, True), (3, 3.0, 4.0, 2, False)]
    assert V.null_histogram(g, 99.0, 4).where("observed").count() == 0
    assert [r.n for r in V.null_histogram(g.where("g = 0"), 0.0, 3).orderBy("bin").collect()] == [2, 0, 0]


def test_dendrogram_corners(spark):
    points = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [9.0])], "id string, x array<double>")
    rows = [tuple(r) for r in V.dendrogram(*R.linkage_table(points)).orderBy("step", "corner").select("step", "x", "y").collect()]
    assert [(s, x) for s, x, _ in rows] == [(0, 5.0), (0, 5.0), (0, 15.0), (0, 15.0), (1, 10.0), (1, 10.0), (1, 25.0), (1, 25.0)] or [(s, x) for s, x, _ in rows] == [(0, 15.0), (0, 15.0), (0, 25.0), (0, 25.0), (1, 5.0), (1, 5.0), (1, 20.0), (1, 20.0)]


def test_result_tables_and_their_reports(spark, tmp_path):
    t = tables.comparison(views.counts(spark, SF), 2_000)
    text = reports.comparison(t)
    assert t["per_column"].count() == 5 and t["combined"].count() == 10 and text.count("\n---") == 6
    split = C.significance_split(t["per_column"])
    assert sum(x.count() for x in split) == 5
    tables.write({"combined": t["combined"]}, str(tmp_path))
    back = spark.read.csv(str(tmp_path / "combined"), sep="\t", header=True)
    assert back.count() == 10 and back.columns == t["combined"].columns
    m = views.matrix(spark, SF).where("substr(gene, 2) < 60").cache()
    g = tables.genes(m, [2, 3], resamples=2, restarts=2, resample_restarts=1)
    assert g["k_metrics"].where("chosen").count() == 1 and g["gene_clusters"].count() == K.vectors(M.normalise(M.log2p1(M.gene_filter(m)))).count()
    assert "Profiles" in reports.genes(m, g) and "ward_ari" in reports.genes(m, g)
    clusters = g["gene_clusters"]
    assert clusters.where("silhouette is null").count() == 0 and {f"{p}{s}" for p in ("z_", "log2_") for s in M.samples_of(m)} < set(clusters.columns)
    one, z = clusters.orderBy("gene").first(), {(r.gene, r.sample): r.v for r in M.zscore(M.normalise(M.log2p1(M.gene_filter(m)))).collect()}
    assert all(abs(one[f"z_{s}"] - z[one.gene, s]) < 1e-9 for s in M.samples_of(m))
    s = tables.samples(m, 50, replicates=20)
    assert {r.sample for r in s["sample_clusters"].collect()} == set(M.samples_of(m)) and "Signatures" in reports.samples(s)


def test_deciles(spark):
    bins = spark.createDataFrame([(b, b + 1) for b in range(20)], "bin int, n long")
    assert tuple(I.deciles(bins).first()) == (210, 3, 39, 13.0)
    assert I.deciles(bins.withColumn("n", F.when(F.col("bin") < 2, 0).otherwise(F.col("n")))).first().ratio is None


def test_files(spark, tmp_path):
    (tmp_path / "b.CSV").write_bytes(b"a\xffb")
    (tmp_path / "a.md").write_bytes(b"x")
    assert [(r.path.rsplit("/", 1)[1], r.kind, r.length) for r in files.list_files(spark, str(tmp_path)).collect()] == [("a.md", "txt", 1), ("b.CSV", "csv", 3)]
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"x", "a�b"}


def test_registry_runs_at_the_smallest_size(spark):
    assert set(registry.ORACLE) <= set(registry.QUERIES) and len(registry.QUERIES) > 60
    for name in ("site_labels", "g_test", "median_norm", "text_context"):
        assert registry.QUERIES[name](spark, SF).count() > 0
    assert counts.QUERIES["cmh"](spark, SF).first().dof >= 1
