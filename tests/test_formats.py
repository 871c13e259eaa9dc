"""Text formats, the store, the facade and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from signalloom import api
from signalloom.functions import quantize
from signalloom.operators import variants
from signalloom.sources import sinks, store, text
from signalloom.streaming.fold import stream_event_counts, stream_knots


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def written(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_bed_lengths_and_aliases(spark, tmp_path):
    bed = text.read_bed(spark, written(tmp_path, "a.bed", "track name=x\n#c\n20\t10\t20\tr1\nchr21\t5\t6\tr2\n"))
    assert rows(bed, "ref", "start0", "end0", "name") == [("chr20", 10, 20, "r1"), ("chr21", 5, 6, "r2")]
    assert rows(text.read_lengths(spark, written(tmp_path, "l", "#x\nchr20\t63025520\n")), "ref", "length") == [("chr20", 63025520)]
    a = text.read_aliases(spark, written(tmp_path, "al", "chr20\t20\n"))
    assert rows(text.renamed(bed, a), "ref") == [("20",), ("chr21",)]


def test_three_columns(spark, tmp_path):
    p = written(tmp_path, "c.txt", "1\t5\t2\n1\t6\t2\n1\t8\t3\n")
    assert rows(text.read_signal(spark, p, scale=2), "ref", "start1", "end1", "cov") == [("chr1", 5, 7, 4.0), ("chr1", 8, 9, 6.0)]


def test_wig(spark, tmp_path):
    p = written(tmp_path, "c.wig", "track type=wiggle_0\nfixedStep chrom=chr1 start=10 step=5 span=2\n1\n2\n2\nvariableStep chrom=2 span=3\n7 1.5\n20 4\n")
    assert rows(text.read_signal(spark, p), "ref", "start1", "end1", "cov") == [("chr1", 10, 12, 1.0), ("chr1", 15, 17, 2.0), ("chr1", 20, 22, 2.0), ("chr2", 7, 10, 1.5), ("chr2", 20, 23, 4.0)]


VCF = "##x\n#CHROM\tPOS\n20\t60022\t.\tG\tA\t743.37\tPASS\tAC=1;DP=128;DB\tGT:AD:DP\t0/1:1,2:51\t1/1:0,3:9\n20\t60030\trs1\tG\tA\t.\tq10\t.\tGT\t1|1\n"


def test_vcf(spark, tmp_path):
    v = text.read_vcf(spark, written(tmp_path, "a.vcf", VCF))
    assert rows(v, "ref", "pos", "dp", "zygosity", "filter") == [("chr20", 60022, 128, "HET", "PASS"), ("chr20", 60030, None, "HOM", "q10")]
    spans = spark.createDataFrame([("chr20", 60000, 60025, 7)], "ref string, start1 int, end1 int, cov int")
    lines = [r["line"] for r in sinks.vcf_lines(variants.annotated(v, spans), "CV", "cov").orderBy("start1").collect()]
    assert lines == ["20\t60022\t.\tG\tA\t743.37\tPASS\tAC=1;DP=128;DB;CV=7\tGT:AD:DP\t0/1:1,2:51\t1/1:0,3:9", "20\t60030\trs1\tG\tA\t.\tq10\t.\tGT\t1|1"]


def test_gvcf(spark, tmp_path):
    p = tmp_path / "a.vcf.gz"
    with gzip.open(p, "wt") as f:
        f.write("#CHROM\n1\t10\t.\tA\t<X>\t.\t.\tEND=14\tGT:DP\t0/0:5\n1\t15\t.\tA\tC\t.\tPASS\tDP=5\tGT\t0/1\n1\t16\t.\tA\tC\t.\tPASS\tDP=9\tGT\t0/1\n")
    assert rows(text.read_signal(spark, str(p)), "ref", "start1", "end1", "cov") == [("chr1", 10, 16, 5.0), ("chr1", 16, 17, 9.0)]


SAM = "@HD\n" + "".join("\t".join(map(str, r)) + "\n" for r in [
    ("a", 0, "1", 10, 60, "5M", "*", 0, 0, "*", "*", "NM:i:1", "X0:i:2"), ("b", 16, "1", 12, 20, "2S2M3D2M1I1M", "*", 0, 0, "*", "*", "NM:i:4"),
    ("c", 1024, "1", 10, 60, "5M", "*", 0, 0, "*", "*"), ("d", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*"), ("e", 147, "1", 30, 9, "1M2N1M", "*", 0, 0, "*", "*"),
])


def test_sam(spark, tmp_path):
    p = written(tmp_path, "a.sam", SAM)
    assert rows(text.read_sam(spark, p), "qname", "strand", "fop_strand") == [("a", "+", "+"), ("b", "-", "-"), ("c", "+", "+"), ("e", "-", "+")]
    got = rows(text.read_signal(spark, p), "start1", "end1", "cov")
    assert got == [(10, 12, 1), (12, 14, 2), (14, 15, 1), (15, 17, 0), (17, 20, 1), (20, 30, 0), (30, 31, 1), (31, 33, 0), (33, 34, 1)]
    assert rows(text.read_signal(spark, p, read_filter="NM<2;FLAGS^^1024;STRAND=+", weight_by_x0=True), "start1", "end1", "cov") == [(10, 15, 0.5)]


def test_genes_and_matrix(spark, tmp_path):
    g = text.read_genes(spark, written(tmp_path, "g.tsv", "#bin\tname\tchrom\tstrand\texonStarts\texonEnds\tname2\n1\tN1\tchr1\t+\t10,20,\t15,30,\tG\n"))
    assert rows(g, "gene", "ref", "start0", "end0") == [("G", "chr1", 10, 15), ("G", "chr1", 20, 30)]
    m = text.read_matrix(spark, written(tmp_path, "m.tsv", "# win=10\nPos\ta\tb\n1:5\t3\t\n1:15\t4\t6\n"))
    assert rows(m.where("cov is not null"), "ref", "pos", "track", "cov") == [("chr1", 5, "a", 3.0), ("chr1", 15, "a", 4.0), ("chr1", 15, "b", 6.0)]
    assert [tuple(r) for r in sinks.wide(m, ["a", "b"]).orderBy("Pos").collect()] == [("chr1:15", 4.0, 6.0), ("chr1:5", 3.0, None)]


def test_written_lines(spark, tmp_path):
    r = spark.createDataFrame([("chr1", 5, 9), ("chr1", 20, 30)], "ref string, start1 int, end1 int")
    sinks.write_lines(sinks.bed_lines(r), str(tmp_path / "b"), "track name=x")
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "b").glob("part*")))
    assert text_ == "track name=x\nchr1\t4\t8\tregion1\nchr1\t19\t29\tregion2\n"
    w = sinks.wig_lines(r.withColumn("cov", F.lit(2.5)))
    assert [x["line"] for x in w.orderBy("start1").collect()][0] == "variableStep chrom=chr1 span=4\n5 3"


def test_store_prunes_and_the_facade_queries(spark, tmp_path):
    src = spark.createDataFrame([("chr1", 10, 20, 4), ("chr1", 20, 22, 9), ("chrX", 5, 8, 2)], "ref string, start1 int, end1 int, cov long")
    path = str(tmp_path / "s")
    api.compress(spark, src, path, "PERC", 0.2, block_size=2)
    s = api.load(spark, path, "median*8")
    assert s.scale == 2.0 and s.query("chr1", 12)["cov"] == 8.0 and s.query("chr1", 5)["cov"] is None
    assert rows(s.references(), "ref") == [("chr1",), ("chrX",)] and s.text("chr1", 12).startswith("~8.00")
    assert rows(api.load(spark, path).regions(3), "ref", "start1", "end1") == [("chr1", 10, 22)]
    plan = store.read_store(spark, path, "chr1", low=15)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ref" in plan and "GreaterThanOrEqual(pos,15)" in plan
    assert dict(rows(store.describe(spark, path), "key", "value"))["method"] == "PERC"


def test_streams(spark, tmp_path):
    points = [("a", p, c) for p, c in enumerate((2, 2, 3, 9, 9, 0, 5), 1)] + [("b", 4, 6)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(points, "ref string, pos int, cov int").coalesce(1).write.parquet(folder)
    got = stream_knots(spark.readStream.schema("ref string, pos int, cov int").parquet(folder), quantize.percent(0.2))
    q = got.writeStream.format("memory").queryName("knots").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("knots"), "ref", "pos", "c1", "c2") == [("a", 1, 0, 2), ("a", 3, 2, 3), ("a", 4, 3, 9), ("a", 6, 9, 0), ("a", 7, 0, 5), ("b", 4, 0, 6)]
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", 1).parquet("/root/testdata/sf0.001/events.parquet*")
    q = stream_event_counts(events, "event_type", "ts").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").count() > 0


def test_binary_alignments_are_refused(spark):
    with pytest.raises(ValueError):
        text.read_signal(spark, "x.bam")
