"""Fold cuts, pieces, starts, options, order of references, and the facade."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom import api
from signalloom.functions import quantize, scalar
from signalloom.operators import codec, filters, regions, sampling, signal, stats, variants, windows
from signalloom.sources import config, reports, sinks, store, text


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def made(spark, values, ref="chr1"):
    return spark.createDataFrame([(ref, i + 1, i + 2, v) for i, v in enumerate(values)], "ref string, start1 long, end1 long, cov long")


def folded(values, lo_hi):
    out, lo, hi, last = [], 0, 0, 0
    for p, c in enumerate(values, 1):
        if not lo <= c <= hi:
            out.append((p, last, c))
            lo, hi = lo_hi(c)
        last = c
    return sorted([*out, (len(values) + 1, values[-1], 0)])


QUANTIZERS = [quantize.percent(p) for p in (0, 0.05, 0.2, 0.5, 0.7, 1.0)] + [quantize.grid(1), quantize.grid(5), quantize.grid(2.5), quantize.log2()]


@pytest.mark.parametrize("k", range(len(QUANTIZERS)))
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_in_segments_is_the_serial_fold(spark, k, seed):
    q, rng = QUANTIZERS[k], random.Random(seed)
    values, v = [], 20
    for _ in range(400):
        v = rng.choice((v, v + 1, v - 1, v + rng.randint(-4, 4), rng.randint(0, 60), 0 if seed else v))
        v = max(v, 0 if seed < 2 else 1)
        values.append(v)
    top = max(values) + 1
    bounds = {r["c"]: (r["lo"], r["hi"]) for r in spark.range(top).select(F.col("id").alias("c"), q.lower(F.col("id")).alias("lo"), q.upper(F.col("id")).alias("hi")).collect()}
    got = rows(codec.lossy_knots(made(spark, values), q, tile=64), "pos", "c1", "c2")
    assert got == folded(values, bounds.__getitem__)


def test_a_signal_without_zeros_folds_in_many_segments(spark):
    rng = random.Random(1)
    spans = made(spark, [rng.choice((30, 31, 32, 60, 90)) for _ in range(2000)])
    for q in (quantize.percent(0.2), quantize.percent(0.05), quantize.grid(5), quantize.log2()):
        assert codec.segments(spans, q, tile=128).select("_seg").distinct().count() > 200


def test_runs_cross_tiles(spark):
    df = spark.createDataFrame([("a", p, p // 37) for p in range(0, 1000, 3)] + [("b", 5, 0)], "ref string, pos long, v long")
    got = windows.with_runs(df, ["ref"], "pos", lambda a, b: a["v"] != b["v"], before={"p": "pos"}, after={"n": "pos"}, tile=50).orderBy("ref", "pos").collect()
    seen, run, last = {}, 0, None
    for r in (r for r in got if r["ref"] == "a"):
        run += last is not None and r["v"] != last
        last = r["v"]
        assert r["_run"] == run and r["p"] == (r["pos"] - 3 if r["pos"] else None) and r["n"] == (r["pos"] + 3 if r["pos"] < 999 else None)
    assert [(r["_run"], r["p"], r["n"]) for r in got if r["ref"] == "b"] == [(0, None, None)] and seen == {}


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(200)], "at long, m long")
    got, total = windows.running_total(df, "at", "m", "hi")
    assert total == 400 and [r["hi"] for r in got.orderBy("at").collect()] == [sum(k % 5 for k in range(i + 1)) for i in range(200)]
    assert windows.running_total(df.limit(0), "at", "m", "hi")[1] == 0


@pytest.mark.parametrize("scale", [1.0, 0.37, 2.1])
def test_regions_of_pieces_are_those_of_a_scan(spark, scale):
    rng = random.Random(7)
    knots, pos = [], 1
    for _ in range(120):
        knots.append(("chr1", pos, rng.randint(0, 40), rng.randint(0, 40)))
        pos += rng.choice((1, 2, 3, 7, 30, 200))
    df = spark.createDataFrame(knots, "ref string, pos long, c1 long, c2 long")
    s = api.Signal(spark, df, quantize.percent(0), scale)
    for low, high in ((5, 20), (0, 0), (30, 30), (0, 1 << 30), (17, 18)):
        assert rows(s.regions(low, high), "ref", "start1", "end1") == rows(regions.regions_by_coverage(signal.dense_to_spans(s.scan()), low, high), "ref", "start1", "end1")
    flat = {(r, p): c for r, a, z, c in rows(s.spans(), "ref", "start1", "end1", "cov") for p in range(a, z)}
    assert flat == {(r, p): c for r, p, c in rows(s.scan(), "ref", "pos", "cov")}


def test_facade(spark, tmp_path):
    src = spark.createDataFrame([("chr1", 10, 20, 4), ("chr1", 20, 22, 9), ("chrX", 5, 8, 300)], "ref string, start1 int, end1 int, cov long")
    api.compress(spark, src, str(tmp_path / "s"), "PERC", 0.0, block_size=2)
    s = api.load(spark, str(tmp_path / "s"))
    assert list(s.bytes("chrX")) == [300 & 255] * 3 and rows(s.after("chr1", 19), "pos", "cov") == [(20, 9.0), (21, 9.0)]
    assert rows(s.at("chrX").references(), "ref") == [("chrX",)] and rows(s.at(skip=["chrX"]).references(), "ref") == [("chr1",)]
    assert s.text("chr1", 99) is None and s.text("chr1", 12) == "4.00"
    v = spark.createDataFrame([("chr1", 12, 50), ("chr1", 12, 40), ("chr1", 20, 7), ("chr1", 99, 1), ("chr1", 13, None)], "ref string, pos int, dp int")
    assert rows(s.spliced(v).knots, "ref", "pos", "c1", "c2") == [("chr1", 10, 0, 4), ("chr1", 12, 4, 50), ("chr1", 20, 50, 7), ("chr1", 22, 9, 0), ("chrX", 5, 0, 300), ("chrX", 8, 300, 0)]
    assert s.spliced(v).query("chr1", 12)["cov"] == 50.0
    scaled = api.load(spark, str(tmp_path / "s"), 2.0).query("chr1", 12)
    assert (scaled["cov"], scaled["raw"]) == (8.0, 4.0)
    assert store.block_of(spark, str(tmp_path / "s"), "chr1", 21) == 0 and store.block_of(spark, str(tmp_path / "s"), "chr1", 9) is None and store.block_of(spark, str(tmp_path / "s"), "chr1", 23) is None
    assert rows(store.load_block(spark, str(tmp_path / "s"), "chr1", 0), "pos") == [(10,), (20,), (22,)]


def test_starts(spark):
    r = spark.createDataFrame([("chr1", 10, 20), ("chrX", 5, 6), ("chr1", 9, 9)], "ref string, start0 int, end0 int")
    drawn = {sampling.random_start(r, seed) for seed in range(30)}
    assert len(drawn) > 5 and all((ref == "chr1" and 11 <= pos <= 20) or (ref, pos) == ("chrX", 6) for ref, pos in drawn)
    assert sampling.random_start(r, 3) == sampling.random_start(r.repartition(3), 3) and sampling.checked_start(r, "chr1", 20) == ("chr1", 20)
    for bad in (("chr1", 10), ("chr1", 21), ("chr2", 12)):
        with pytest.raises(ValueError):
            sampling.checked_start(r, *bad)
    with pytest.raises(ValueError):
        sampling.random_start(r.limit(0), 1)


def test_order_of_references_in_files(spark, tmp_path):
    lines = spark.createDataFrame([(f"chr{r}", p, f"{r}:{p}") for r in ("10", "2", "X", "M", "Y", "Un_1") for p in (9, 100)], "ref string, start1 int, line string")
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part*"))).split()
    sinks.write_lines(lines, str(tmp_path / "a"), "head", "tail")
    assert read("a") == ["head", *[f"{r}:{p}" for r in ("2", "10", "X", "Y", "M", "Un_1") for p in (9, 100)], "tail"]
    sinks.write_lines(lines, str(tmp_path / "b"), references=["chrX", "chr10"])
    assert read("b")[:4] == ["X:9", "X:100", "10:9", "10:100"] and read("b")[4] == "2:9"
    assert [r["line"] for r in reports.sorted_lines(lines).collect()][:3] == ["2:9", "2:100", "10:9"]


def test_options(spark, tmp_path):
    (tmp_path / "o").write_text("# build\nmethod = GRID\nparameter: 5\nweight_by_x0=true\n\n! end\n")
    assert config.read_options(spark, str(tmp_path / "o")) == {"method": "GRID", "parameter": 5.0, "weight_by_x0": True}
    spark.conf.set("signalloom.block_size", "77")
    try:
        assert config.read_options(spark) == {"block_size": 77}
    finally:
        spark.conf.unset("signalloom.block_size")
    (tmp_path / "p").write_text("colour = red\n")
    with pytest.raises(ValueError):
        config.read_options(spark, str(tmp_path / "p"))


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalar.pow2(F.lit(62))) == 1 << 62 and get(scalar.pow2(F.lit(0))) == 1
    for bad in (-1, 63):
        with pytest.raises(Exception, match="exponent"):
            get(scalar.pow2(F.lit(bad)))
    assert [get(scalar.log2_floored(F.lit(x).cast("long"))) for x in (-3, 0, 1, 7, 8, (1 << 53) - 1)] == [0, 0, 0, 2, 3, 52]
    assert [get(scalar.log2_rounded(F.lit(x))) for x in (0, 1, 5, 6)] == [0, 0, 2, 3]
    assert get(scalar.formatted(F.lit(None).cast("double"), 3)) == "n/a" and get(scalar.formatted(F.lit(2.345), 1)) == "2.3"
    drawn = spark.range(20_000).select(scalar.lognormal(F.randn(5), 40.0, 10.0).alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(drawn["m"] - 39.5) < 0.5 and abs(drawn["s"] - 10) < 0.7
    df = spark.createDataFrame([("chr1",), ("chrX",), ("chrY",)], "ref string")
    assert rows(filters.on_references(df, ["1", "chrX"]), "ref") == [("chr1",), ("chrX",)] and rows(filters.on_references(df, skip=["Y"]), "ref") == [("chr1",), ("chrX",)]


def test_midmean_of_no_reads(spark):
    assert stats.midmean_gap(spark.createDataFrame([], "ref string, start1 int")).first()["mean_gap"] is None


def test_written_reports(spark, tmp_path):
    spans = spark.createDataFrame([("a", "chr1", 1, 11, 4), ("b", "chr1", 6, 21, 9)], "track string, ref string, start1 int, end1 int, cov long")
    scope = spark.createDataFrame([("chr1", 0, 10, "s")], "ref string, start0 int, end0 int, name string")
    reports.write_min_covered(spans, "track", {"a": 2, "b": 3}, str(tmp_path / "m"), {"x": scope}, wig=True)
    names = sorted(p.name for p in (tmp_path / "m").iterdir())
    assert names == ["Coverage.x.tsv", "Intersect.minCov-2-3.bed", "Intersect.minCov-2-3.wig", "a.minCov2.bed", "b.minCov3.bed"]
    assert rows(text.read_bed(spark, str(tmp_path / "m/Intersect.minCov-2-3.bed")), "start0", "end0", "name") == [(5, 10, "int1")]
    assert rows(text.read_signal(spark, str(tmp_path / "m/Intersect.minCov-2-3.wig")), "start1", "end1", "cov") == [(1, 6, 0.0), (6, 11, 1.0), (11, 21, 0.0)]
    assert rows(spark.read.text(str(tmp_path / "m/Coverage.x.tsv")), "value") == [("chr1\t0\t10\ts\t5\t10\t0.5000",)]
    with pytest.raises(ValueError):
        reports.write_sample(spans, str(tmp_path / "x"), "tdf")
    assert variants.spliced(spark.createDataFrame([], "ref string, pos long, c1 long, c2 long"), spark.createDataFrame([], "ref string, pos int, dp int")).count() == 0
