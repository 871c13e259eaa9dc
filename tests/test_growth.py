"""Work that must not grow faster than its input: candidates of range joins, sort keys, shuffles."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from signalloom.functions import quantize
from signalloom.operators import codec, features, lookup, rangejoin, regions, variants, windows
from signalloom.plans import registry
from signalloom.sources import reports, sinks, text

from .oracle import TABLES, assert_same


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def steps(spark, n=3000, ref="chr1"):
    """n spans of one position each, in one bin."""
    return spark.range(n).select(F.lit(ref).alias("ref"), F.col("id").cast("int").alias("start1"), (F.col("id") + 1).cast("int").alias("end1"), (F.col("id") % 7).alias("cov"))


def intervals(n, ends, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lo = rng.randrange(-50, ends)
        out.append((i, rng.choice(["a", "b"]), lo, lo + rng.choice([0, 1, 3, 10, 65, 130, 400])))
    return out


@pytest.mark.parametrize("width", [64, 100, 4096])
def test_short_and_long_intervals_meet_once(spark, width):
    xs, ys = intervals(80, 700, 1), intervals(90, 700, 2)
    a = spark.createDataFrame(xs, "i int, ref string, start1 int, end1 int")
    b = spark.createDataFrame(ys, "j int, ref string, lo int, hi int")
    got = sorted(tuple(r) for r in rangejoin.overlaps(a, b, width=width).select("i", "j", "overlap").collect())
    assert got == sorted((i, j, min(h, z) - max(s, y)) for i, r, s, h in xs for j, q, y, z in ys if r == q and s < z and y < h and s < h and y < z)
    points = spark.createDataFrame([(n, "a" if n % 2 else "b", n % 211 if n % 9 else None) for n in range(600)], "n int, ref string, pos int")
    want = sorted((n, i) for n, r, p in points.collect() if p is not None for i, q, s, h in xs if r == q and s <= p < h)
    for unique in (False, True):
        mine = points.select("ref", "pos").distinct() if unique else points
        hit = rangejoin.points_in_spans(mine, a, width=width, unique=unique)
        assert sorted(tuple(r) for r in hit.select("pos", "i").distinct().collect()) == sorted({(n % 211, i) for n, i in want})
    assert sorted(tuple(r) for r in rangejoin.points_in_spans(points, a, width=width).select("n", "i").collect()) == want
    found = {n for n, _ in want}
    assert {r["n"] for r in rangejoin.points_in_spans(points, a, how="left_semi", width=width).collect()} == found
    assert {r["n"] for r in rangejoin.points_in_spans(points, a, how="left_anti", width=width).collect()} == set(range(600)) - found
    assert rangejoin.points_in_spans(points, a, how="left", width=width).count() == len(want) + 600 - len(found)


def test_intervals_of_a_bin_are_compared_with_near_ones_only(spark):
    f = spark.range(2000).select(F.lit("chr1").alias("ref"), F.col("id").cast("int").alias("lo"), (F.col("id") + 20).cast("int").alias("hi"))
    x = rangejoin._placed(steps(spark), "start1", "end1", rangejoin.BIN, 2, 1, "_bin").groupBy("_bin").agg(F.count("*").alias("n"))
    y = rangejoin._placed(f, "lo", "hi", rangejoin.BIN, 1, 2, "_bin").groupBy("_bin").agg(F.count("*").alias("m"))
    pairs = x.join(y, "_bin").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert pairs < 8 * 2000 * 20  # 2000 features meet 20 spans each; a bin's pairs are 6,000,000


def looked_up(df):
    """Whether rows are made distinct before they are exploded to bins: its plan has an aggregate below the Generate."""
    text = plan(df, "optimizedPlan")
    return "explode" in text and any("Aggregate" in part.split("Relation")[0].split("Range (")[0] for part in text.split("Generate explode")[1:])


def test_features_on_the_same_bases_share_their_sums(spark):
    f = spark.range(60).select(F.col("id").alias("feature_id"), (F.col("id") % 2).alias("gene"), F.lit("chr1").alias("ref"), F.lit(9).alias("start0"), (F.col("id") % 3 + 10).cast("int").alias("end0"))
    means = features.coverage_per_feature(f, steps(spark, 100))
    assert looked_up(means)
    want = {n: sum(p % 7 for p in range(10, n % 3 + 11)) / (n % 3 + 1) for n in range(60)}
    assert {r["feature_id"]: r["mean_cov"] for r in means.collect()} == pytest.approx(want)
    genes = features.coverage_per_gene(f, steps(spark, 100))
    assert looked_up(genes)
    for r in genes.collect():
        mine = [n for n in range(60) if n % 2 == r["gene"]]
        assert r["bases"] == sum(n % 3 + 1 for n in mine)
        assert r["mean_cov"] == pytest.approx(sum(p % 7 for n in mine for p in range(10, n % 3 + 11)) / r["bases"])
    scope = f.select("ref", "start0", "end0", F.lit("same").alias("name"))
    got = regions.scope_overlap(scope.where("end0 = 10"), spark.createDataFrame([("chr1", 1, 50)], "ref string, start1 int, end1 int"))
    assert {(r["covered"], r["share"]) for r in got.collect()} == {(1, 1.0)}


def test_long_nested_features_meet_spans_at_their_ends_only(spark, monkeypatch):
    met = []

    def counted(*args, **more):
        out = rangejoin.overlaps(*args, **more)
        met.append(out.count())
        return out

    monkeypatch.setattr(features, "overlaps", counted)
    f = spark.range(200).select(F.col("id").alias("feature_id"), F.lit("chr1").alias("ref"), F.col("id").cast("int").alias("start0"), (F.col("id") + 2000).cast("int").alias("end0"))
    got = {r["feature_id"]: r["mean_cov"] for r in features.coverage_per_feature(f, steps(spark), width=64).collect()}
    assert got == pytest.approx({n: sum(p % 7 for p in range(n + 1, n + 2001)) / 2000 for n in range(200)})
    assert sum(met) < 200 * (2 * 64 + 2000 // 64)  # 400,000 pairs of a feature and a span


@pytest.mark.parametrize("name", ["feature_hist", "coverage_per_gene"])
def test_pairs_of_a_query_do_not_grow_with_repeated_tables(spark, monkeypatch, tmp_path, name):
    """Copies with shifted keys have the same days, and so the same bases: each is met once, whatever the number of copies."""
    source, met = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), []
    for t in TABLES:
        os.symlink(f"{source}/{t}.parquet", tmp_path / f"{t}.parquet")
    for t, key in (("lineitem", "l_orderkey"), ("part", "p_partkey")):
        os.unlink(tmp_path / f"{t}.parquet")
        # starts of features are keys modulo 2400
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} + 240000 * n AS {key}) FROM '{source}/{t}.parquet', range(5) r(n)) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")

    def counted(*args, **more):
        out = rangejoin.overlaps(*args, **more)
        met[-1] += out.count()
        return out

    monkeypatch.setattr(features, "overlaps", counted)
    for sf in (source, str(tmp_path)):
        met.append(0)
        assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)
    assert met[1] == met[0] > 0


@pytest.mark.parametrize("width", [7, 64])
def test_features_of_all_lengths_by_track(spark, width):
    rng = random.Random(width)
    spans = []
    for ref in ("a", "b", None):
        for track in ("t", "u", None):
            at = rng.randrange(-40, 30)
            while at < 400:
                end = at + rng.choice([0, 1, 2, 5, 70, 130])
                spans.append((ref, track, at, end, rng.choice([0, 1, 3, None, 9])))
                at = end + rng.choice([0, 0, 1, 90])
    rows = [(n, rng.choice("ab"), at, at + rng.choice([-5, 0, 1, width - 1, width, width + 1, 2 * width, 90, 350, 800])) for n, at in enumerate(rng.choices(range(-90, 450), k=120))] + [(900, None, 5, 300), (901, "a", None, 9), (902, "a", 9, None)]
    f = spark.createDataFrame(rows, "feature_id int, ref string, start0 int, end0 int")
    s = spark.createDataFrame(spans, "ref string, track string, start1 int, end1 int, cov long")
    want, bases = {}, {}
    for n, ref, a, z in rows:
        for q, track, lo, hi, cov in spans:
            if None not in (a, z, ref) and ref == q and max(a + 1, lo) < min(z + 1, hi):
                size = min(z + 1, hi) - max(a + 1, lo)
                mine, touched = want.get((n, track), (0, False))
                want[n, track] = (mine + (cov or 0) * size, touched or cov is not None)
                bases[n] = bases.get(n, 0) + (size if (cov or 0) > 0 else 0)
    size = {n: z - a for n, _, a, z in rows if None not in (a, z)}
    got = {(r["feature_id"], r["track"]): r["mean_cov"] for r in features.coverage_per_feature(f, s, ("track",), width=width).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(t / size[k[0]]) if known else None) for k, (t, known) in want.items())
    genes = f.where("end0 > start0 and ref is not null").withColumnRenamed("feature_id", "gene")
    for r in features.coverage_per_gene(genes, s.drop("track"), width=width).collect():
        n = r["gene"]
        assert r["bases"] == size[n]
        assert r["mean_cov"] == pytest.approx(sum(t for (m, _), (t, _) in want.items() if m == n) / size[n])
        assert r["uncovered"] == pytest.approx(1 - bases.get(n, 0) / size[n])


def test_points_that_share_a_position_are_looked_up_once(spark):
    v = spark.createDataFrame([(i, "chr1" if i % 5 else None, 7 if i % 3 else None) for i in range(30)], "id int, ref string, pos int")
    got = variants.annotated(v, steps(spark, 50))
    assert looked_up(got)
    assert {r["id"]: r["cov"] for r in got.collect()} == {i: 0 if i % 5 and i % 3 else None for i in range(30)}


def test_point_queries_look_up_each_position_once(spark):
    knots = spark.createDataFrame([("chr1", 5, 0, 8), ("chr1", 10, 8, 0)], "ref string, pos int, c1 long, c2 long")
    q = spark.createDataFrame([(i, "chr1" if i % 5 else None, [7, 3, None, 90][i % 4]) for i in range(40)], "id int, ref string, pos int")
    lengths = spark.createDataFrame([("chr1", 20)], "ref string, length int")
    got = lookup.point_query(q, knots, quantize.percent(0.2), lengths=lengths)
    assert looked_up(got)
    assert got.count() == 40
    for r in got.collect():
        hit, pad = bool(r["id"] % 5) and r["pos"] == 7, bool(r["id"] % 5) and r["pos"] == 3
        assert (r["cov"], r["lower"], r["fuzzy"], r["padding"]) == (8.0 if hit else 0.0 if pad else None, 6.0 if hit else None, hit, pad)


def test_lines_are_sorted_by_columns(spark, tmp_path):
    """A sort works out an expression that is no column anew for each comparison."""
    lines = spark.createDataFrame([("chr10", 1, "c"), ("chr2", 5, "b"), ("chr2", 1, "a"), ("chrX", 1, "d")], "ref string, start1 int, line string")
    got = reports.sorted_lines(lines)
    order = next(x for x in plan(got, "optimizedPlan").splitlines() if "Sort [" in x)
    assert "regexp" not in order.lower() and "rlike" not in order.lower()
    assert [r["line"] for r in got.collect()] == ["a", "b", "c", "d"]
    sorts = sinks.in_order(lines, "head", "tail")
    order = next(x for x in plan(sorts, "optimizedPlan").splitlines() if "Sort [" in x)
    assert "regexp" not in order.lower() and "rlike" not in order.lower()
    assert [r["value"] for r in sorts.collect()] == ["head", "a", "b", "c", "d", "tail"]


def test_rows_and_their_tiles_read_one_shuffle(spark):
    """Otherwise rows are dealt once for their windows, once for summaries of tiles and once to meet these."""
    spans = spark.createDataFrame([(f"chr{i % 7}", i // 7 * 3, i // 7 * 3 + 2 + i % 2, i % 5) for i in range(700)], "ref string, start1 int, end1 int, cov long")
    for got in (windows.along(spans, ["ref"], "start1", before={"b": "cov"}, after={"n": "end1"}, sums={"s": "cov"}, tile=64), codec.segments(spans, quantize.percent(0.2), tile=64)):
        assert got.count() == 700
        got.collect()
        assert "ReusedExchange" in plan(got)


def test_null_and_empty_references_are_two(spark):
    spans = spark.createDataFrame([(r, t, p, p + 1, p) for r in (None, "", "x") for t in (None, 0, 5) for p in range(0, 40, 2)], "ref string, track int, start1 int, end1 int, cov long")
    got = windows.along(spans, ["track", "ref"], "start1", before={"b": "cov"}, after={"n": "start1"}, sums={"s": "cov"}, tile=8).collect()
    assert len(got) == 180
    for r in got:
        p = r["start1"]
        assert (r["b"], r["n"], r["s"], r["end1"]) == (p - 2 if p else None, p + 2 if p < 38 else None, sum(range(0, p + 1, 2)), p + 1)
    assert {(r["track"], r["ref"]) for r in got} == {(t, r) for t in (None, 0, 5) for r in (None, "", "x")}
    runs = windows.with_runs(spans, ["track", "ref"], "start1", lambda a, b: b["cov"] % 4 == 0, before={"b": "cov"}, after={"n": "start1"}, tile=8).collect()
    assert all((r["_run"], r["b"], r["n"]) == (r["start1"] // 4, r["start1"] - 2 if r["start1"] else None, r["start1"] + 2 if r["start1"] < 38 else None) for r in runs)
    assert len(runs) == 180


def test_a_line_of_reads_is_taken_apart_once(spark, tmp_path):
    path = str(tmp_path / "a.sam")
    with open(path, "w") as f:
        f.write("@HD\tVN:1\nr\t0\t1\t10\t9\t3M2D4M\t*\t0\t0\t*\t*\tNM:i:2\tX0:i:2\tNM:i:9\tBC:Z:a:b\tQ\nr\t16\t1\t20\t9\t5M\t*\t0\t0\t*\t*\tNM:i:8\nr\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    reads = text.read_sam(spark, path)
    assert [r["tags"] for r in reads.orderBy("pos").collect()] == [{"NM": "2", "X0": "2", "BC": "a:b", "Q": ""}, {"NM": "8"}]
    blocks = text.filtered_blocks(reads, "FLAGS^^1024;NM<8;NM>1", True)
    assert sorted(tuple(r) for r in blocks.collect()) == [("chr1", 10, 13, 0.5), ("chr1", 15, 19, 0.5)]
    p = plan(blocks, "optimizedPlan")
    assert (p.count("map_from_arrays("), p.count("split("), p.count("regexp_extract_all(")) == (1, 1, 1)
