"""Hand-made vectors and relations between forms."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.functions import quantize, scalar
from signalloom.operators import codec, combine, filters, lookup, regions, sampling, signal, stats, windows

V1 = {"chr1": {1: 0, 2: 2, 3: 3, 4: 4}, "chr2": {10: 2, 11: 3, 12: 4, 13: 0, 14: 5}, "chr3": {4: 6}}


def dense(spark, v):
    return spark.createDataFrame([(r, p, c) for r, row in v.items() for p, c in row.items()], "ref string, pos int, cov long")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def spans(spark):
    return signal.dense_to_spans(dense(spark, V1))


def test_lossless_knots_of_a_hand_vector(spans):
    want = [("chr1", 2, 0, 2), ("chr1", 3, 2, 3), ("chr1", 4, 3, 4), ("chr1", 5, 4, 0), ("chr2", 10, 0, 2), ("chr2", 11, 2, 3), ("chr2", 12, 3, 4), ("chr2", 13, 4, 0), ("chr2", 14, 0, 5), ("chr2", 15, 5, 0), ("chr3", 4, 0, 6), ("chr3", 5, 6, 0)]
    assert rows(signal.spans_to_knots(spans), "ref", "pos", "c1", "c2") == want
    assert rows(codec.lossy_knots(spans, quantize.percent(0)), "ref", "pos", "c1", "c2") == want


def test_lossy_knots_of_a_hand_vector(spans):
    got = rows(codec.lossy_knots(spans, quantize.percent(0.2)), "ref", "pos")
    assert got == [("chr1", 2), ("chr1", 3), ("chr1", 5), ("chr2", 10), ("chr2", 11), ("chr2", 13), ("chr2", 14), ("chr2", 15), ("chr3", 4), ("chr3", 5)]
    back = rows(signal.knots_to_dense(codec.lossy_knots(spans, quantize.percent(0.2))), "ref", "pos", "cov")
    assert back == [(r, p, float(c)) for r, row in V1.items() for p, c in row.items() if (r, p) != ("chr1", 1)]


CORRIDORS = {0: ((0, 0), (0, 0), (0, 0)), 1: ((1, 1), (1, 5), (1, 2)), 3: ((2, 4), (1, 5), (2, 4)), 4: ((3, 5), (1, 5), (4, 8)), 5: ((4, 6), (5, 10), (4, 8)), 8: ((6, 10), (5, 10), (8, 16)), 10: ((8, 12), (10, 15), (8, 16)), 16: ((13, 19), (15, 20), (16, 32)), 29: ((23, 35), (25, 30), (16, 32)), 64: ((51, 77), (60, 65), (64, 128))}


def test_corridors(spark):
    df = spark.createDataFrame([(c,) for c in CORRIDORS], "c long")
    qs = (quantize.percent(0.2), quantize.grid(5), quantize.log2())
    for r in df.select("c", *[F.struct(q.lower(F.col("c")), q.upper(F.col("c"))) for q in qs]).collect():
        assert tuple(tuple(x) for x in r[1:]) == CORRIDORS[r[0]]
    for bad in (lambda: quantize.percent(1.5), lambda: quantize.grid(0), lambda: quantize.quantizer("PERC"), lambda: quantize.quantizer("X")):
        with pytest.raises(ValueError):
            bad()


def fold(values, lo_hi):
    """Serial reference of the corridor rule over {pos: cov}."""
    out, lo, hi, last = [], 0, 0, 0
    for p in sorted(values):
        c = values[p]
        if not lo <= c <= hi:
            out.append((p, last, c))
            lo, hi = lo_hi(c)
        last = c
    return out + [(max(values) + 1, last, 0)]


@pytest.mark.parametrize(("name", "q", "rule"), [
    ("half", quantize.percent(0.5), lambda c: (int(c * 0.5 + 0.5), int(c * 1.5 + 0.5))),
    ("wide", quantize.percent(0.9), lambda c: (int(c * (1 - 0.9) + 0.5), int(c * 1.9 + 0.5))),
    ("grid", quantize.grid(5), lambda c: (0, 0) if c == 0 else (max(1, c // 5 * 5), c // 5 * 5 + 5)),
])
def test_parallel_fold_is_the_serial_fold(spark, name, q, rule):
    rng = random.Random(7)
    v = {f"chr{k}": {p: max(0, rng.randint(-6, 12)) for p in range(1, 200)} for k in range(3)}
    got = rows(codec.lossy_knots(signal.dense_to_spans(dense(spark, v), tile=16), q, tile=16), "ref", "pos", "c1", "c2")
    assert got == sorted((r, *k) for r, row in v.items() for k in fold(row, rule))


def test_tiles_do_not_show(spark):
    rng = random.Random(3)
    reads = spark.createDataFrame([(f"chr{rng.randint(1, 3)}", s := rng.randint(1, 500), s + rng.randint(1, 40)) for _ in range(300)], "ref string, start1 int, end1 int")
    one, many = signal.pileup(reads), signal.pileup(reads, tile=8)
    assert rows(one, "ref", "start1", "end1", "cov") == rows(many, "ref", "start1", "end1", "cov")
    assert rows(regions.regions_by_coverage(one, 3), "ref", "start1", "end1") == rows(regions.regions_by_coverage(one, 3, tile=8), "ref", "start1", "end1")
    assert rows(sampling.every_nth(one, 7), "ref", "pos", "cov") == rows(sampling.every_nth(one, 7, tile=8), "ref", "pos", "cov")
    depth = {}
    for r in reads.collect():
        for p in range(r[1], r[2]):
            depth[r[0], p] = depth.get((r[0], p), 0) + 1
    assert {(r, p): c for r, p, c in rows(signal.spans_to_dense(many), "ref", "pos", "cov") if c} == depth


def test_queries_equal_the_scan_and_scaling(spark, spans):
    knots = signal.spans_to_knots(spans)
    scan = {(r, p): c for r, p, c in rows(signal.knots_to_dense(knots), "ref", "pos", "cov")}
    ask = spark.createDataFrame([(r, p) for r in V1 for p in range(0, 20)], "ref string, pos int")
    got = {(r["ref"], r["pos"]): r for r in lookup.point_query(ask, knots, quantize.percent(0.2), scale=2.1, lengths=spark.createDataFrame([("chr1", 18)], "ref string, length int")).collect()}
    for key, r in got.items():
        if key in scan:
            assert r["cov"] == pytest.approx(2.1 * scan[key]) and not r["padding"]
    assert got["chr1", 5]["cov"] == 0 and got["chr1", 17]["padding"] and got["chr1", 18]["cov"] is None and got["chr1", 0]["cov"] is None
    assert got["chr3", 9]["cov"] is None and not got["chr3", 9]["padding"]


def test_regions_cover_what_they_should(spark, spans):
    inside = {(r, p) for r, a, z in rows(regions.regions_by_coverage(spans, 1), "ref", "start1", "end1") for p in range(a, z)}
    assert inside == {(r, p) for r, row in V1.items() for p, c in row.items() if c >= 1}
    zero = {(r, p) for r, a, z in rows(regions.regions_by_coverage(spans, 0, 0), "ref", "start1", "end1") for p in range(a, z)}
    assert zero == {("chr1", 1), ("chr2", 13)}


def test_synced_join_of_a_signal_with_itself(spark):
    a = signal.dense_to_spans(dense(spark, {"chr1": {1: 1, 2: 2, 3: 3, 4: 4}, "chr2": {1: 1, 2: 1, 3: 0, 4: 1}, "chr3": {4: 2}}))
    both = combine.synced(a, a, width=2)
    assert sum(z - s for _, s, z, _, _ in rows(both, "ref", "start1", "end1", "x", "y")) == 9
    assert both.where("x <> y").count() == 0
    assert rows(combine.combine(a, a, "DIFF"), "ref", "start1", "end1", "cov") == [("chr1", 1, 5, 0), ("chr2", 1, 5, 0), ("chr3", 4, 5, 0)]


def test_filters(spark):
    df = spark.createDataFrame([(1, 0, "+", {"NM": "3"}), (2, 1024, "-", {"NM": "1"}), (3, 16, "-", {}), (4, 512, "+", {})], "id int, flag int, strand string, tags map<string,string>")
    ids = lambda f: [r[0] for r in df.where(filters.read_filter(f)).orderBy("id").collect()]
    assert ids(None) == [1, 3] and ids("none") == [1, 2, 3, 4]
    assert ids("NM<2") == [2, 3, 4] and ids("STRAND=-") == [2, 3] and ids("FLAGS&&16") == [3] and ids("NM!=3;FLAGS^^512") == [2, 3]
    with pytest.warns(UserWarning):
        assert ids("what is this") == [1, 2, 3, 4]


def test_scalars(spark):
    assert [scalar.rounded_log2(x) for x in (-1, 0, 1, 2, 3, 5, 6)] == [0, 0, 0, 1, 2, 2, 3]
    assert scalar.golomb_parameter(0) == 0 and scalar.golomb_parameter(100) > scalar.golomb_parameter(10)
    assert scalar.median_factor("median*30", 15) == 2
    with pytest.raises(ValueError):
        scalar.scaled(F.lit(1), 0)
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double").agg(F.collect_list("x").alias("v"))
    assert tuple(df.select(stats.legacy_percentile(F.col("v"), 25), stats.legacy_percentile(F.col("v"), 75)).first()) == (1.25, 3.75)
    assert regions.parse_roi("1:100-200") == ("1", 99, 200)


def test_runs_and_blocks_come_back(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyyxzz")], "k string, at int, v string")
    runs = codec.run_length_encoded(df, ["k"], "at", "v", tile=3)
    assert rows(runs, "start", "n", "value") == [(0, 2, "x"), (2, 3, "y"), (5, 1, "x"), (6, 2, "z")]
    assert "".join(r["value"] for r in codec.run_length_decoded(runs).orderBy("start", "i").collect()) == "xxyyyxzz"
    knots = spark.createDataFrame([("chr1", p) for p in (3, 7, 8, 20, 21)], "ref string, pos int")
    deltas = codec.delta_encoded(codec.blocked(knots, 2))
    assert rows(deltas, "block_id", "pos", "delta") == [(0, 3, 2), (0, 7, 4), (1, 8, 7), (1, 20, 12), (2, 21, 20)]


def test_empty_signals(spark):
    none = spark.createDataFrame([], "ref string, start1 int, end1 int")
    spans = signal.pileup(none)
    assert spans.count() == 0 and signal.spans_to_knots(spans).count() == 0 and regions.regions_by_coverage(spans, 1).count() == 0
    assert codec.lossy_knots(spans, quantize.log2()).count() == 0 and windows.with_running(none, ["ref"], "start1", {"n": F.lit(1)}).count() == 0
