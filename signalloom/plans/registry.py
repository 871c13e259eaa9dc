"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantize, scalar
from ..operators import codec, combine, features, filters, lookup, regions, sampling, signal, stats, variants
from . import domain as d

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
REAL = (T.FloatType, T.DoubleType)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others rounded to 6 places, so engines agree on values and types."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, WHOLE):
            c = c.cast("long")
        elif isinstance(f.dataType, REAL):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        QUERIES[key].__name__ = key
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


SPAN = _big("start1", "end1", "cov")


@query(f"WITH {d.ALL_SPANS} SELECT ref, {SPAN} FROM s")
def pileup_spans(spark, sf):
    return signal.pileup(d.reads(spark, sf))


@query(f"WITH {d.READS}, {d.spans_sql('s', '(SELECT * FROM reads WHERE flag & 1024 = 0 AND flag & 512 = 0 AND mapq > 2)')} SELECT ref, {SPAN} FROM s")
def pileup_filtered(spark, sf):
    return signal.pileup(d.reads(spark, sf).where(filters.read_filter(filters.DEFAULT + ";MAPQ>2")))


@query(f"WITH {d.READS}, {d.spans_sql('s', '(SELECT * FROM reads WHERE strand = $$+$$)')} SELECT ref, {SPAN} FROM s")
def pileup_strand(spark, sf):
    return signal.pileup(d.reads(spark, sf).where(filters.read_filter("STRAND=+")))


@query(f"WITH {d.READS} SELECT ref, count(*) AS n FROM reads WHERE h0 IS NULL OR h0 < 2 GROUP BY ref")
def filter_missing_tag(spark, sf):
    return d.reads(spark, sf).where(filters.read_filter("H0<2")).groupBy("ref").agg(F.count("*").alias("n"))


@query(f"WITH {d.TRACK_F}, {d.dense_sql('x', 'f')} SELECT ref, {_big('pos', 'cov')} FROM x")
def dense_signal(spark, sf):
    return signal.spans_to_dense(d.track(spark, sf, "F"))


@query(f"""WITH {d.TRACK_F}, {d.dense_sql('x', '(SELECT ref, start1, end1, greatest(cov - 20, 0) AS cov FROM f)')}
SELECT ref, {_big('pos', 'cov')} FROM (SELECT *, max(cov) OVER (PARTITION BY ref ORDER BY pos) AS seen FROM x) WHERE seen > 0""")
def raw_dump(spark, sf):
    from ..sources.sinks import without_leading_zeros

    return without_leading_zeros(d.track(spark, sf, "F").withColumn("cov", F.greatest(F.col("cov") - 20, F.lit(0))))


KNOTS = """kn AS (SELECT ref, start1 AS pos, before AS c1, cov AS c2 FROM (SELECT *, lag(cov, 1, 0) OVER (PARTITION BY ref ORDER BY start1) AS before FROM f) WHERE before <> cov
  UNION ALL SELECT ref, max(end1), max_by(cov, start1), 0 FROM f GROUP BY ref)"""
NUMBERED = "nu AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) - 1 AS n FROM kn), bl AS (SELECT *, n // 100 AS block_id FROM nu)"


@query(f"WITH {d.TRACK_F}, {KNOTS} SELECT ref, {_big('pos', 'c1', 'c2')} FROM kn")
def lossless_knots(spark, sf):
    return signal.spans_to_knots(d.track(spark, sf, "F"))


@query(f"WITH {d.TRACK_F}, {KNOTS}, {NUMBERED} SELECT ref, {_big('block_id', 'pos')}, CAST(pos - lag(pos, 1, 1) OVER (PARTITION BY ref, block_id ORDER BY pos) AS BIGINT) AS delta FROM bl")
def delta_knots(spark, sf):
    return codec.delta_encoded(codec.blocked(signal.spans_to_knots(d.track(spark, sf, "F")), 100)).select("ref", "block_id", "pos", "delta")


@query(f"WITH {d.TRACK_F}, {KNOTS}, {NUMBERED} SELECT ref, {_big('block_id')}, count(*) AS knots, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM bl GROUP BY ref, block_id")
def blocks(spark, sf):
    return codec.block_sizes(codec.blocked(signal.spans_to_knots(d.track(spark, sf, "F")), 100))


@query(f"""WITH {d.EVENTS}, x AS (SELECT ref, pos, CAST(cov >= 3 AS INT) AS v FROM event_signal),
y AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) - row_number() OVER (PARTITION BY ref, v ORDER BY pos) AS g FROM x)
SELECT ref, CAST(min(pos) AS BIGINT) AS start, count(*) AS n, CAST(v AS BIGINT) AS value FROM y GROUP BY ref, v, g""")
def rle_runs(spark, sf):
    e = d.event_signal(spark, sf).withColumn("v", (F.col("cov") >= 3).cast("int"))
    return codec.run_length_encoded(e, ["ref"], "pos", "v")


PIECES = "pc AS (SELECT ref, pos AS start1, lead(pos) OVER w AS end1, CAST(c2 AS DOUBLE) AS y0, CAST(lead(c1) OVER w AS DOUBLE) AS y1 FROM {k} WINDOW w AS (PARTITION BY ref ORDER BY pos))"
VALUE = "CASE WHEN end1 - 1 - start1 <= 0 THEN y0 ELSE y0 + (y1 - y0) * (pos - start1) / (end1 - 1 - start1) END"
BUILT = "re AS (SELECT ref, pos, {v} AS cov FROM (SELECT *, unnest(range(start1, end1)) AS pos FROM pc WHERE end1 IS NOT NULL))".format(v=VALUE)


@query(f"WITH {d.TRACK_F}, {KNOTS}, {PIECES.format(k='kn')}, {BUILT} SELECT ref, {_big('pos')}, round(cov, 6) AS cov FROM re")
def knots_roundtrip(spark, sf):
    return signal.knots_to_dense(signal.spans_to_knots(d.track(spark, sf, "F")))


LOW = {"PERC": "CAST(floor(cov * 0.8::DOUBLE + 0.5) AS BIGINT)", "GRID": "CASE WHEN cov = 0 THEN 0 ELSE greatest(cov // 5 * 5, 1) END", "LOG2": "CASE WHEN cov = 0 THEN 0 ELSE CAST(1 AS BIGINT) << (length(bin(cov)) - 1) END"}
HIGH = {"PERC": "CAST(floor(cov * 1.2::DOUBLE + 0.5) AS BIGINT)", "GRID": "CASE WHEN cov = 0 THEN 0 ELSE cov // 5 * 5 + 5 END", "LOG2": "CASE WHEN cov = 0 THEN 0 ELSE CAST(1 AS BIGINT) << length(bin(cov)) END"}
QUANT = {"PERC": quantize.percent(0.2), "GRID": quantize.grid(5), "LOG2": quantize.log2()}


def lossy_sql(method: str, spans: str) -> str:
    """Common tables up to kn: the corridor fold as a recursive query."""
    return f"""nu0 AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY start1) AS rn, lag(cov, 1, 0) OVER (PARTITION BY ref ORDER BY start1) AS before, {LOW[method]} AS qlo, {HIGH[method]} AS qhi FROM {spans}),
fo AS (SELECT ref, rn, cov > 0 AS knot, CASE WHEN cov > 0 THEN qlo ELSE 0 END AS lo, CASE WHEN cov > 0 THEN qhi ELSE 0 END AS hi FROM nu0 WHERE rn = 1
  UNION ALL SELECT n.ref, n.rn, n.cov < fo.lo OR n.cov > fo.hi, CASE WHEN n.cov < fo.lo OR n.cov > fo.hi THEN n.qlo ELSE fo.lo END, CASE WHEN n.cov < fo.lo OR n.cov > fo.hi THEN n.qhi ELSE fo.hi END
  FROM fo JOIN nu0 n ON n.ref = fo.ref AND n.rn = fo.rn + 1),
kn AS (SELECT ref, start1 AS pos, before AS c1, cov AS c2 FROM nu0 JOIN fo USING (ref, rn) WHERE knot
  UNION ALL SELECT ref, max(end1), max_by(cov, start1), 0 FROM nu0 GROUP BY ref)"""


for _m in QUANT:

    @query(f"WITH RECURSIVE {d.TRACK_F}, {lossy_sql(_m, 'f')} SELECT ref, {_big('pos', 'c1', 'c2')} FROM kn", name=f"lossy_{_m.lower()}")
    def _lossy(spark, sf, m=_m):
        return codec.lossy_knots(d.track(spark, sf, "F"), QUANT[m])


@query(f"WITH RECURSIVE {d.SPARSE}, {lossy_sql('PERC', 's')} SELECT ref, {_big('pos', 'c1', 'c2')} FROM kn")
def lossy_sparse_segments(spark, sf):
    return codec.lossy_knots(d.sparse_track(spark, sf), QUANT["PERC"])


BUCKET = "CASE " + " ".join(f"WHEN cov <= {b} THEN {i}" for i, b in enumerate(scalar.BUCKETS)) + f" ELSE {len(scalar.BUCKETS) - 1} END"


@query(f"""WITH RECURSIVE {d.TRACK_F}, {lossy_sql('PERC', 'f')}, {PIECES.format(k='kn')}, {BUILT}, {d.dense_sql('x', 'f')},
j AS (SELECT x.ref, x.pos, {BUCKET.replace('cov', 'x.cov')} AS bucket, abs(x.cov - coalesce(re.cov, 0)) AS diff FROM x LEFT JOIN re USING (ref, pos))
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, round(avg(diff), 6) AS mean_diff, round(max(diff), 6) AS max_diff FROM j GROUP BY bucket""")
def lossy_error_buckets(spark, sf):
    f = d.track(spark, sf, "F")
    got = signal.knots_to_dense(codec.lossy_knots(f, QUANT["PERC"]))
    return combine.error_report(signal.spans_to_dense(f), got).drop("at")


@query(f"WITH {d.ALL_SPANS}, c AS (SELECT DISTINCT cov FROM s) SELECT {_big('cov')}, {', '.join(f'CAST({LOW[m]} AS BIGINT) AS {m.lower()}_lo, CAST({HIGH[m]} AS BIGINT) AS {m.lower()}_hi' for m in QUANT)} FROM c")
def quant_bounds(spark, sf):
    c = signal.pileup(d.reads(spark, sf)).select("cov").distinct()
    return c.select("cov", *[x for m, q in QUANT.items() for x in (q.lower(F.col("cov")).alias(f"{m.lower()}_lo"), q.upper(F.col("cov")).alias(f"{m.lower()}_hi"))])


POINTS = f"""pa AS (SELECT * FROM pc WHERE end1 IS NOT NULL UNION ALL SELECT ref, pos, pos + 1, c2, c2 FROM (SELECT ref, max(pos) AS pos, max_by(c2, pos) AS c2 FROM kn GROUP BY ref)),
hit AS (SELECT v.id, v.ref, v.pos, {VALUE} AS cov, start1 IS NOT NULL AS found, CAST(y0 AS BIGINT) AS knot FROM variants v LEFT JOIN pa ON pa.ref = v.ref AND v.pos >= start1 AND v.pos < end1),
bd AS (SELECT *, {LOW['PERC'].replace('cov', 'knot')} AS lower, {HIGH['PERC'].replace('cov', 'knot')} AS upper FROM hit)"""


@query(f"""WITH RECURSIVE {d.TRACK_F}, {lossy_sql('PERC', 'f')}, {PIECES.format(k='kn')}, {d.VARIANTS}, {POINTS}
SELECT id, ref, {_big('pos')}, CASE WHEN found THEN round(cov, 6) END AS cov, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, coalesce(lower <> upper, false) AS fuzzy FROM bd""")
def point_query(spark, sf):
    knots = codec.lossy_knots(d.track(spark, sf, "F"), QUANT["PERC"])
    return lookup.point_query(d.variants(spark, sf).select("id", "ref", "pos"), knots, QUANT["PERC"]).drop("padding", "raw")


@query(f"""WITH {d.SPARSE}, f AS (SELECT * FROM s), {KNOTS}, {PIECES.format(k='kn')}, {d.SPARSE_VARIANTS}, {POINTS}
SELECT id, ref, {_big('pos')}, CASE WHEN found THEN round(cov, 6) WHEN pos > 0 AND pos < 3000 THEN 0.0 END AS cov, NOT found AND pos > 0 AND pos < 3000 AS padding FROM bd""")
def point_query_padding(spark, sf):
    knots = signal.spans_to_knots(d.sparse_track(spark, sf))
    got = lookup.point_query(d.sparse_variants(spark, sf).select("id", "ref", "pos"), knots, lengths=d.sparse_lengths(spark))
    return got.select("id", "ref", "pos", "cov", "padding")


@query(f"WITH {d.TRACK_F} SELECT ref, {_big('start1', 'end1')}, round(cov * 2.1::DOUBLE, 6) AS cov FROM f")
def scale_const(spark, sf):
    return d.track(spark, sf, "F").withColumn("cov", scalar.scaled(F.col("cov").cast("double"), 2.1))


HIST = """hi AS (SELECT CASE WHEN ref = 'chr1' THEN 'AUTOSOME' WHEN ref = 'chrX' THEN 'X' ELSE 'Y' END AS category, cov, CAST(sum(end1 - start1) AS BIGINT) AS n FROM f GROUP BY 1, 2),
md AS (SELECT category, min(cov) AS median FROM (SELECT *, sum(n) OVER (PARTITION BY category ORDER BY cov) AS r, sum(n) OVER (PARTITION BY category) AS t FROM hi) WHERE 2 * r >= t GROUP BY category)"""


@query(f"WITH {d.TRACK_F}, {HIST} SELECT f.ref, {_big('start1', 'end1')}, round(f.cov * (100.0::DOUBLE / (SELECT median FROM md WHERE category = 'AUTOSOME')), 6) AS cov FROM f")
def scale_median(spark, sf):
    f = d.track(spark, sf, "F")
    median = stats.medians(stats.histogram(f)).where("category = 'AUTOSOME'").first()["median"]
    return f.withColumn("cov", scalar.scaled(F.col("cov").cast("double"), scalar.median_factor("median*100", median)))


@query(f"WITH {d.TRACK_F}, {d.islands_sql('g', 'f', 'cov BETWEEN 60 AND 100')} SELECT ref, {_big('start1', 'end1')} FROM g")
def regions_by_coverage(spark, sf):
    return regions.regions_by_coverage(d.track(spark, sf, "F"), 60, 100)


@query(f"WITH {d.SPARSE}, {d.islands_sql('g', 's', 'cov = 0')} SELECT ref, {_big('start1', 'end1')} FROM g")
def regions_zero(spark, sf):
    return regions.regions_by_coverage(d.sparse_track(spark, sf), 0, 0)


@query(f"""WITH {d.TRACK_F}, {d.FEATURES}, {d.dense_sql('x', 'f')}
SELECT 'fixedStep chrom=' || ref || ' start=' || pos || ' step=1 span=1' AS declaration, CAST(cov AS BIGINT) AS value FROM x
WHERE EXISTS (SELECT 1 FROM features r WHERE r.ref = x.ref AND x.pos > r.start0 AND x.pos <= r.end0)""")
def to_wig_positions(spark, sf):
    dense = signal.spans_to_dense(regions.in_regions(d.track(spark, sf, "F"), d.features(spark, sf)))
    return dense.select(F.concat(F.lit("fixedStep chrom="), "ref", F.lit(" start="), "pos", F.lit(" step=1 span=1")).alias("declaration"), signal.half_up(F.col("cov")).alias("value"))


@query(f"""WITH {d.TRACK_F}, {d.dense_sql('x', 'f')} SELECT ref, CAST(z AS BIGINT) AS zoom, CAST(pos // (1 << z) AS BIGINT) AS bin, CAST(max(cov) AS BIGINT) AS max_cov, CAST(min(cov) AS BIGINT) AS min_cov, round(quantile_cont(cov, 0.5), 6) AS median_cov
FROM x, (SELECT unnest([4, 6, 8]) AS z) GROUP BY ref, z, bin""")
def zoom_summary(spark, sf):
    from ..sources.sinks import zooms

    return zooms(d.track(spark, sf, "F"), (4, 6, 8))


@query(f"""WITH {d.TRACK_F}, {d.FEATURES}, {d.dense_sql('x', 'f')} SELECT ref, count(*) AS positions, CAST(sum(cov) AS BIGINT) AS total FROM x
WHERE EXISTS (SELECT 1 FROM features r WHERE r.ref = x.ref AND x.pos > r.start0 AND x.pos <= r.end0) GROUP BY ref""")
def roi_filter(spark, sf):
    got = regions.in_regions(d.track(spark, sf, "F"), d.features(spark, sf))
    n = F.col("end1") - F.col("start1")
    return got.groupBy("ref").agg(F.sum(n).alias("positions"), F.sum(F.col("cov") * n).alias("total"))


@query(f"""WITH {d.TRACK_F} SELECT coalesce(ref, 'ALL') AS ref, CAST(sum(end1 - start1) AS BIGINT) AS positions, CAST(coalesce(sum(end1 - start1) FILTER (cov = 0), 0) AS BIGINT) AS zero,
CAST(min(cov) AS BIGINT) AS min_cov, CAST(max(cov) AS BIGINT) AS max_cov FROM f GROUP BY GROUPING SETS ((ref), ())""")
def stats_per_ref(spark, sf):
    return stats.per_reference(d.track(spark, sf, "F"))


@query(f"WITH {d.TRACK_F}, {HIST} SELECT category, round(sum(cov * n) / sum(n)::DOUBLE, 6) AS mean_cov, CAST(sum(n) AS BIGINT) AS positions FROM hi GROUP BY category")
def stats_category(spark, sf):
    return stats.per_category(d.track(spark, sf, "F"))


@query(f"WITH {d.TRACK_F}, {HIST} SELECT category, {_big('cov', 'n')} FROM hi")
def hist_category(spark, sf):
    return stats.histogram(d.track(spark, sf, "F"))


@query(f"WITH {d.TRACK_F}, {HIST} SELECT category, {_big('median')} FROM md")
def median_category(spark, sf):
    return stats.medians(stats.histogram(d.track(spark, sf, "F")))


def _json_part(name: str, category: str) -> str:
    return f"""'"histogram-{name}":{{"bins":[' || string_agg(hi.cov, ',' ORDER BY hi.cov) FILTER (hi.category = '{category}') || '],"counts":[' || string_agg(hi.n, ',' ORDER BY hi.cov) FILTER (hi.category = '{category}') || ']}},"median-{name}":' || max(median) FILTER (hi.category = '{category}')"""


@query(f"WITH {d.TRACK_F}, {HIST} SELECT '{{' || {_json_part('autosomes', 'AUTOSOME')} || ',' || {_json_part('X', 'X')} || ',' || {_json_part('Y', 'Y')} || '}}' AS json FROM hi JOIN md USING (category)")
def hist_json(spark, sf):
    return stats.histogram_json(stats.histogram(d.track(spark, sf, "F")))


PAIR = f"{d.TRACK_F}, {d.TRACK_O}, {d.dense_sql('x', 'f')}, {d.dense_sql('y', 'o')}, xy AS (SELECT x.ref, x.pos, x.cov AS a, y.cov AS b FROM x JOIN y USING (ref, pos))"
OPERATORS = {"ADD": "a + b", "SUBTRACT": "a - b", "DIFF": "abs(a - b)", "MIN": "least(a, b)", "MAX": "greatest(a, b)", "AVG": "(a + b) / 2.0::DOUBLE"}
for _op, _expr in OPERATORS.items():

    @query(
        f"""WITH {PAIR}, v AS (SELECT ref, pos, {_expr} AS cov FROM xy), g AS (SELECT *, pos - row_number() OVER (PARTITION BY ref, cov ORDER BY pos) AS g FROM v)
SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 1 AS BIGINT) AS end1, {'round(cov, 6)' if _op == 'AVG' else 'CAST(cov AS BIGINT)'} AS cov FROM g GROUP BY ref, cov, g""",
        name=f"combine_{_op.lower()}",
    )
    def _combine(spark, sf, op=_op):
        return combine.combine(d.track(spark, sf, "F"), d.track(spark, sf, "O"), op)


@query(f"""WITH {PAIR} SELECT count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_x, CAST(sum(b) AS BIGINT) AS sum_y, CAST(sum(a * b) AS BIGINT) AS sum_xy, round(avg(a), 6) AS mean_x, round(avg(b), 6) AS mean_y,
round(stddev_samp(a), 6) AS sd_x, round(stddev_samp(b), 6) AS sd_y, round(corr(a, b), 6) AS r FROM xy""")
def correlate(spark, sf):
    return combine.correlation(d.track(spark, sf, "F"), d.track(spark, sf, "O"))


@query(f"""WITH {d.READS}, {d.spans_sql('s', 'reads', 'track, ref')}, {d.FEATURES} SELECT feature_id, track, round(sum(s.cov * (least(s.end1, f.end0 + 1) - greatest(s.start1, f.start0 + 1))) / any_value(f.end0 - f.start0)::DOUBLE, 6) AS mean_cov
FROM features f JOIN s ON s.ref = f.ref AND s.start1 < f.end0 + 1 AND s.end1 > f.start0 + 1 GROUP BY feature_id, track""")
def coverage_per_feature(spark, sf):
    spans = signal.pileup(d.reads(spark, sf), ("track",))
    return features.coverage_per_feature(d.features(spark, sf), spans, ("track",))


@query(f"""WITH {d.READS}, {d.spans_sql('s', 'reads', 'track, ref')}, {d.FEATURES}, {d.dense_sql('x', 's', 'track, ref')},
i AS (SELECT DISTINCT ref, unnest(range(start0 + 1, end0 + 1)) AS pos FROM features) SELECT track, count(*) AS positions, round(avg(cov), 6) AS mean_cov FROM x JOIN i USING (ref, pos) GROUP BY track""")
def coverage_overall(spark, sf):
    return features.coverage_overall(d.features(spark, sf), signal.pileup(d.reads(spark, sf), ("track",)), ("track",))


MEANS = "mn AS (SELECT feature_id, sum(f.cov * (least(f.end1, q.end0 + 1) - greatest(f.start1, q.start0 + 1))) / any_value(q.end0 - q.start0)::DOUBLE AS m FROM features q JOIN f ON f.ref = q.ref AND f.start1 < q.end0 + 1 AND f.end1 > q.start0 + 1 GROUP BY feature_id)"


@query(f"WITH {d.TRACK_F}, {d.FEATURES}, {MEANS} SELECT CAST(floor(floor(m + 0.5) / 10) * 10 AS BIGINT) AS bin, count(*) AS n FROM mn WHERE m > 5 AND m < 200 GROUP BY 1")
def feature_hist(spark, sf):
    m = features.coverage_per_feature(d.features(spark, sf), d.track(spark, sf, "F"))
    kept = m.where((F.col("mean_cov") > 5) & (F.col("mean_cov") < 200))
    return kept.groupBy(scalar.binned(signal.half_up(F.col("mean_cov")), 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {d.TRACK_F}, {d.VARIANTS}, a AS (SELECT DISTINCT ref, pos FROM variants WHERE filter IN ('PASS', '.')), h AS (SELECT a.ref, f.cov // 10 * 10 AS bin FROM a JOIN f ON f.ref = a.ref AND a.pos >= start1 AND a.pos < end1)
SELECT CASE WHEN grouping(ref) = 1 THEN 'ALL' ELSE ref END AS ref, {_big('bin')}, count(*) AS n FROM h GROUP BY GROUPING SETS ((ref, bin), (bin))""")
def variant_hist(spark, sf):
    return variants.histogram_at_variants(d.variants(spark, sf), d.track(spark, sf, "F"), 10)


@query(f"""WITH {d.TRACK_F}, {d.FEATURES}, {d.dense_sql('x', 'f')}, b AS (SELECT gene, CAST(sum(end0 - start0) AS BIGINT) AS bases FROM features GROUP BY gene),
h AS (SELECT gene, sum(x.cov) AS total, count(*) FILTER (x.cov > 0) AS covered FROM features q JOIN x ON x.ref = q.ref AND x.pos > q.start0 AND x.pos <= q.end0 GROUP BY gene)
SELECT gene, bases, round(coalesce(total, 0) / bases::DOUBLE, 6) AS mean_cov, round(1 - coalesce(covered, 0) / bases::DOUBLE, 6) AS uncovered FROM b LEFT JOIN h USING (gene)""")
def coverage_per_gene(spark, sf):
    return features.coverage_per_gene(d.features(spark, sf), d.track(spark, sf, "F"))


@query(f"WITH {d.TRACK_F}, {d.VARIANTS} SELECT v.id, v.ref, CAST(v.pos AS BIGINT) AS pos, v.dp, CAST(f.cov AS BIGINT) AS cov FROM variants v LEFT JOIN f ON f.ref = v.ref AND v.pos >= start1 AND v.pos < end1")
def annotate_variants(spark, sf):
    return variants.annotated(d.variants(spark, sf), d.track(spark, sf, "F")).select("id", "ref", "pos", "dp", "cov")


@query(f"""WITH {d.TRACK_F}, {d.VARIANTS}, n AS (SELECT ref, pos, max(zygosity = 'HET') AS het FROM variants WHERE NOT tumor GROUP BY ref, pos)
SELECT v.id, v.ref, CAST(v.pos AS BIGINT) AS pos, CASE WHEN n.het IS NOT NULL AND NOT (v.zygosity = 'HOM' AND n.het) THEN 'normal_also' WHEN coalesce(f.cov, 0) >= 60 THEN 'accepted' ELSE 'low_coverage' END AS route
FROM variants v LEFT JOIN n USING (ref, pos) LEFT JOIN f ON f.ref = v.ref AND v.pos >= start1 AND v.pos < end1 WHERE v.tumor""")
def tumor_normal_routes(spark, sf):
    v = d.variants(spark, sf)
    got = variants.tumor_normal_routes(v.where("tumor"), v.where("not tumor"), d.track(spark, sf, "F"), 60)
    return got.select("id", "ref", "pos", "route")


@query(f"""WITH {d.TRACK_F}, {d.VARIANTS}, {d.dense_sql('x', 'f')}, m AS (SELECT ref, pos, max(dp) AS dp FROM variants GROUP BY ref, pos),
v AS (SELECT x.ref, x.pos, coalesce(m.dp, x.cov) AS cov FROM x LEFT JOIN m USING (ref, pos)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY ref, cov ORDER BY pos) AS g FROM v)
SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 1 AS BIGINT) AS end1, CAST(cov AS DOUBLE) AS cov FROM g GROUP BY ref, cov, g""")
def variant_override(spark, sf):
    return variants.override(d.track(spark, sf, "F"), d.variants(spark, sf))


@query(f"""WITH {d.TRACKS}, {d.dense_sql('x', '(SELECT * FROM t WHERE cov >= 30 + CAST(track AS INT))', 'track, ref')}, c AS (SELECT ref, pos FROM x GROUP BY ref, pos HAVING count(*) = 5),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY ref ORDER BY pos) AS g FROM c) SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 1 AS BIGINT) AS end1 FROM g GROUP BY ref, g""")
def min_covered_intersection(spark, sf):
    return regions.min_covered(d.tracks(spark, sf), "track", {str(i): 30 + i for i in range(5)})[1]


@query(f"""WITH {d.TRACK_F}, {d.FEATURES}, {d.islands_sql('g', 'f', 'cov >= 60')} SELECT CAST(q.feature_id AS VARCHAR) AS name, CAST(coalesce(sum(least(g.end1, q.end0 + 1) - greatest(g.start1, q.start0 + 1)) FILTER (g.ref IS NOT NULL), 0) AS BIGINT) AS covered,
round(coalesce(sum(least(g.end1, q.end0 + 1) - greatest(g.start1, q.start0 + 1)) FILTER (g.ref IS NOT NULL), 0) / any_value(q.end0 - q.start0)::DOUBLE, 6) AS share
FROM features q LEFT JOIN g ON g.ref = q.ref AND g.start1 < q.end0 + 1 AND g.end1 > q.start0 + 1 GROUP BY q.feature_id""")
def scope_overlap(spark, sf):
    scope = d.features(spark, sf).select("ref", "start0", "end0", F.col("feature_id").cast("string").alias("name"))
    return regions.scope_overlap(scope, regions.regions_by_coverage(d.track(spark, sf, "F"), 60)).select("name", "covered", "share")


@query(f"WITH {d.TRACK_F}, {d.dense_sql('x', 'f')} SELECT ref, {_big('pos', 'cov')} FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) AS rn FROM x) WHERE (rn - 1) % 7 = 0")
def subsample_step(spark, sf):
    return sampling.every_nth(d.track(spark, sf, "F"), 7)


@query(f"""WITH {d.TRACK_F}, {d.FEATURES}, {d.dense_sql('x', 'f')}, i AS (SELECT DISTINCT ref, unnest(range(start0 + 1, end0 + 1)) AS pos FROM features)
SELECT ref, {_big('pos', 'cov')} FROM (SELECT x.*, row_number() OVER (PARTITION BY ref ORDER BY pos) AS rn FROM x JOIN i USING (ref, pos) WHERE pos >= 100) WHERE (rn - 1) % 5 = 0""")
def subsample_regions(spark, sf):
    return sampling.every_nth(d.track(spark, sf, "F"), 5, d.features(spark, sf), start=100)


MATRIX = f"""{d.TRACKS}, {d.dense_sql('x', 't', 'track, ref')}, ro AS (SELECT ref, pos FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) AS rn FROM x WHERE track = '0') WHERE (rn - 1) % 50 = 0),
mx AS (SELECT ro.ref, ro.pos, k.track, x.cov FROM ro CROSS JOIN (SELECT unnest(['0', '1', '2', '3', '4']) AS track) k LEFT JOIN x ON x.ref = ro.ref AND x.pos = ro.pos AND x.track = k.track),
nm AS (SELECT *, cov / avg(cov) OVER (PARTITION BY track) AS norm FROM mx)"""
TRACK_NAMES = [str(i) for i in range(5)]


@query(f"WITH {MATRIX} SELECT ref, {_big('pos', 'cov')}, track FROM mx")
def window_samples(spark, sf):
    return sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES)


@query(f"WITH {MATRIX} SELECT ref, {_big('pos')}, round(avg(norm), 6) AS mean, round(min(norm), 6) AS min, round(max(norm), 6) AS max, round(coalesce(stddev_samp(norm), 0), 6) AS sd FROM nm GROUP BY ref, pos")
def normalize_matrix(spark, sf):
    return stats.row_statistics(stats.normalized(sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES)))


def _legacy(p: float) -> str:
    h = f"((n + 1) * {p}::DOUBLE)"
    return f"CASE WHEN {h} < 1 THEN v[1] WHEN {h} >= n THEN v[n] ELSE v[CAST(floor({h}) AS INT)] + ({h} - floor({h})) * (v[CAST(floor({h}) AS INT) + 1] - v[CAST(floor({h}) AS INT)]) END"


@query(f"""WITH {MATRIX}, g AS (SELECT ref, pos, list_sort(list(norm) FILTER (norm IS NOT NULL)) AS v, count(norm) AS n FROM nm GROUP BY ref, pos),
q AS (SELECT ref, pos, {_legacy(0.25)} AS q1, {_legacy(0.75)} AS q3 FROM g), w AS (SELECT ref, pos, greatest(0, q3 + 1.5 * (q3 - q1)) AS upper, greatest(0, q1 - 1.5 * (q3 - q1)) AS lower FROM q)
SELECT nm.ref, CAST(nm.pos AS BIGINT) AS pos, track, round(norm, 6) AS norm, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN norm > upper THEN 'GAIN' WHEN norm < lower THEN 'LOSS' END AS call FROM nm JOIN w USING (ref, pos)""")
def tukey_outliers(spark, sf):
    return stats.tukey(stats.normalized(sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES)))


GAPS = """gp AS (SELECT start1 - lag(start1) OVER (PARTITION BY supp, ref ORDER BY start1) AS gap FROM reads),
rk AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM gp WHERE gap IS NOT NULL), me AS (SELECT avg(gap) AS mean_gap FROM rk WHERE i >= floor(n * 0.25) AND i < floor(n * 0.75))"""


@query(f"WITH {d.READS}, {GAPS} SELECT round(mean_gap, 6) AS mean_gap FROM me")
def midmean_start_diff(spark, sf):
    return stats.midmean_gap(d.reads(spark, sf), ("supp", "ref"))


@query(f"""WITH {d.READS}, {GAPS} SELECT CAST(CASE WHEN mean_gap <= 0 THEN 0 ELSE greatest(0, 1 + CASE WHEN i <= 0 THEN 0 ELSE floor(log2(i) + 0.5) END) END AS BIGINT) AS k
FROM (SELECT mean_gap, CASE WHEN mean_gap > 0 THEN floor(ln((1 + sqrt(5)) / 2 - 1) / ln(mean_gap / (mean_gap + 1))) END AS i FROM me)""")
def golomb_k(spark, sf):
    mean = stats.midmean_gap(d.reads(spark, sf), ("supp", "ref")).first()["mean_gap"] or 0.0
    return spark.createDataFrame([(scalar.golomb_parameter(mean),)], "k long")


@query(f"WITH {d.TRACK_F}, al AS (SELECT * FROM (VALUES ('chrX', '23'), ('chrY', '24')) t(ref, alias)) SELECT coalesce(alias, f.ref) AS ref, {SPAN} FROM f LEFT JOIN al USING (ref)")
def alias_rename(spark, sf):
    from ..sources.text import renamed

    return renamed(d.track(spark, sf, "F"), spark.createDataFrame([("chrX", "23"), ("chrY", "24")], "ref string, alias string"))


@query(f"""WITH {d.READS}, {d.EVENTS}, u AS (SELECT ref, 1 AS src FROM reads UNION ALL SELECT ref, 2 FROM event_signal), m AS (SELECT ref, min(src) AS src FROM u GROUP BY ref)
SELECT ref, row_number() OVER (ORDER BY src, ref) - 1 AS ord FROM m""")
def chrom_list_union(spark, sf):
    a = d.reads(spark, sf).select("ref", F.lit(1).alias("src"))
    b = d.event_signal(spark, sf).select("ref", F.lit(2).alias("src"))
    w = Window.orderBy("src", "ref")  # one row a reference name
    return a.unionByName(b).groupBy("ref").agg(F.min("src").alias("src")).select("ref", (F.row_number().over(w) - 1).alias("ord"))


@query(f"WITH {d.TRACK_F}, {d.dense_sql('x', 'f')} SELECT ref, {_big('pos', 'cov')} FROM x WHERE ref IN ('chrX', 'chrY') ORDER BY ref, pos LIMIT 100")
def dump_limit(spark, sf):
    return signal.spans_to_dense(d.track(spark, sf, "F").where(F.col("ref").isin("chrX", "chrY"))).orderBy("ref", "pos").limit(100)


@query(f"WITH {d.EVENTS} SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 1 AS BIGINT) AS end1, cov FROM (SELECT *, pos - row_number() OVER (PARTITION BY ref, cov ORDER BY pos) AS g FROM event_signal) GROUP BY ref, cov, g")
def event_spans(spark, sf):
    return signal.dense_to_spans(d.event_signal(spark, sf))


from . import files  # noqa: E402, F401 - more queries, which use the parts above
