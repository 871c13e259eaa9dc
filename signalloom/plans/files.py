"""Queries through files: the driver's tables are written in a format, read back by its reader, and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import api
from ..functions import quantize, scalar
from ..operators import codec, combine, features, filters, lookup, regions, sampling, signal, stats, storage, variants
from ..sources import reports, sinks, store, text
from . import domain as d
from .registry import BUILT, HIST, KNOTS, LOW, HIGH, MATRIX, NUMBERED, PAIR, PIECES, POINTS, QUANT, TRACK_NAMES, VALUE, _big, _legacy, lossy_sql, query

SPAN = _big("start1", "end1")


def _place(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/signalloom/{uuid.uuid4().hex}/{name}"


def _saved(spark, lines, name: str, **kw) -> str:
    path = _place(spark, name)
    sinks.write_lines(lines, path, **kw)
    return path


def _text(spark, line, df, name: str) -> str:
    path = _place(spark, name)
    df.select(line.alias("value")).write.text(path)
    return path


def _sheet(spark, df, name: str) -> str:
    """A tab-separated table with a header in each of its files."""
    path = _place(spark, name)
    df.write.option("sep", "\t").option("header", True).csv(path)
    return path


# --- alignments

READS_NM = d.READS.replace("l_suppkey AS supp", "l_suppkey AS supp, CAST(round(l_discount * 100) AS INT) AS nm")
BLOCKS = """k AS (SELECT * FROM reads WHERE supp % 7 <> 0 AND {keep}),
bk AS (SELECT ref, start1, CASE WHEN end1 - start1 > 8 THEN start1 + 3 ELSE end1 END AS end1, {w} AS wt FROM k UNION ALL SELECT ref, start1 + 5, end1, {w} FROM k WHERE end1 - start1 > 8)"""


def _sam(spark, sf) -> str:
    """Reads with a deletion in those longer than 8, every seventh supplier's unmapped."""
    n = F.col("end1") - F.col("start1")
    lost = F.col("supp") % 7 == 0
    cigar = F.when(n > 8, F.concat(F.lit("3M2D"), (n - 5).cast("string"), F.lit("M"))).otherwise(F.concat(n.cast("string"), F.lit("M")))
    cells = [F.lit("r"), (F.col("flag") + F.when(lost, 4).otherwise(0)).cast("string"), F.when(lost, "*").otherwise(F.substring("ref", 4, 9)), F.col("start1").cast("string"), F.col("mapq").cast("string"), cigar]
    tags = [F.concat(F.lit("NM:i:"), F.col("tags")["NM"]), F.concat(F.lit("X0:i:"), (F.col("supp") % 2 + 1).cast("string"))]
    line = F.concat_ws("\t", *cells, *[F.lit(x) for x in "*00**"], *tags)
    return _text(spark, line, d.reads(spark, sf), "a.sam")


@query(f"WITH {READS_NM}, {BLOCKS.format(keep='flag & 1024 = 0 AND flag & 512 = 0 AND nm < 8', w='1')}, {d.spans_sql('s', 'bk')} SELECT ref, {_big('start1', 'end1', 'cov')} FROM s")
def sam_file(spark, sf):
    return text.read_signal(spark, _sam(spark, sf), read_filter=filters.DEFAULT + ";NM<8")


WEIGHTED = d.spans_sql("s", "bk").replace("1 AS d", "wt AS d").replace("end1, -1 FROM", "end1, -wt FROM").replace("CAST(sum(d) OVER w AS BIGINT)", "sum(d) OVER w")


@query(f"WITH {READS_NM}, {BLOCKS.format(keep='true', w='1.0::DOUBLE / (supp % 2 + 1)')}, {WEIGHTED} SELECT ref, {SPAN}, round(cov, 6) AS cov FROM s")
def sam_weighted(spark, sf):
    return text.read_signal(spark, _sam(spark, sf), read_filter="none", weight_by_x0=True)


@query(f"WITH {READS_NM} SELECT strand, fop_strand, count(*) AS n FROM (SELECT strand, strand AS fop_strand FROM reads WHERE supp % 7 <> 0) GROUP BY ALL")
def sam_strands(spark, sf):
    return text.read_sam(spark, _sam(spark, sf)).groupBy("strand", "fop_strand").agg(F.count("*").alias("n"))


# --- signals


@query(f"WITH {d.TRACK_F} SELECT ref, {SPAN}, cov * 2.0::DOUBLE AS cov FROM f")
def wig_file(spark, sf):
    path = _saved(spark, sinks.wig_lines(d.track(spark, sf, "F")), "a.wig", header="track type=wiggle_0")
    return text.read_signal(spark, path, scale=2.0)


@query(f"WITH {d.TRACK_F} SELECT ref, {SPAN}, CAST(cov AS DOUBLE) AS cov FROM f")
def gvcf_file(spark, sf):
    cells = [F.col("ref"), F.col("start1").cast("string"), F.lit("."), F.lit("A"), F.lit("<NON_REF>"), F.lit("."), F.lit("."), F.concat(F.lit("END="), (F.col("end1") - 1).cast("string")), F.lit("GT:DP"), F.concat(F.lit("0/0:"), F.col("cov").cast("string"))]
    return text.read_signal(spark, _text(spark, F.concat_ws("\t", *cells), d.track(spark, sf, "F"), "a.gvcf"))


@query(f"WITH {d.TRACK_F} SELECT ref, {SPAN}, cov * 0.5::DOUBLE AS cov FROM f")
def coverage_file(spark, sf):
    path = _saved(spark, sinks.coverage_lines(signal.spans_to_dense(d.track(spark, sf, "F"))), "a.txt", header="# ref, position, coverage")
    return text.read_signal(spark, path, scale=0.5)


@query("SELECT CAST(p_size AS BIGINT) AS size, 'chr' || p_size AS ref, CAST(row_number() OVER (ORDER BY p_size) AS BIGINT) AS place FROM (SELECT DISTINCT p_size FROM part)")
def genomic_sorted(spark, sf):
    ref = F.concat(F.lit("chr"), F.col("p_size").cast("string"))
    sizes = spark.read.parquet(f"{sf}/part.parquet").select("p_size").distinct().select("p_size", ref.alias("ref"))
    w = Window.orderBy(scalar.genomic_order(F.col("ref")))  # one row a reference name
    return sizes.select(F.col("p_size").alias("size"), "ref", F.row_number().over(w).alias("place"))


# --- variants

VCF = f"{d.VARIANTS}, vc AS (SELECT *, dp / 2.0::DOUBLE AS qual, CASE WHEN zygosity = 'HOM' THEN '1/1' ELSE '0/1' END AS gt FROM variants)"


def _vcf(spark, sf) -> str:
    """Names without chr; a depth and a flag in INFO, or nothing for every fifth depth."""
    info = F.when(F.col("dp") % 5 == 0, ".").otherwise(F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";DB")))
    cells = [F.substring("ref", 4, 9), F.col("pos").cast("string"), F.col("id").cast("string"), F.lit("A"), F.lit("G"), (F.col("dp") / 2).cast("string"), F.col("filter"), info, F.lit("GT:AD"), F.when(F.col("zygosity") == "HOM", "1/1:0,3").otherwise("0/1:1,2")]
    return _text(spark, F.concat_ws("\t", *cells), d.variants(spark, sf), "a.vcf")


@query(f"WITH {VCF} SELECT CAST(id AS VARCHAR) AS id, ref, {_big('pos')}, round(qual, 6) AS qual, filter, CASE WHEN dp % 5 <> 0 THEN dp END AS dp, gt AS genotype, zygosity FROM vc")
def vcf_file(spark, sf):
    return text.read_vcf(spark, _vcf(spark, sf)).select("id", "ref", "pos", "qual", "filter", "dp", "genotype", "zygosity")


@query(rf"""WITH {d.TRACK_F}, {VCF} SELECT concat_ws(chr(9), substr(v.ref, 4), v.pos, v.id, 'A', 'G', v.qual, v.filter,
CASE WHEN dp % 5 = 0 AND f.cov IS NULL THEN '.' WHEN dp % 5 = 0 THEN 'CV=' || f.cov ELSE 'DP=' || dp || ';DB' || coalesce(';CV=' || f.cov, '') END, 'GT:AD', CASE WHEN zygosity = 'HOM' THEN '1/1:0,3' ELSE '0/1:1,2' END) AS line
FROM vc v LEFT JOIN f ON f.ref = v.ref AND v.pos >= start1 AND v.pos < end1""")
def vcf_annotated_file(spark, sf):
    v = variants.annotated(text.read_vcf(spark, _vcf(spark, sf)), d.track(spark, sf, "F"))
    return spark.read.text(_saved(spark, sinks.vcf_lines(v, "CV", "cov"), "b.vcf")).withColumnRenamed("value", "line")


@query(f"WITH {d.TRACK_F}, {KNOTS}, {d.VARIANTS}, en AS (SELECT ref, min(pos) AS a, max(pos) AS z FROM kn GROUP BY ref), vv AS (SELECT ref, pos, max(dp) AS dp FROM variants JOIN en USING (ref) WHERE pos > a AND pos <= z GROUP BY ref, pos), al AS (SELECT ref, pos, c1, c2 FROM kn ANTI JOIN vv USING (ref, pos) UNION ALL SELECT ref, pos, NULL, dp FROM vv) SELECT ref, {_big('pos')}, CAST(coalesce(c1, lag(c2) OVER (PARTITION BY ref ORDER BY pos)) AS BIGINT) AS c1, {_big('c2')} FROM al")
def spliced_knots(spark, sf):
    return variants.spliced(signal.spans_to_knots(d.track(spark, sf, "F")), d.variants(spark, sf))


# --- intervals, genes, names


@query(f"WITH {d.TRACK_F}, {d.islands_sql('g', 'f', 'cov BETWEEN 60 AND 100')} SELECT ref, CAST(start1 - 1 AS BIGINT) AS start0, CAST(end1 - 1 AS BIGINT) AS end0, 'region' || row_number() OVER (PARTITION BY ref ORDER BY start1) AS name FROM g")
def bed_file(spark, sf):
    found = regions.regions_by_coverage(d.track(spark, sf, "F"), 60, 100)
    return text.read_bed(spark, _saved(spark, sinks.bed_lines(found), "a.bed", header="track name=regions")).select("ref", "start0", "end0", "name")


@query(f"WITH {d.FEATURES} SELECT ref, CAST(max(end0) AS BIGINT) AS length FROM features GROUP BY ref")
def lengths_file(spark, sf):
    ends = d.features(spark, sf).groupBy("ref").agg(F.max("end0").alias("start1"))
    lines = ends.select("ref", "start1", F.concat_ws("\t", "ref", F.col("start1").cast("string")).alias("line"))
    return text.read_lengths(spark, _saved(spark, lines, "a.len", header="#name\tlength")).select("ref", "length")


@query(f"WITH {d.TRACK_F} SELECT CASE ref WHEN 'chrX' THEN '23' WHEN 'chrY' THEN '24' ELSE ref END AS ref, {_big('start1', 'end1', 'cov')} FROM f")
def alias_file(spark, sf):
    lines = spark.createDataFrame([("", 1, "chrX\t23"), ("", 2, "chrY\t24")], "ref string, start1 int, line string")
    return text.renamed(d.track(spark, sf, "F"), text.read_aliases(spark, _saved(spark, lines, "a.tsv", header="# from, to")))


@query(f"WITH {d.FEATURES} SELECT gene, ref, {_big('start0', 'end0')} FROM features")
def genes_file(spark, sf):
    exons = d.features(spark, sf).groupBy("gene", "ref").agg(F.array_sort(F.collect_list(F.struct("start0", "end0"))).alias("x"))
    joined = lambda c: F.concat(F.array_join(F.transform("x", lambda e: e[c].cast("string")), ","), F.lit(","))
    table = exons.select(F.lit(0).alias("#bin"), F.col("gene").alias("name"), F.col("ref").alias("chrom"), F.lit("+").alias("strand"), joined("start0").alias("exonStarts"), joined("end0").alias("exonEnds"), F.col("gene").alias("name2"))
    return text.read_genes(spark, _sheet(spark, table, "genes.tsv")).select("gene", "ref", "start0", "end0")


@query(f"WITH {d.TRACK_F} SELECT ref, {_big('start1', 'end1', 'cov')} FROM f WHERE ref = 'chrX'")
def references_chosen(spark, sf):
    return filters.on_references(d.track(spark, sf, "F"), ["X", "chrY"], skip=["Y"])


@query("SELECT 'id' || range AS id FROM range(1000)")
def synthetic_ids(spark, sf):
    return text.synthetic_ids(spark, "id", 1000)


# --- the store and its facade


def _store(spark, sf) -> str:
    path = _place(spark, "store")
    store.write_store(signal.spans_to_knots(d.track(spark, sf, "F")), path, {"method": "PERC", "parameter": 0}, block_size=500)
    return path


STORED = NUMBERED.replace("n // 100", "n // 500")


@query(f"WITH {d.TRACK_F}, {KNOTS}, {STORED} SELECT ref, {_big('pos', 'c1', 'c2', 'block_id')} FROM bl WHERE ref = 'chrX' AND pos BETWEEN 500 AND 2000")
def store_range(spark, sf):
    return store.read_store(spark, _store(spark, sf), "chrX", 500, 2000)


@query(f"WITH {d.TRACK_F}, {KNOTS}, {STORED}, blk AS (SELECT max_by(block_id, pos) AS b FROM bl WHERE ref = 'chr1' AND pos <= 1200) SELECT ref, {_big('pos', 'c1', 'c2', 'block_id')} FROM bl, blk WHERE ref = 'chr1' AND block_id = b UNION ALL (SELECT ref, {_big('pos', 'c1', 'c2', 'block_id')} FROM bl, blk WHERE ref = 'chr1' AND block_id = b + 1 ORDER BY pos LIMIT 1)")
def store_block(spark, sf):
    path = _store(spark, sf)
    return store.load_block(spark, path, "chr1", store.block_of(spark, path, "chr1", 1200))


@query("SELECT * FROM (VALUES ('block_size', '500'), ('compression', 'zstd'), ('method', 'PERC'), ('parameter', '0')) t(key, value)")
def store_header(spark, sf):
    return store.describe(spark, _store(spark, sf))


@query(f"WITH {d.TRACK_F}, {KNOTS}, {NUMBERED}, bo AS (SELECT ref, block_id, min(pos) AS border FROM bl GROUP BY ref, block_id), ga AS (SELECT ref, lead(border) OVER (PARTITION BY ref ORDER BY block_id) - border AS gap FROM bo) SELECT ref, count(*) AS blocks, round(avg(gap), 6) AS mean_positions FROM ga GROUP BY ref")
def positions_per_block(spark, sf):
    return codec.positions_per_block(codec.block_sizes(codec.blocked(signal.spans_to_knots(d.track(spark, sf, "F")), 100)))


def _signal(spark, sf, scale=1.0):
    path = _place(spark, "compressed")
    api.compress(spark, d.track(spark, sf, "F"), path, "PERC", 0.2)
    return api.load(spark, path, scale)


@query(f"""WITH RECURSIVE {d.TRACK_F}, {lossy_sql('PERC', 'f')}, {PIECES.format(k='kn')}, {BUILT}, hit AS (SELECT ref, pos, pos - row_number() OVER (PARTITION BY ref ORDER BY pos) AS g FROM re WHERE floor(cov + 0.5) BETWEEN 60 AND 100)
SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 1 AS BIGINT) AS end1 FROM hit GROUP BY ref, g""")
def facade_regions(spark, sf):
    return _signal(spark, sf).regions(60, 100)


@query(f"WITH RECURSIVE {d.TRACK_F}, {lossy_sql('PERC', 'f')}, {PIECES.format(k='kn')}, {BUILT} SELECT ref, {_big('pos')}, round(cov, 6) AS cov FROM re WHERE ref = 'chr1' AND pos > 2000")
def facade_after(spark, sf):
    return _signal(spark, sf).after("chr1", 2000)


@query(f"""WITH RECURSIVE {d.TRACK_F}, {lossy_sql('PERC', 'f')}, {PIECES.format(k='kn')}, {d.VARIANTS}, {POINTS}
SELECT id, ref, {_big('pos')}, CASE WHEN found THEN round(cov * 2.1::DOUBLE, 6) END AS cov, CASE WHEN found THEN round(cov, 6) END AS raw, round(lower * 2.1::DOUBLE, 6) AS lower, round(upper * 2.1::DOUBLE, 6) AS upper FROM bd""")
def raw_beside_scaled(spark, sf):
    got = _signal(spark, sf, 2.1).query_all(d.variants(spark, sf).select("id", "ref", "pos"))
    return got.select("id", "ref", "pos", "cov", "raw", "lower", "upper")


@query(f"""WITH {d.TRACK_F}, {KNOTS}, {PIECES.format(k='kn')}, {d.VARIANTS}, {POINTS}
SELECT id, CASE WHEN found AND lower <> upper THEN '~' || CAST(cov AS INT) || '.00 [' || lower || '.00-' || upper || '.00]' WHEN found THEN CAST(cov AS INT) || '.00' END AS hit FROM bd WHERE found""")
def hit_texts(spark, sf):
    got = lookup.point_query(d.variants(spark, sf).select("id", "ref", "pos"), signal.spans_to_knots(d.track(spark, sf, "F")), QUANT["PERC"])
    return got.where("cov is not null").select("id", scalar.hit_text(F.col("cov"), F.col("lower"), F.col("upper")).alias("hit"))


# --- codecs both ways


@query(f"WITH {d.TRACK_F}, {KNOTS}, {NUMBERED} SELECT ref, {_big('block_id', 'pos')} FROM bl")
def delta_roundtrip(spark, sf):
    deltas = codec.delta_encoded(codec.blocked(signal.spans_to_knots(d.track(spark, sf, "F")), 100))
    w = Window.partitionBy("ref", "block_id").orderBy("pos")  # a block has a bounded number of knots
    return codec.delta_decoded(deltas.withColumn("n", F.row_number().over(w)).drop("pos")).select("ref", "block_id", "pos")


@query(f"WITH {d.EVENTS} SELECT ref, CAST(cov >= 3 AS BIGINT) AS value, count(*) AS n FROM event_signal GROUP BY ALL")
def rle_roundtrip(spark, sf):
    e = d.event_signal(spark, sf).withColumn("v", (F.col("cov") >= 3).cast("int"))
    return codec.run_length_decoded(codec.run_length_encoded(e, ["ref"], "pos", "v")).groupBy("ref", "value").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {d.TRACK_F}, {lossy_sql('PERC', 'f')}, en AS (SELECT ref, max(pos) AS pos FROM kn GROUP BY ref), inn AS (SELECT * FROM kn ANTI JOIN en USING (ref, pos))
SELECT 'coverage-values' AS name, CAST(sum(end1 - start1) AS BIGINT) AS value FROM f UNION ALL SELECT 'codewords', count(*) FROM kn
UNION ALL SELECT 'left-upper-border', count(*) FROM inn WHERE c2 > c1 UNION ALL SELECT 'left-lower-border', count(*) FROM inn WHERE c2 < c1""")
def codec_counters(spark, sf):
    f = d.track(spark, sf, "F")
    return codec.counters(f, codec.lossy_knots(f, QUANT["PERC"]))


# --- samples and tables


@query(f"WITH {MATRIX} SELECT ref, {_big('pos')}, track, round(CAST(cov AS DOUBLE), 6) AS cov FROM mx")
def matrix_file(spark, sf):
    return text.read_matrix(spark, _sheet(spark, sinks.wide(sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES), TRACK_NAMES), "m.tsv"))


@query(f"WITH {MATRIX}, ft AS (SELECT ref, pos FROM ro ORDER BY ref, pos LIMIT 20) SELECT ref, {_big('pos', 'cov')}, track FROM mx SEMI JOIN ft USING (ref, pos)")
def window_limit(spark, sf):
    return sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES, limit=20)


SAMPLE = f"{d.TRACK_F}, {d.dense_sql('x', 'f')}, sm AS (SELECT ref, pos, cov FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) AS rn FROM x) WHERE (rn - 1) % 7 = 0)"


@query(f"WITH {SAMPLE} SELECT ref, CAST(pos AS BIGINT) AS start1, CAST(pos + 1 AS BIGINT) AS end1, CAST(cov AS DOUBLE) AS cov FROM sm")
def sample_as_text(spark, sf):
    path = _place(spark, "a.txt")
    reports.write_sample(sampling.every_nth(d.track(spark, sf, "F"), 7), path, "raw", 7)
    return text.read_signal(spark, path)


@query(f"""WITH {SAMPLE}, rn AS (SELECT *, sum(fresh) OVER (PARTITION BY ref ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(pos) OVER o = pos - 7 AND lag(cov) OVER o = cov THEN 0 ELSE 1 END AS fresh FROM sm WINDOW o AS (PARTITION BY ref ORDER BY pos)))
SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 7 AS BIGINT) AS end1, CAST(any_value(cov) AS DOUBLE) AS cov FROM rn GROUP BY ref, run""")
def sample_as_wig(spark, sf):
    path = _place(spark, "a.wig")
    reports.write_sample(sampling.every_nth(d.track(spark, sf, "F"), 7), path, "wig", 7)
    return text.read_signal(spark, path)


@query(f"WITH {SAMPLE} SELECT ref, count(*) AS n, CAST(sum(cov) AS BIGINT) AS total FROM sm WHERE cov > 0 GROUP BY ref")
def sample_as_store(spark, sf):
    path = _place(spark, "store")
    reports.write_sample(sampling.every_nth(d.track(spark, sf, "F"), 7), path, "store", 7)
    at = store.read_store(spark, path).where("c2 > 0")
    # a knot stands wherever the value changes, so equal neighbours are counted from what lies between knots
    points = sampling.every_nth(d.track(spark, sf, "F"), 7).where("cov > 0").select("ref", "pos", "cov")
    found = lookup.point_query(points.select("ref", "pos"), store.read_store(spark, path).select("ref", "pos", "c1", "c2")).select("ref", "pos", "cov")
    return found.join(at.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.count("*").alias("n"), F.sum(F.round("cov").cast("long")).alias("total"))


# --- reports


def _dec(x: str, digits: int) -> str:
    return f"CAST(CAST(round({x}, {digits}) AS DECIMAL(38, {digits})) AS VARCHAR)"


@query(f"""WITH {PAIR}, c AS (SELECT count(*) AS n, CAST(sum(a) AS BIGINT) AS sx, CAST(sum(b) AS BIGINT) AS sy, CAST(sum(a * b) AS BIGINT) AS sxy, avg(a) AS mx, avg(b) AS my, stddev_samp(a) AS dx, stddev_samp(b) AS dy, corr(a, b) AS r FROM xy)
SELECT unnest(['N' || chr(9) || n, 'sumX' || chr(9) || sx, 'sumY' || chr(9) || sy, 'sumXY' || chr(9) || sxy, 'meanX' || chr(9) || {_dec('mx', 6)}, 'meanY' || chr(9) || {_dec('my', 6)}, 'stddevX' || chr(9) || {_dec('dx', 6)}, 'stddevY' || chr(9) || {_dec('dy', 6)}, 'corr r' || chr(9) || {_dec('r', 6)}]) AS line FROM c""")
def correlation_file(spark, sf):
    lines = reports.correlation_lines(combine.correlation(d.track(spark, sf, "F"), d.track(spark, sf, "O")))
    return spark.read.text(_saved(spark, lines, "corr.txt")).withColumnRenamed("value", "line")


@query(f"""WITH {d.TRACK_F}, {d.VARIANTS}, a AS (SELECT DISTINCT ref, pos FROM variants WHERE filter IN ('PASS', '.')), h AS (SELECT a.ref, f.cov // 10 * 10 AS bin FROM a JOIN f ON f.ref = a.ref AND a.pos >= start1 AND a.pos < end1)
SELECT concat_ws(chr(9), CASE WHEN grouping(ref) = 1 THEN 'ALL' ELSE ref END, bin, count(*)) AS line FROM h GROUP BY GROUPING SETS ((ref, bin), (bin))""")
def variant_hist_file(spark, sf):
    lines = reports.histogram_lines(variants.histogram_at_variants(d.variants(spark, sf), d.track(spark, sf, "F"), 10))
    return spark.read.text(_saved(spark, lines, "hist.tsv")).withColumnRenamed("value", "line")


FEATURE_MEANS = "me AS (SELECT feature_id, track, sum(s.cov * (least(s.end1, f.end0 + 1) - greatest(s.start1, f.start0 + 1))) / any_value(f.end0 - f.start0)::DOUBLE AS m FROM features f JOIN s ON s.ref = f.ref AND s.start1 < f.end0 + 1 AND s.end1 > f.start0 + 1 GROUP BY feature_id, track), wd AS (SELECT feature_id, max(m) FILTER (track = 'F') AS mf, max(m) FILTER (track = 'O') AS mo FROM me GROUP BY feature_id)"
_FT = ", ".join(f"CASE WHEN wd.feature_id IS NULL THEN '-1.0' ELSE {_dec(f'coalesce({c}, 0)', 1)} END" for c in ("mf", "mo"))


@query(f"""WITH {d.READS}, {d.spans_sql('s', 'reads', 'track, ref')}, {d.FEATURES}, {FEATURE_MEANS}
SELECT concat_ws(chr(9), q.ref, q.start0 + 1, q.end0, q.feature_id, q.end0 - q.start0, {_FT}) AS line FROM features q LEFT JOIN wd USING (feature_id) UNION ALL SELECT '#chr' || chr(9) || 'min' || chr(9) || 'max' || chr(9) || 'name' || chr(9) || 'width' || chr(9) || 'avg.cov (F)' || chr(9) || 'avg.cov (O)'""")
def feature_file(spark, sf):
    lines = reports.feature_lines(d.features(spark, sf), signal.pileup(d.reads(spark, sf), ("track",)), ["F", "O"])
    path = _saved(spark, lines, "features.tsv", header=reports.feature_header(["F", "O"]))
    return spark.read.text(path).withColumnRenamed("value", "line")


NORM = "rs AS (SELECT ref, pos, avg(norm) AS mean, coalesce(stddev_samp(norm), 0) AS sd, min(norm) AS mi, max(norm) AS ma FROM nm GROUP BY ref, pos)"
_CELLS = ", ".join(f"coalesce(CAST(max(nm.cov) FILTER (track = '{t}') AS VARCHAR), '')" for t in TRACK_NAMES) + ", " + ", ".join(f"coalesce({_dec(f'max(norm) FILTER (track = {chr(39)}{t}{chr(39)})', 4)}, '')" for t in TRACK_NAMES)


@query(f"""WITH {MATRIX}, {NORM} SELECT concat_ws(chr(9), nm.ref || ':' || nm.pos, {_CELLS}, {_dec('any_value(mean)', 4)}, {_dec('any_value(sd)', 4)}) AS line FROM nm JOIN rs USING (ref, pos) GROUP BY nm.ref, nm.pos
UNION ALL SELECT unnest(['# Normalized.', concat_ws(chr(9), 'Pos', '0', '1', '2', '3', '4', '0-NORM', '1-NORM', '2-NORM', '3-NORM', '4-NORM', 'Mean', 'SD')])""")
def normalized_file(spark, sf):
    lines = reports.normalized_lines(sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES), TRACK_NAMES)
    return spark.read.text(_saved(spark, lines, "m.norm", header=reports.normalized_header(TRACK_NAMES))).withColumnRenamed("value", "line")


FENCES = f"""g AS (SELECT ref, pos, list_sort(list(norm) FILTER (norm IS NOT NULL)) AS v, count(norm) AS n FROM nm GROUP BY ref, pos),
q AS (SELECT ref, pos, {_legacy(0.25)} AS q1, {_legacy(0.75)} AS q3 FROM g), fe AS (SELECT ref, pos, greatest(0, q3 + 1.5 * (q3 - q1)) AS upper, greatest(0, q1 - 1.5 * (q3 - q1)) AS lower FROM q)"""


@query(f"""WITH {MATRIX}, {NORM}, {FENCES} SELECT concat_ws(chr(9), nm.ref, nm.pos, nm.pos + 49, CASE WHEN norm > upper THEN 'GAIN' ELSE 'LOSS' END || '-' || track) AS line FROM nm JOIN fe USING (ref, pos) WHERE norm > upper OR norm < lower""")
def extremes_file(spark, sf):
    path = _place(spark, "norm")
    reports.write_normalized(sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES), 50, TRACK_NAMES, path)
    return spark.read.text(f"{path}/extremes.bed").withColumnRenamed("value", "line")


@query(f"""WITH {MATRIX}, {NORM}, {FENCES} SELECT ref, CAST(pos AS BIGINT) AS start1, CAST(pos + 50 AS BIGINT) AS end1, metric, round(cov, 6) AS cov
FROM (SELECT ref, pos, unnest(['mean', 'min', 'max', 'SD', 'upper', 'lower']) AS metric, unnest([mean, mi, ma, sd, upper, lower]) AS cov FROM rs JOIN fe USING (ref, pos)) WHERE cov IS NOT NULL""")
def metric_signals(spark, sf):
    return reports.metric_spans(sampling.matrix(d.tracks(spark, sf), 50, TRACK_NAMES), 50)


COMMON = f"""{d.TRACKS}, {d.dense_sql('x', '(SELECT * FROM t WHERE cov >= 30 + CAST(track AS INT))', 'track, ref')}, dp AS (SELECT ref, pos, count(*) AS n FROM x GROUP BY ref, pos), c AS (SELECT ref, pos FROM dp WHERE n = 5),
gi AS (SELECT ref, min(pos) AS start1, max(pos) + 1 AS end1 FROM (SELECT *, pos - row_number() OVER (PARTITION BY ref ORDER BY pos) AS g FROM c) GROUP BY ref, g)"""
MINIMUM = {str(i): 30 + i for i in range(5)}


@query(f"WITH {COMMON} SELECT ref, CAST(start1 - 1 AS BIGINT) AS start0, CAST(end1 - 1 AS BIGINT) AS end0, 'int' || row_number() OVER (ORDER BY ref, start1) AS name FROM gi")
def min_covered_files(spark, sf):
    path = _place(spark, "min")
    reports.write_min_covered(d.tracks(spark, sf), "track", MINIMUM, path)
    return text.read_bed(spark, f"{path}/Intersect.minCov-30-31-32-33-34.bed").select("ref", "start0", "end0", "name")


@query(f"WITH {COMMON}, v AS (SELECT ref, pos, CAST(n = 5 AS BIGINT) AS cov FROM dp) SELECT ref, CAST(min(pos) AS BIGINT) AS start1, CAST(max(pos) + 1 AS BIGINT) AS end1, CAST(cov AS DOUBLE) AS cov FROM (SELECT *, pos - row_number() OVER (PARTITION BY ref, cov ORDER BY pos) AS g FROM v) GROUP BY ref, cov, g")
def min_covered_wig(spark, sf):
    own, common = regions.min_covered(d.tracks(spark, sf), "track", MINIMUM)
    return text.read_signal(spark, _saved(spark, sinks.wig_lines(reports.zero_one(own, common)), "a.wig"))


@query(f"""WITH {COMMON}, {d.FEATURES}, o AS (SELECT feature_id, coalesce(sum(least(gi.end1, q.end0 + 1) - greatest(gi.start1, q.start0 + 1)) FILTER (gi.ref IS NOT NULL), 0) AS covered FROM features q LEFT JOIN gi ON gi.ref = q.ref AND gi.start1 < q.end0 + 1 AND gi.end1 > q.start0 + 1 GROUP BY feature_id)
SELECT concat_ws(chr(9), ref, start0, end0, feature_id, covered, end0 - start0, {_dec('covered / (end0 - start0)::DOUBLE', 4)}) AS line FROM features JOIN o USING (feature_id)""")
def scope_file(spark, sf):
    scope = d.features(spark, sf).select("ref", "start0", "end0", F.col("feature_id").cast("string").alias("name"))
    common = regions.min_covered(d.tracks(spark, sf), "track", MINIMUM)[1]
    return spark.read.text(_saved(spark, reports.scope_lines(scope, common), "scope.tsv")).withColumnRenamed("value", "line")


@query(f"""WITH {d.TRACK_F}, {HIST} SELECT 'median-' || category || chr(9) || median AS line FROM md UNION ALL SELECT 'positions' || chr(9) || CAST(sum(n) AS BIGINT) FROM hi""")
def stats_file(spark, sf):
    h = stats.histogram(d.track(spark, sf, "F"))
    rows = stats.medians(h).select(F.concat(F.lit("median-"), "category").alias("name"), F.col("median").alias("value")).unionByName(h.agg(F.sum("n").alias("value")).select(F.lit("positions").alias("name"), "value"))
    return spark.read.text(_saved(spark, reports.key_value_lines(rows), "a.stats")).withColumnRenamed("value", "line")


# --- scalars


@query(f"""WITH {d.READS}, q AS (SELECT DISTINCT CAST(end1 - start1 AS BIGINT) AS cov FROM reads) SELECT cov, CAST(pow(2, cov) AS BIGINT) AS power, CAST(floor(log2(cov) + 0.5) AS BIGINT) AS rounded, CAST(floor(log2(cov)) AS BIGINT) AS floored,
CASE WHEN cov % 2 = 0 THEN CAST(cov AS DOUBLE) ELSE 0.0 END AS filled, CASE WHEN cov % 2 = 0 THEN cov || '.0' ELSE 'n/a' END AS shown, 'chr' || cov AS name, {HIGH['GRID']} AS grid_hi, {LOW['LOG2']} AS log2_lo FROM q""")
def scalar_functions(spark, sf):
    q = d.reads(spark, sf).select((F.col("end1") - F.col("start1")).cast("long").alias("cov")).distinct()
    even, c = F.when(F.col("cov") % 2 == 0, F.col("cov")), F.col("cov")
    return q.select(
        "cov", scalar.pow2(c).alias("power"), scalar.log2_rounded(c).alias("rounded"), scalar.log2_floored(c).alias("floored"), scalar.zero_if_missing(even).alias("filled"), scalar.formatted(even).alias("shown"),
        scalar.prefixed(scalar.prefixed(c.cast("string"))).alias("name"), quantize.quantizer("grid", 5).upper(c).alias("grid_hi"), quantize.quantizer("Log2").lower(c).alias("log2_lo"),
    )


@query(f"""WITH {d.READS}, {d.spans_sql('s', 'reads', 'track, ref')}, {d.FEATURES}, {d.dense_sql('x', 's', 'track, ref')}, i AS (SELECT DISTINCT ref, unnest(range(start0 + 1, end0 + 1)) AS pos FROM features)
SELECT '# Overall average score: ' || {_dec('avg(cov)', 6)} || ' in ' || count(*) || ' positions' AS line FROM x JOIN i USING (ref, pos)""")
def feature_trailer(spark, sf):
    got = features.coverage_overall(d.features(spark, sf), signal.pileup(d.reads(spark, sf), ("track",)), ("track",))
    one = got.agg(F.sum("positions").alias("positions"), (F.sum(F.col("mean_cov") * F.col("positions")) / F.sum("positions")).alias("mean_cov"))
    return spark.createDataFrame([(reports.feature_trailer(one.withColumn("mean_cov", reports.fixed(F.col("mean_cov"), 6))),)], "line string")
