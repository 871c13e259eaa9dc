"""Text reports of results: lines with a place (ref, start1), for sinks.write_lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import genomic_order
from ..operators import features, regions, stats
from ..operators.signal import half_up, merged, spans_to_knots
from . import sinks, store


def fixed(x, digits: int) -> Column:
    """A number with so many digits after the point, rounded half away from 0."""
    return F.round(x.cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")


def key_value_lines(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """`name <tab> value`, in the order of names: the statistics of a build, or any other list."""
    return rows.select(F.col(name).alias("ref"), F.lit(0).alias("start1"), F.concat_ws("\t", F.col(name), F.col(value).cast("string")).alias("line"))


#: Lines of the correlation report, and the columns that they show. Fixed values.
CORRELATION = (("N", "n"), ("sumX", "sum_x"), ("sumY", "sum_y"), ("sumXY", "sum_xy"), ("meanX", "mean_x"), ("meanY", "mean_y"), ("stddevX", "sd_x"), ("stddevY", "sd_y"), ("corr r", "r"))


def correlation_lines(result: DataFrame, digits: int = 6) -> DataFrame:
    """Nine lines `name <tab> value` of combine.correlation, in their order."""
    text = lambda c: F.col(c).cast("string") if dict(result.dtypes)[c] == "bigint" else fixed(F.col(c), digits)
    items = F.array(*[F.struct(F.lit(i).alias("start1"), F.concat_ws("\t", F.lit(name), F.coalesce(text(c), F.lit("NaN"))).alias("line")) for i, (name, c) in enumerate(CORRELATION)])
    return result.select(F.explode(items).alias("x")).select(F.lit("").alias("ref"), "x.start1", "x.line")


def histogram_lines(hist: DataFrame) -> DataFrame:
    """`ref <tab> bin <tab> n` of variants.histogram_at_variants: all references together first, then each by name."""
    return hist.select(F.when(F.col("ref") == "ALL", F.lit("")).otherwise(F.col("ref")).alias("ref"), F.col("bin").alias("start1"), F.concat_ws("\t", "ref", F.col("bin").cast("string"), F.col("n").cast("string")).alias("line"))


def feature_header(tracks: Sequence[str]) -> str:
    return "\t".join(["#chr", "min", "max", "name", "width", *(f"avg.cov ({t})" for t in tracks)])


def feature_lines(intervals: DataFrame, spans: DataFrame, tracks: Sequence[str], track: str = "track", key: str = "feature_id") -> DataFrame:
    """A line a feature: reference, first and last base (1-based), name, width, and its mean coverage in each track with one
    digit; -1.0 for features that no track covers, 0.0 in a track that does not cover one that another does."""
    means = features.coverage_per_feature(intervals, spans, (track,), key).groupBy(key).pivot(track, list(tracks)).agg(F.first("mean_cov"))
    rows = intervals.join(means.withColumn("_found", F.lit(True)), key, "left")
    cells = [F.when(F.col("_found"), fixed(F.coalesce(F.col(f"`{t}`"), F.lit(0.0)), 1)).otherwise(F.lit("-1.0")) for t in tracks]
    text = F.concat_ws("\t", "ref", (F.col("start0") + 1).cast("string"), F.col("end0").cast("string"), F.col(key).cast("string"), (F.col("end0") - F.col("start0")).cast("string"), *cells)
    return rows.select("ref", (F.col("start0") + 1).alias("start1"), text.alias("line"))


def feature_trailer(overall: DataFrame) -> str:
    """The last line of the feature report, from features.coverage_overall over all tracks (one row)."""
    r = overall.first()
    return f"# Overall average score: {r['mean_cov'] if r else None} in {r['positions'] if r else 0} positions"


def sorted_lines(lines: DataFrame) -> DataFrame:
    """Lines in genomic order of (ref, start1)."""
    at = lines.withColumn("_o", genomic_order(F.col("ref"))).select(F.col("_o.rank").alias("_o1"), F.col("_o.number").alias("_o2"), F.col("_o.name").alias("_o3"), "start1", "line")
    return at.orderBy("_o1", "_o2", "_o3", "start1", "line").select("line")


def normalized_lines(matrix: DataFrame, tracks: Sequence[str], digits: int = 4) -> DataFrame:
    """`Pos`, the tracks' values, their values over the track's mean, mean and deviation of these; missing ones are empty."""
    m = stats.normalized(matrix)
    at = m.groupBy("ref", "pos").pivot("track", list(tracks)).agg(F.first("cov").alias("cov"), F.first("norm").alias("norm"))
    rows = at.join(stats.row_statistics(m), ["ref", "pos"])
    cell = lambda c: F.coalesce(fixed(c, digits), F.lit(""))
    raw = [F.coalesce(F.col(f"`{t}_cov`").cast("string"), F.lit("")) for t in tracks]
    cells = [*raw, *(cell(F.col(f"`{t}_norm`")) for t in tracks), cell(F.col("mean")), cell(F.col("sd"))]
    return rows.select("ref", F.col("pos").alias("start1"), F.concat_ws("\t", F.concat("ref", F.lit(":"), F.col("pos").cast("string")), *cells).alias("line"))


def normalized_header(tracks: Sequence[str]) -> str:
    return "# Normalized.\n" + "\t".join(["Pos", *tracks, *(f"{t}-NORM" for t in tracks), "Mean", "SD"])


def metric_spans(matrix: DataFrame, win: int) -> DataFrame:
    """(metric, ref, start1, end1, cov): mean, min, max, SD, upper and lower fence of each window."""
    m = stats.normalized(matrix)
    fences = stats.tukey(m).groupBy("ref", "pos").agg(F.first("upper").alias("upper"), F.first("lower").alias("lower"))
    rows = stats.row_statistics(m).join(fences, ["ref", "pos"])
    names = {"mean": "mean", "min": "min", "max": "max", "SD": "sd", "upper": "upper", "lower": "lower"}
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("cov")) for k, c in names.items()])).alias("x")
    return rows.select("ref", F.col("pos").alias("start1"), (F.col("pos") + win).alias("end1"), x).select("x.metric", "ref", "start1", "end1", "x.cov").where("cov is not null")


def extreme_lines(matrix: DataFrame, win: int, tracks: Sequence[str]) -> DataFrame:
    """`ref <tab> first <tab> last <tab> GAIN-i or LOSS-i` of each window and track outside the fences, i its place among tracks."""
    out = stats.tukey(stats.normalized(matrix)).where("call is not null")
    place = F.array_position(F.lit(list(tracks)), F.col("track")) - 1
    text = F.concat_ws("\t", "ref", F.col("pos").cast("string"), (F.col("pos") + (win - 1)).cast("string"), F.concat_ws("-", "call", place.cast("string")))
    return out.select("ref", F.col("pos").alias("start1"), text.alias("line"))


def wig_values(spans: DataFrame, digits: int = 4) -> DataFrame:
    """variableStep lines of values with so many digits."""
    text = F.concat(F.lit("variableStep chrom="), "ref", F.lit(" span="), (F.col("end1") - F.col("start1")).cast("string"), F.lit("\n"), F.col("start1").cast("string"), F.lit(" "), fixed(F.col("cov"), digits))
    return spans.select("ref", "start1", text.alias("line"))


def write_normalized(matrix: DataFrame, win: int, tracks: Sequence[str], path: str) -> None:
    """A folder each: norm (the table), mean, min, max, SD, upper and lower (WIG), and extremes (BED)."""
    sinks.write_lines(normalized_lines(matrix, tracks), f"{path}/norm", normalized_header(tracks))
    metrics = metric_spans(matrix, win)
    for name in ("mean", "min", "max", "SD", "upper", "lower"):
        sinks.write_lines(wig_values(metrics.where(F.col("metric") == name)), f"{path}/{name}.wig", "track type=wiggle_0")
    sinks.write_lines(extreme_lines(matrix, win, tracks), f"{path}/extremes.bed")


def write_sample(dense: DataFrame, path: str, kind: str = "raw", step: int = 1) -> None:
    """A sample of positions as three columns (raw), as a WIG of spans of `step`, or as a store of knots."""
    if kind not in ("raw", "wig", "store"):
        raise ValueError(f"unknown kind of sample {kind!r}")
    spans = dense.select("ref", F.col("pos").alias("start1"), (F.col("pos") + step).alias("end1"), "cov")
    if kind == "raw":
        sinks.write_lines(sinks.coverage_lines(dense), path, f"# Sampled positions with step {step}")
    elif kind == "wig":
        sinks.write_lines(sinks.wig_lines(spans), path, "track type=wiggle_0")
    else:
        whole = spans.withColumn("end1", F.col("start1") + 1).withColumn("cov", half_up(F.col("cov")).cast("long"))
        store.write_store(spans_to_knots(merged(whole)), path, {"step": str(step)})


def intersection_lines(common: DataFrame) -> DataFrame:
    """BED lines named int1, int2, ... along all references in genomic order."""
    from ..operators.windows import running_total

    at = common.withColumn("_at", F.struct(genomic_order(F.col("ref")).alias("o"), "start1")).withColumn("_one", F.lit(1).cast("long"))
    numbered, _ = running_total(at, "_at", "_one", "_n")
    text = F.concat_ws("\t", "ref", (F.col("start1") - 1).cast("string"), (F.col("end1") - 1).cast("string"), F.concat(F.lit("int"), F.col("_n").cast("string")))
    return numbered.select("ref", "start1", text.alias("line"))


def scope_lines(scope: DataFrame, common: DataFrame) -> DataFrame:
    """`ref, start, end, name, covered bases, width, share` of each scope(ref, start0, end0, name)."""
    got = regions.scope_overlap(scope, common)
    width = F.col("end1") - F.col("start1")
    text = F.concat_ws("\t", "ref", (F.col("start1") - 1).cast("string"), (F.col("end1") - 1).cast("string"), "name", F.col("covered").cast("string"), width.cast("string"), fixed(F.col("share"), 4))
    return got.select("ref", "start1", text.alias("line"))


def write_min_covered(spans: DataFrame, track: str, minimum: dict, path: str, scopes: dict[str, DataFrame] | None = None, wig: bool = False) -> None:
    """A BED folder a track, one of the intersection, a 0/1 WIG of it if asked for, and a table for each scope."""
    own, common = regions.min_covered(spans, track, minimum)
    for name, least in minimum.items():
        sinks.write_lines(sinks.bed_lines(own.where(F.col(track) == name)), f"{path}/{name}.minCov{least}.bed")
    mark = "-".join(str(x) for x in minimum.values())
    sinks.write_lines(intersection_lines(common), f"{path}/Intersect.minCov-{mark}.bed")
    if wig:
        sinks.write_lines(sinks.wig_lines(zero_one(own, common)), f"{path}/Intersect.minCov-{mark}.wig", "track type=wiggle_0")
    for name, scope in (scopes or {}).items():
        sinks.write_lines(scope_lines(scope, common), f"{path}/Coverage.{name}.tsv")


def zero_one(own: DataFrame, common: DataFrame) -> DataFrame:
    """1 where all tracks are covered, 0 where only some are."""
    some = regions.islands_of(own.select("ref", "start1", "end1"))
    both = some.select("ref", "start1", "end1", F.lit(1).alias("w")).unionByName(common.select("ref", "start1", "end1", F.lit(1).alias("w")))
    from ..operators.signal import pileup

    depth = pileup(both, weight=F.col("w")).where("cov > 0")
    return depth.select("ref", "start1", "end1", (F.col("cov") - 1).alias("cov"))
