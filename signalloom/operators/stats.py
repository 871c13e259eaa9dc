"""Statistics of signals, histograms and the track matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import category
from .signal import half_up
from .windows import TILE, running_total, with_neighbours


def _n():
    return (F.col("end1") - F.col("start1")).cast("long")


def per_reference(spans: DataFrame) -> DataFrame:
    """Positions and positions of coverage 0 by reference, least and greatest coverage; and over all (ref ALL)."""
    g = spans.groupingSets([["ref"], []], "ref").agg(F.sum(_n()).alias("positions"), F.sum(F.when(F.col("cov") == 0, _n()).otherwise(0)).cast("long").alias("zero"), F.min("cov").alias("min_cov"), F.max("cov").alias("max_cov"), F.grouping("ref").alias("g"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("ref")).alias("ref"), "positions", "zero", "min_cov", "max_cov")


def per_category(spans: DataFrame) -> DataFrame:
    """Mean coverage and positions of autosomes, X and Y."""
    total = F.sum(F.col("cov").cast("double") * _n())
    return spans.groupBy(category(F.col("ref")).alias("category")).agg((total / F.sum(_n())).alias("mean_cov"), F.sum(_n()).alias("positions"))


def histogram(spans: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """(by, cov, n): exact counts of positions by rounded coverage."""
    src = spans.withColumn("category", category(F.col("ref"))) if "category" in by else spans
    return src.groupBy(*by, half_up(F.col("cov")).cast("long").alias("cov")).agg(F.sum(_n()).alias("n"))


def medians(hist: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Lower median of a histogram (by, cov, n). A histogram has a row for each value that occurs."""
    w = Window.partitionBy(*by).orderBy("cov")
    run = hist.withColumns({"_r": F.sum("n").over(w), "_t": F.sum("n").over(Window.partitionBy(*by))})
    return run.where(2 * F.col("_r") >= F.col("_t")).groupBy(*by).agg(F.min("cov").alias("median"))


def histogram_json(hist: DataFrame) -> DataFrame:
    """One row with histogram-autosomes, -X, -Y as {bins, counts} and their medians, as JSON."""
    rows = hist.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("cov", "n"))).alias("h"))
    rows = rows.join(medians(hist), "category")
    names = {"AUTOSOME": "autosomes", "X": "X", "Y": "Y"}
    cols = []
    for cat, name in names.items():
        mine = F.col("category") == cat
        h = F.first(F.when(mine, F.col("h")), ignorenulls=True)
        cols += [F.struct(h["cov"].alias("bins"), h["n"].alias("counts")).alias(f"histogram-{name}"), F.first(F.when(mine, F.col("median")), ignorenulls=True).alias(f"median-{name}")]
    one = rows.agg(*cols)
    return one.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in one.columns])).alias("json"))


def normalized(matrix: DataFrame) -> DataFrame:
    """matrix(ref, pos, track, cov) with norm: the value over its track's mean."""
    means = matrix.groupBy("track").agg(F.avg("cov").alias("_mean"))
    return matrix.join(means, "track").withColumn("norm", F.col("cov") / F.col("_mean")).drop("_mean")


def row_statistics(matrix: DataFrame) -> DataFrame:
    """Mean, min, max and sample deviation (0 for one track) of norm at each position."""
    return matrix.groupBy("ref", "pos").agg(F.avg("norm").alias("mean"), F.min("norm").alias("min"), F.max("norm").alias("max"), F.coalesce(F.stddev_samp("norm"), F.lit(0.0)).alias("sd"))


def legacy_percentile(values, p: float):
    """Percentile of an array at p (n + 1) / 100, between neighbours; ends beyond."""
    x = F.array_sort(values)
    n = F.size(x)
    h = (n + 1) * F.lit(p / 100.0)
    i = F.floor(h).cast("int")
    lo = F.element_at(x, F.greatest(F.lit(1), F.least(i, n)))
    hi = F.element_at(x, F.greatest(F.lit(1), F.least(i + 1, n)))
    return F.when(h < 1, F.element_at(x, 1)).when(h >= n, F.element_at(x, -1)).otherwise(lo + (h - i) * (hi - lo))


def tukey(matrix: DataFrame) -> DataFrame:
    """(ref, pos, track, norm, lower, upper, call): fences of 1.5 interquartile ranges, not below 0; GAIN above, LOSS below.
    A position has one value a track, so its array is as short as the list of tracks."""
    rows = matrix.groupBy("ref", "pos").agg(F.collect_list("norm").alias("v"), F.collect_list(F.struct("track", "norm")).alias("t"))
    q1, q3 = legacy_percentile(F.col("v"), 25), legacy_percentile(F.col("v"), 75)
    rows = rows.withColumns({"q1": q1, "q3": q3})
    rows = rows.withColumns({"upper": F.greatest(F.lit(0.0), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))), "lower": F.greatest(F.lit(0.0), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))})
    out = rows.select("ref", "pos", "lower", "upper", F.explode("t").alias("x")).select("ref", "pos", "x.track", "x.norm", "lower", "upper")
    return out.withColumn("call", F.when(F.col("norm") > F.col("upper"), "GAIN").when(F.col("norm") < F.col("lower"), "LOSS"))


def midmean_gap(starts: DataFrame, by: Sequence[str] = ("ref",), limit: int | None = None, tile: int = TILE) -> DataFrame:
    """Mean of the middle half of the distances between neighbouring starts: ranks from n/4 up to 3n/4.

    Distances are counted by value first, so ranks come from a histogram and no group is sorted whole.
    limit takes only the first records in order of position, as an estimate from a sample."""
    keys = list(by)
    src = starts
    if limit is not None:
        src = starts.orderBy(*keys, "start1").limit(limit)
    counted = src.groupBy(*keys, "start1").agg(F.count("*").alias("_n"))
    near = with_neighbours(counted, keys, "start1", before={"_p": "start1"}, tile=tile)
    same = near.select(F.lit(0).cast("long").alias("gap"), (F.col("_n") - 1).alias("m"))
    step = near.where("_p is not null").select((F.col("start1") - F.col("_p")).cast("long").alias("gap"), F.lit(1).cast("long").alias("m"))
    hist = same.unionByName(step).groupBy("gap").agg(F.sum("m").alias("m")).where("m > 0")
    run, total = running_total(hist, "gap", "m", "hi")  # one row a distinct distance
    a, z = F.lit(math.floor(total * 0.25)), F.lit(math.floor(total * 0.75))
    take = F.greatest(F.lit(0), F.least("hi", z) - F.greatest(F.col("hi") - F.col("m"), a))
    return run.select("gap", take.alias("take")).agg((F.sum(F.col("gap") * F.col("take")) / F.sum("take")).alias("mean_gap"))
