"""Coverage per feature and per gene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import BIN, overlaps
from .regions import in_regions


def _totals(intervals: DataFrame, spans: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """(ref, lo, hi, by, total, covered): sum of coverage and bases with coverage in each different interval(ref, lo, hi)
    that spans meet.

    An interval of more than `width` positions meets spans at its two ends only; in between it takes the sums of whole bins. So
    its cost is bounded by its ends and its bins, however many spans and other intervals lie in it.
    """
    f = intervals.where("hi > lo").select("ref", "lo", "hi").distinct()
    size, first, last = F.col("hi") - F.col("lo"), F.ceil(F.col("lo") / width), F.floor(F.col("hi") / width)
    part = lambda a, z: F.struct(a.cast("long").alias("a"), z.cast("long").alias("z"))
    lo, hi = F.col("lo"), F.col("hi")
    ends = F.when(size <= width, F.array(part(lo, hi))).otherwise(F.array(part(lo, first * width), part(last * width, hi)))
    at_ends = f.select("ref", "lo", "hi", F.explode(ends).alias("e")).select("ref", "lo", "hi", "e.a", "e.z")
    near = overlaps(spans, at_ends, b_range=("a", "z"), width=width)
    inside = f.where(size > width).select("ref", "lo", "hi", first.alias("a"), last.alias("z"))
    far = overlaps(_bins(spans, by, width), inside, b_range=("a", "z"), width=width)
    keys = ["ref", "lo", "hi", *by]
    hit = near.select(*keys, *_sums(F.col("overlap"))).unionByName(far.select(*keys, "total", "covered"))
    return hit.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))


def _sums(n):
    """Sum of coverage over n bases, and those of them that have coverage."""
    return (F.col("cov").cast("double") * n).alias("total"), F.when(F.col("cov") > 0, n).otherwise(0).cast("long").alias("covered")


def _bins(spans: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """(by, ref, start1, end1, total, covered): sums of each bin of `width` positions that spans meet; it is one position, start1."""
    cut = spans.where("end1 > start1").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start1") / width), F.floor((F.col("end1") - 1) / width))))
    n = F.least(F.col("end1"), (F.col("_bin") + 1) * width) - F.greatest(F.col("start1"), F.col("_bin") * width)
    sums = cut.select(*by, "ref", "_bin", *_sums(n)).groupBy(*by, "ref", "_bin").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))
    return sums.select(*by, "ref", F.col("_bin").alias("start1"), (F.col("_bin") + 1).alias("end1"), "total", "covered")


def coverage_per_feature(features: DataFrame, spans: DataFrame, by: Sequence[str] = (), key: str = "feature_id", width: int = BIN) -> DataFrame:
    """Mean coverage of each feature(key, ref, start0, end0) in each track: sum over its bases / its width.

    Uncovered bases count as 0. Features that a track nowhere covers have no row for it (see with_missing).
    Cost follows spans and features, not positions; features on the same bases share their sums.
    """
    f = features.select(key, "ref", (F.col("start0") + 1).alias("lo"), (F.col("end0") + 1).alias("hi"))
    hit = f.join(_totals(f, spans, by, width), ["ref", "lo", "hi"])
    return hit.groupBy(key, *by).agg((F.sum("total") / F.first(F.col("hi") - F.col("lo"))).alias("mean_cov"))


def with_missing(features: DataFrame, means: DataFrame, key: str = "feature_id", missing: float = 0.0) -> DataFrame:
    """All features, those without a mean with `missing`."""
    return features.join(means, key, "left").withColumn("mean_cov", F.coalesce("mean_cov", F.lit(missing)))


def coverage_overall(features: DataFrame, spans: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """Positions in any feature, each once, and their mean coverage."""
    inside = in_regions(spans, features, by, width)
    n = F.col("end1") - F.col("start1")
    out = inside.groupBy(*by).agg(F.sum(n).cast("long").alias("positions"), F.sum(F.col("cov").cast("double") * n).alias("total"))
    return out.withColumn("mean_cov", F.col("total") / F.col("positions")).drop("total")


def coverage_per_gene(exons: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """For exons(gene, ref, start0, end0): exon bases, mean coverage over them, and the share without coverage."""
    e = exons.select("gene", "ref", (F.col("start0") + 1).alias("lo"), (F.col("end0") + 1).alias("hi"))
    sizes = e.groupBy("gene").agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("bases"))
    hit = e.join(_totals(e, spans, width=width), ["ref", "lo", "hi"]).groupBy("gene").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))
    out = sizes.join(hit, "gene", "left")
    return out.select("gene", "bases", (F.coalesce("total", F.lit(0.0)) / F.col("bases")).alias("mean_cov"), (1 - F.coalesce("covered", F.lit(0)) / F.col("bases")).alias("uncovered"))
