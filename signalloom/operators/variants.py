"""Variants against signals and against other variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import BIN, points_in_spans
from .signal import half_up, merged
from .windows import TILE, with_neighbours


def annotated(variants: DataFrame, spans: DataFrame, field: str = "cov", width: int = BIN) -> DataFrame:
    """Variants with the coverage at their position, null where there is none."""
    return points_in_spans(variants, spans.select("ref", "start1", "end1", F.col("cov").alias(field)), how="left", width=width).drop("start1", "end1")


def passing(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("filter").isin("PASS", "."))


def first_at_position(variants: DataFrame, order: str) -> DataFrame:
    """The first variant of each position."""
    cols = [c for c in variants.columns if c not in ("ref", "pos")]
    return variants.groupBy("ref", "pos").agg(F.min_by(F.struct(*cols), order).alias("v")).select("ref", "pos", "v.*")


def histogram_at_variants(variants: DataFrame, spans: DataFrame, bin_width: int, only_pass: bool = True, order: str = "id", width: int = BIN) -> DataFrame:
    """(ref, bin, n): coverage at variant positions, for all (ref ALL) and by reference, in one grouping."""
    v = passing(variants) if only_pass else variants
    at = first_at_position(v, order).select("ref", "pos")
    hit = points_in_spans(at, spans, width=width, unique=True).select("ref", (F.floor(half_up(F.col("cov")) / bin_width) * bin_width).cast("long").alias("bin"))
    sets = hit.groupingSets([["ref", "bin"], ["bin"]], "ref", "bin").agg(F.count("*").alias("n"), F.grouping("ref").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("ref")).alias("ref"), "bin", "n")


def tumor_normal_routes(tumor: DataFrame, normal: DataFrame, normal_spans: DataFrame, min_coverage: int = 2, width: int = BIN) -> DataFrame:
    """tumor variants with route: accepted, normal_also or low_coverage.

    A variant at a position of the normal is rejected unless it is HOM and a normal one there is HET; what
    is left needs min_coverage in the normal's signal.
    """
    n = normal.groupBy("ref", "pos").agg(F.max(F.col("zygosity") == "HET").alias("_het"))
    both = annotated(tumor, normal_spans, "normal_cov", width).join(n, ["ref", "pos"], "left")
    found = F.col("_het").isNotNull()
    rescued = (F.col("zygosity") == "HOM") & F.coalesce("_het", F.lit(False))
    deep = half_up(F.coalesce("normal_cov", F.lit(0))) >= min_coverage
    route = F.when(found & ~F.coalesce(rescued, F.lit(False)), "normal_also").when(deep, "accepted").otherwise("low_coverage")
    return both.withColumn("route", route).drop("_het")


def override(spans: DataFrame, variants: DataFrame, width: int = BIN, tile: int = TILE) -> DataFrame:
    """Spans whose value at a variant's position is its depth (the greatest, if there are several)."""
    v = variants.groupBy("ref", "pos").agg(F.max("dp").alias("dp"))
    inside = points_in_spans(v, spans, width=width, unique=True)
    cuts = inside.groupBy("ref", "start1", "end1", "cov").agg(F.array_sort(F.collect_list(F.struct("pos", "dp"))).alias("at"))
    # a span with k variants becomes up to 2k + 1: the variants, and what lies between their neighbours
    starts = F.concat(F.array(F.col("start1")), F.transform("at", lambda x: (x["pos"] + 1).cast("int")))
    ends = F.concat(F.transform("at", lambda x: x["pos"].cast("int")), F.array(F.col("end1")))
    between = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    rests = cuts.select("ref", F.col("cov").cast("double").alias("cov"), F.explode(between).alias("x")).select("ref", F.col("x.s").alias("start1"), F.col("x.e").alias("end1"), "cov").where("end1 > start1")
    points = cuts.select("ref", F.explode("at").alias("x")).select("ref", F.col("x.pos").cast("int").alias("start1"), (F.col("x.pos") + 1).cast("int").alias("end1"), F.col("x.dp").cast("double").alias("cov"))
    whole = spans.join(cuts.select("ref", "start1"), ["ref", "start1"], "left_anti").select("ref", "start1", "end1", F.col("cov").cast("double").alias("cov"))
    return merged(whole.unionByName(rests).unionByName(points), tile=tile)


def spliced(knots: DataFrame, variants: DataFrame, tile: int = TILE) -> DataFrame:
    """Knots with those of variants(ref, pos, dp) added on decoding, after the first and up to the last knot of a reference.

    A variant's knot goes from the value after the knot before it to its depth (the greatest, if there are several),
    and stands for a knot that is at its position. Variants without a depth add none.
    """
    ends = knots.groupBy("ref").agg(F.min("pos").alias("_first"), F.max("pos").alias("_end"))
    own = variants.where("dp is not null").groupBy("ref", "pos").agg(F.max("dp").cast("long").alias("c2")).join(ends, "ref")
    own = own.where("pos > _first and pos <= _end").select("ref", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("long").alias("c1"), "c2")
    kept = knots.select("ref", F.col("pos").cast("long").alias("pos"), F.col("c1").cast("long").alias("c1"), F.col("c2").cast("long").alias("c2")).join(own.select("ref", "pos"), ["ref", "pos"], "left_anti")
    near = with_neighbours(kept.unionByName(own), ["ref"], "pos", before={"_c": "c2"}, tile=tile)
    return near.select("ref", "pos", F.coalesce("c1", "_c").alias("c1"), "c2")
