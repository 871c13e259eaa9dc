"""The three forms of a signal and the ways between them.

spans: (keys, ref, start1, end1, cov), cov on [start1, end1); knots: (keys, ref, pos, c1, c2), c2 at the
position and c1 just before it, linear in between; dense: (keys, ref, pos, cov). `by` names more keys,
such as a track. Positions are 1-based.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import TILE, along, with_neighbours, with_runs


def pileup(reads: DataFrame, by: Sequence[str] = (), weight=None, tile: int = TILE) -> DataFrame:
    """Depth of reads(ref, start1, end1) as spans between the first and last event, gaps of depth 0 included.

    One row a distinct start or end survives the pre-aggregated first shuffle; depth is their running sum.
    """
    keys = [*by, "ref"]
    w = F.lit(1) if weight is None else weight
    ends = reads.where("end1 > start1").select(*keys, F.explode(F.array(F.struct(F.col("start1").alias("pos"), w.alias("d")), F.struct(F.col("end1").alias("pos"), (-w).alias("d")))).alias("e"))
    events = ends.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    spans = along(events, keys, "pos", after={"end1": "pos"}, sums={"cov": "d"}, tile=tile)
    return spans.where("end1 is not null").select(*keys, F.col("pos").alias("start1"), "end1", "cov")


def merged(spans: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Joins touching spans of equal value."""
    keys = [*by, "ref"]
    apart = lambda a, b: (a["end1"] != b["start1"]) | ~a["cov"].eqNullSafe(b["cov"])
    runs = with_runs(spans.select(*keys, "start1", "end1", "cov"), keys, "start1", apart, tile=tile)
    return runs.groupBy(*keys, "_run").agg(F.min("start1").alias("start1"), F.max("end1").alias("end1"), F.first("cov").alias("cov")).drop("_run")


def spans_to_dense(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a position; for export, sampling and small inputs."""
    return spans.where("end1 > start1").select(*by, "ref", F.explode(F.expr("sequence(start1, end1 - 1)")).alias("pos"), "cov")


def dense_to_spans(dense: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    return merged(dense.select(*by, "ref", F.col("pos").alias("start1"), (F.col("pos") + 1).alias("end1"), "cov"), by, tile)


def spans_to_knots(spans: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Lossless knots: wherever the value changes, from 0 before the first position, and a closing one after the last.

    In a gap between spans there is no knot of its own: the codec interpolates there, from the value before
    the gap to itself.
    """
    keys = [*by, "ref"]
    near = with_neighbours(spans, keys, "start1", before={"_c": "cov"}, after={"_n": "start1"}, tile=tile)
    before = F.coalesce(F.col("_c"), F.lit(0))
    change = F.when(before != F.col("cov"), F.struct(F.col("start1").alias("pos"), before.alias("c1"), F.col("cov").alias("c2")))
    end = F.when(F.col("_n").isNull(), F.struct(F.col("end1").alias("pos"), F.col("cov").alias("c1"), F.lit(0).cast(spans.schema["cov"].dataType).alias("c2")))
    return near.select(*keys, F.explode(F.array_compact(F.array(change, end))).alias("k")).select(*keys, "k.pos", "k.c1", "k.c2").where("not (pos is null)")


def knots_to_spans(knots: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Linear pieces (start1, end1, y0, y1): the value runs from y0 at start1 to y1 at end1 - 1; the range is [first, last)."""
    keys = [*by, "ref"]
    near = with_neighbours(knots, keys, "pos", after={"_p": "pos", "_c": "c1"}, tile=tile)
    return near.where("_p is not null").select(*keys, F.col("pos").alias("start1"), F.col("_p").alias("end1"), F.col("c2").cast("double").alias("y0"), F.col("_c").cast("double").alias("y1"))


def interpolated(pos, start1="start1", end1="end1", y0="y0", y1="y1"):
    """Value at pos of a linear piece; at its start always y0."""
    width = F.col(end1) - 1 - F.col(start1)
    return F.when(width <= 0, F.col(y0)).otherwise(F.col(y0) + (F.col(y1) - F.col(y0)) * (pos - F.col(start1)) / F.when(width > 0, width))


def pieces_to_spans(pieces: DataFrame, by: Sequence[str] = (), scale: float = 1.0, tile: int = TILE) -> DataFrame:
    """Spans of linear pieces: level pieces as they are, and only sloping ones position by position."""
    keys = [*by, "ref"]
    level = (F.col("y0") == F.col("y1")) | (F.col("end1") - F.col("start1") <= 1)
    flat = pieces.where(level).select(*keys, F.col("start1").cast("long"), F.col("end1").cast("long"), (F.col("y0") * F.lit(float(scale))).alias("cov"))
    sloped = pieces.where(~level).withColumn("pos", F.explode(F.expr("sequence(start1, end1 - 1)")))
    sloped = sloped.select(*keys, F.col("pos").cast("long").alias("start1"), (F.col("pos") + 1).cast("long").alias("end1"), (interpolated(F.col("pos")) * F.lit(float(scale))).alias("cov"))
    return merged(flat.unionByName(sloped), by, tile)


def crossings(pieces: DataFrame, low: int, high: int, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """(keys, start1, end1): where the rounded value of a linear piece lies in [low, high]; one stretch a piece, as
    pieces only rise or only fall. The ends are solved for and then put right by the value itself, so they are those that a
    scan finds; no position is made."""
    keys, s = [*by, "ref"], F.lit(float(scale))
    inside = lambda p: half_up(interpolated(p) * s).between(low, high)
    first, last = F.col("start1").cast("long"), (F.col("end1") - 1).cast("long")
    slope = (F.col("y1") - F.col("y0")) * s / F.when(last > first, last - first)
    to = lambda y: first + (F.lit(float(y)) - F.col("y0") * s) / slope
    a, z = F.least(to(low - 0.5), to(high + 0.5)), F.greatest(to(low - 0.5), to(high + 0.5))
    clip = lambda x: F.least(F.greatest(x, first.cast("double")), last.cast("double")).cast("long")
    near = lambda x: F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: clip(x) + d), lambda p: (p >= first) & (p <= last) & inside(p))
    sloping = (last > first) & (F.col("y0") != F.col("y1"))
    start = F.when(sloping, F.array_min(near(F.ceil(a)))).when(inside(first), first)
    end = F.when(sloping, F.array_max(near(F.floor(z)))).when(inside(first), last)
    # a name of their own: a new start1 would be taken for the piece's in the second expression
    out = pieces.where("end1 > start1").select(*keys, start.alias("_from"), end.alias("_to"))
    return out.where("_from is not null and _to >= _from").select(*keys, F.col("_from").alias("start1"), (F.col("_to") + 1).alias("end1"))


def knots_to_dense(knots: DataFrame, by: Sequence[str] = (), scale: float = 1.0, tile: int = TILE) -> DataFrame:
    """Reconstruction of every position between the first and the last knot."""
    pieces = knots_to_spans(knots, by, tile).withColumn("pos", F.explode(F.expr("sequence(start1, end1 - 1)")))
    return pieces.select(*by, "ref", "pos", (interpolated(F.col("pos")) * F.lit(float(scale))).alias("cov"))


def half_up(x):
    """Rounding half towards positive infinity."""
    return F.floor(x + F.lit(0.5))
