"""Samples of a signal: by step, by window, by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import points_in_spans
from .regions import in_regions
from .windows import TILE, with_running


def every_nth(spans: DataFrame, step: int, regions: DataFrame | None = None, start: int | None = None, by: Sequence[str] = (), limit: int | None = None, tile: int = TILE) -> DataFrame:
    """Every step-th covered position, from the first (or from `start`) in each reference, as dense rows.

    Positions are numbered from running span lengths, so only the chosen ones are ever made."""
    if step < 1:
        raise ValueError("the step must be 1 or more")
    src = in_regions(spans, regions, by) if regions is not None else spans
    if start is not None:
        src = src.where(F.col("end1") > start).withColumn("start1", F.greatest("start1", F.lit(start)))
    run = with_running(src, [*by, "ref"], "start1", {"_to": (F.col("end1") - F.col("start1")).cast("long")}, tile)
    first = F.col("_to") - (F.col("end1") - F.col("start1"))  # positions before this span
    skip = F.pmod(-first, F.lit(step))
    ok = run.withColumn("_s", (F.col("start1") + skip).cast("long")).where("_s < end1")
    out = ok.select(*by, "ref", F.explode(F.sequence(F.col("_s"), F.col("end1").cast("long") - 1, F.lit(step).cast("long"))).alias("pos"), "cov")
    return out if limit is None else out.orderBy(*by, "ref", "pos").limit(limit)


def random_start(regions: DataFrame, seed: int) -> tuple[str, int]:
    """A 1-based position in regions(ref, start0, end0), by seed alone: each region in proportion to its width (the least
    of exponential numbers whose rates are the widths), and a place in it."""
    u = lambda *x: (F.pmod(F.xxhash64("ref", "start0", "end0", F.lit(seed), *x), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    width = F.col("end0") - F.col("start0")
    rows = regions.where("end0 > start0").select("ref", "start0", "end0", (-F.log(u()) / width).alias("t"), F.floor(u(F.lit("place")) * width).alias("at"))
    got = rows.orderBy("t", "ref", "start0", "end0").first()
    if got is None:
        raise ValueError("a random start needs a region")
    return got["ref"], int(got["start0"] + got["at"] + 1)


def checked_start(regions: DataFrame, ref: str, pos: int) -> tuple[str, int]:
    """The start, if it lies in regions(ref, start0, end0); an error, if not."""
    if regions.where((F.col("ref") == ref) & (F.col("start0") < pos) & (F.col("end0") >= pos)).isEmpty():
        raise ValueError(f"the start {ref}:{pos} lies in no region")
    return ref, pos


def matrix(spans: DataFrame, win: int, tracks: Sequence[str], track: str = "track", tile: int = TILE, limit: int | None = None) -> DataFrame:
    """(ref, pos, track, cov) at every win-th position of the first of `tracks`, the columns of the matrix; null
    where a track has no value there. limit takes the first windows alone."""
    rows = every_nth(spans.where(F.col(track) == tracks[0]), win, tile=tile, limit=limit)
    full = rows.select("ref", "pos", F.explode(F.array(*[F.lit(t) for t in tracks])).alias(track))
    hit = points_in_spans(full, spans.select("ref", track, "start1", "end1", "cov"), on=("ref", track), how="left")
    return hit.select("ref", "pos", track, "cov")
