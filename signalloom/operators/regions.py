"""Regions: gaps and islands, region-of-interest filters, intersections and overlap statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import BIN, overlaps, points_in_spans
from .signal import half_up, pileup
from .windows import TILE, with_runs

_ROI = re.compile(r"^\s*(.+):([\d,]+)-([\d,]+)\s*$")


def parse_roi(text: str) -> tuple[str, int, int]:
    """'1:100-200' (1-based, both ends in) as (ref, start0, end0), half open."""
    m = _ROI.match(text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    return m[1], int(m[2].replace(",", "")) - 1, int(m[3].replace(",", ""))


def islands(spans: DataFrame, keep, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Longest stretches of touching spans for which `keep` holds: (keys, start1, end1)."""
    keys = [*by, "ref"]
    kept = spans.where(keep).select(*keys, "start1", "end1")
    runs = with_runs(kept, keys, "start1", lambda a, b: a["end1"] != b["start1"], tile=tile)
    return runs.groupBy(*keys, "_run").agg(F.min("start1").alias("start1"), F.max("end1").alias("end1")).drop("_run")


def regions_by_coverage(spans: DataFrame, low: int = 0, high: int = (1 << 31) - 1, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Regions whose rounded coverage lies in [low, high]; a missing value counts as 0."""
    return islands(spans, half_up(F.coalesce(F.col("cov"), F.lit(0))).between(low, high), by, tile)


def in_regions(spans: DataFrame, regions: DataFrame, by: Sequence[str] = (), width: int = BIN) -> DataFrame:
    """What of spans lies in regions(ref, start0, end0), cut at region borders. Overlapping regions count once."""
    union = islands_of(regions.select("ref", (F.col("start0") + 1).alias("start1"), (F.col("end0") + 1).alias("end1")))
    got = overlaps(spans, union.select("ref", F.col("start1").alias("lo"), F.col("end1").alias("hi")), width=width)
    return got.select(*by, "ref", F.greatest("start1", "lo").alias("start1"), F.least("end1", "hi").alias("end1"), "cov")


def islands_of(intervals: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Union of intervals(ref, start1, end1): disjoint, not touching."""
    return islands(pileup(intervals, by, tile=tile), F.col("cov") > 0, by, tile)


def positions_in_regions(points: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Points that any region holds (left semi)."""
    r = regions.select("ref", (F.col("start0") + 1).alias("start1"), (F.col("end0") + 1).alias("end1"))
    return points_in_spans(points, r, how="left_semi", width=width)


def covered_by_all(regions: DataFrame, track: str, n: int, tile: int = TILE) -> DataFrame:
    """(ref, start1, end1): where all n tracks have a region. Each track is made disjoint first, then one sweep counts."""
    own = islands_of(regions, (track,), tile)
    depth = pileup(own.select("ref", "start1", "end1"), tile=tile)
    return islands(depth, F.col("cov") == n, tile=tile)


def min_covered(spans: DataFrame, track: str, minimum: dict, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(regions of each track with coverage at its minimum or above, their intersection); minimum: track value -> least."""
    need = F.create_map(*[F.lit(x) for kv in minimum.items() for x in kv])
    own = islands(spans, half_up(F.col("cov")) >= need[F.col(track)], (track,), tile)
    return own, covered_by_all(own, track, len(minimum), tile)


def scope_overlap(scope: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """For each scope(ref, start0, end0, name): covered bases and their share of its width. Regions are disjoint."""
    s = scope.select("ref", (F.col("start0") + 1).alias("start1"), (F.col("end0") + 1).alias("end1"), "name")
    hit = overlaps(s.select("ref", "start1", "end1").distinct(), regions.select("ref", F.col("start1").alias("lo"), F.col("end1").alias("hi")), width=width)
    sums = hit.groupBy("ref", "start1", "end1").agg(F.sum("overlap").alias("covered"))
    out = s.join(sums, ["ref", "start1", "end1"], "left").select("ref", "start1", "end1", "name", "covered")
    out = out.withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("share", F.col("covered") / (F.col("end1") - F.col("start1")))
