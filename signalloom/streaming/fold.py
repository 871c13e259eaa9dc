"""The corridor fold and depth over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantize import Quantizer


def stream_knots(points: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Knots (ref, pos, c1, c2) of a stream of points(ref, pos, cov) that arrive in order of position in each reference.

    State is five numbers a reference: the corridor, the last value and position. Points at or before the
    last position are late and passed over. There is no closing knot: a stream does not end.
    """
    src = points.select("ref", F.col("pos").cast("long").alias("pos"), F.col("cov").cast("long").alias("cov"))
    src = src.withColumns({"lo": quantizer.lower(F.col("cov")).cast("long"), "hi": quantizer.upper(F.col("cov")).cast("long")})

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lo, hi, last, at = state.get if state.exists else (0, 0, 0, -1)
        rows = []
        for row in pd.concat(frames).sort_values("pos", kind="stable").itertuples():
            if row.pos <= at:
                continue
            if not lo <= row.cov <= hi:
                rows.append((key[0], row.pos, last, row.cov))
                lo, hi = int(row.lo), int(row.hi)
            last, at = int(row.cov), int(row.pos)
        state.update((lo, hi, last, at))
        yield pd.DataFrame(rows, columns=["ref", "pos", "c1", "c2"])

    return src.groupBy("ref").applyInPandasWithState(fold, "ref string, pos long, c1 long, c2 long", "lo long, hi long, last long, at long", "append", "NoTimeout")


def stream_event_counts(events: DataFrame, ref: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(ref, start, cov): events by reference and time window, each emitted when the watermark has passed it."""
    return (
        events.withWatermark(time, late).groupBy(F.col(ref).alias("ref"), F.window(time, window).alias("w"))
        .agg(F.count("*").alias("cov")).select("ref", F.col("w.start").alias("start"), "cov")
    )
