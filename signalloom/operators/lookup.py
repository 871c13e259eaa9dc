"""Point queries: value, corridor and padding at given positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantize import Quantizer
from .rangejoin import BIN, points_in_spans
from .signal import interpolated, knots_to_spans
from .windows import TILE


def point_query(queries: DataFrame, knots: DataFrame, quantizer: Quantizer | None = None, scale: float = 1.0, lengths: DataFrame | None = None, width: int = BIN, tile: int = TILE) -> DataFrame:
    """queries(ref, pos, ...) with cov, raw, lower, upper, fuzzy, padding; cov and raw, its value before scaling, are null
    where there is no value.

    As-of lookup as a range join of the different positions asked for and pieces between knots, joined back to the
    queries; the last knot answers at its own position. Both bounds come from the corridor of the left knot. With lengths(ref, length), a position
    p without a value and 0 < p < length is padding of coverage 0.
    """
    pieces = knots_to_spans(knots, tile=tile)
    last = knots.groupBy("ref").agg(F.max_by(F.struct("pos", "c2"), "pos").alias("k"))
    end = last.select("ref", F.col("k.pos").alias("start1"), (F.col("k.pos") + 1).alias("end1"), F.col("k.c2").cast("double").alias("y0"), F.col("k.c2").cast("double").alias("y1"))
    at = queries.select("ref", "pos").distinct()
    hit = points_in_spans(at, pieces.unionByName(end), width=width, unique=True)
    knot = F.col("y0").cast("long")
    low, high = (quantizer.lower(knot), quantizer.upper(knot)) if quantizer else (knot, knot)
    raw, s = interpolated(F.col("pos")), F.lit(float(scale))
    found = hit.select("ref", "pos", (raw * s).alias("cov"), raw.alias("raw"), (low * s).alias("lower"), (high * s).alias("upper"))
    found = found.withColumn("fuzzy", F.coalesce(F.col("lower") != F.col("upper"), F.lit(False)))
    if lengths is not None:
        found = at.join(found, ["ref", "pos"], "left").join(lengths.select("ref", "length"), "ref", "left")
        pad = F.col("cov").isNull() & (F.col("pos") > 0) & F.coalesce(F.col("pos") < F.col("length"), F.lit(False))
        found = found.withColumn("padding", pad).withColumn("cov", F.when(F.col("padding"), F.lit(0.0)).otherwise(F.col("cov"))).drop("length")
    else:
        found = found.withColumn("padding", F.lit(False))
    new = [c for c in found.columns if c not in ("ref", "pos")]
    found = found.withColumnsRenamed({"ref": "_ref", "pos": "_pos"})
    own = queries.drop(*new)
    out = own.join(found, (own["ref"] == found["_ref"]) & (own["pos"] == found["_pos"]), "left").drop("_ref", "_pos")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("fuzzy", "padding")})
