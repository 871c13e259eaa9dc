"""Several signals at once: refinement to common pieces, binary operators, correlation, error report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import combined, error_bucket
from .rangejoin import BIN, overlaps
from .signal import merged
from .windows import TILE


def synced(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Pieces that both signals cover: (ref, start1, end1, x, y). An inner join of positions, done on spans."""
    other = b.select("ref", F.col("start1").alias("lo"), F.col("end1").alias("hi"), F.col("cov").alias("y"))
    got = overlaps(a.select("ref", "start1", "end1", F.col("cov").alias("x")), other, width=width)
    return got.select("ref", F.greatest("start1", "lo").alias("start1"), F.least("end1", "hi").alias("end1"), "x", "y")


def combine(a: DataFrame, b: DataFrame, operator: str, width: int = BIN, tile: int = TILE) -> DataFrame:
    """Spans of ADD, SUBTRACT, DIFF, MIN, MAX or AVG over positions that both have."""
    both = synced(a, b, width)
    return merged(both.select("ref", "start1", "end1", combined(F.col("x"), F.col("y"), operator).alias("cov")), tile=tile)


def correlation(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """One row: n, sums, means, sample deviations and Pearson's r over common positions.

    Spans are weighted by length; all sums are exact integers in decimals, so no pass over means is needed.
    """
    n = (F.col("end1") - F.col("start1")).cast("decimal(38,0)")
    x, y = F.col("x").cast("decimal(18,0)"), F.col("y").cast("decimal(18,0)")
    total = lambda e, name: F.sum((n.cast("decimal(18,0)") * e).cast("decimal(38,0)")).alias(name)
    one = F.lit(1).cast("decimal(18,0)")
    s = synced(a, b, width).agg(total(one, "n"), total(x, "sx"), total(y, "sy"), total((x * x).cast("decimal(18,0)"), "sxx"), total((y * y).cast("decimal(18,0)"), "syy"), total((x * y).cast("decimal(18,0)"), "sxy"))
    d = {c: F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    cx, cy, cxy = (d["sxx"] - d["sx"] * d["sx"] / d["n"], d["syy"] - d["sy"] * d["sy"] / d["n"], d["sxy"] - d["sx"] * d["sy"] / d["n"])
    return s.select(
        F.col("n").cast("long").alias("n"), F.col("sx").cast("long").alias("sum_x"), F.col("sy").cast("long").alias("sum_y"), F.col("sxy").cast("long").alias("sum_xy"),
        (d["sx"] / d["n"]).alias("mean_x"), (d["sy"] / d["n"]).alias("mean_y"),
        F.sqrt(cx / (d["n"] - 1)).alias("sd_x"), F.sqrt(cy / (d["n"] - 1)).alias("sd_y"),
        F.when((cx > 0) & (cy > 0), cxy / F.sqrt(cx * cy)).alias("r"),
    )


def error_report(real: DataFrame, found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """By bucket of real coverage: positions, mean and largest absolute error and where it is. Dense signals;
    positions that only `found` has are passed over, positions that it lacks count as found 0."""
    keys = [*by, "ref", "pos"]
    both = real.select(*keys, "cov").join(found.select(*keys, F.col("cov").alias("got")), keys, "left")
    diff = F.abs(F.col("cov") - F.coalesce("got", F.lit(0.0)))
    rows = both.select(error_bucket(F.col("cov")).alias("bucket"), diff.alias("diff"), "ref", "pos")
    worst = F.max_by(F.struct("ref", "pos"), F.struct("diff", (-F.col("pos")).alias("p"), "ref"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"), worst.alias("at"))
