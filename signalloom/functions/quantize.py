"""Error corridors of integer coverage, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Quantizer:
    """lower and upper give the inclusive corridor of a value; reach gives bounds (least, greatest), maybe too wide, of what
    the corridors hold that hold a value: all anchors that could stand for it."""

    name: str
    lower: Callable[[Column], Column]
    upper: Callable[[Column], Column]
    reach: Callable[[Column], tuple[Column, Column]]


def _half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def percent(p: float) -> Quantizer:
    """[round(c (1 - p)), round(c (1 + p))]; p = 0 keeps everything."""
    if not 0 <= p <= 1:
        raise ValueError("a percentage quantizer needs a parameter from 0 to 1")

    def reach(c: Column) -> tuple[Column, Column]:
        # an anchor a that holds c has a (1 - p) < c + 0.5 and a (1 + p) >= c - 0.5; 0 stands alone for 0 unless corridors reach it
        v = c.cast("double")
        least = (v - F.lit(0.5)) * F.lit((1 - p) / (1 + p)) - F.lit(0.51)
        greatest = (v + F.lit(0.5)) * F.lit((1 + p) / (1 - p)) + F.lit(0.51) if p < 1 else F.lit(float("inf"))
        if p > 0.5:
            return least, greatest
        return F.when(v > 0, F.greatest(least, F.lit(0.5))).otherwise(F.lit(0.0)), F.when(v > 0, greatest).otherwise(F.lit(0.0))

    return Quantizer("PERC", lambda c: _half_up(c * F.lit(1 - p)), lambda c: _half_up(c * F.lit(1 + p)), reach)


def grid(height: float) -> Quantizer:
    """Cells of equal height; 0 is alone, and the lowest cell begins at 1. The upper border belongs to both cells."""
    if height <= 0:
        raise ValueError("a grid quantizer needs a height above 0")
    low = lambda c: (F.floor(c / F.lit(float(height))) * F.lit(height)).cast("long")

    def reach(c: Column) -> tuple[Column, Column]:
        # the value's own cell, and the one below, whose upper border it may be; borders that are cut to whole numbers reach further
        more = F.lit(1.0 if height == int(height) else 2 * height + 2)
        least = F.greatest((F.ceil(c / F.lit(float(height))) - 1) * F.lit(float(height)) - more, F.lit(1.0))
        return F.when(c == 0, F.lit(0.0)).otherwise(least), F.when(c == 0, F.lit(0.0)).otherwise(low(c) + F.lit(int(height)) + more)

    return Quantizer(
        "GRID",
        lambda c: F.when(c == 0, F.lit(0)).otherwise(F.greatest(low(c), F.lit(1))).cast("long"),
        lambda c: F.when(c == 0, F.lit(0)).otherwise(low(c) + F.lit(int(height))).cast("long"),
        reach,
    )


def log2() -> Quantizer:
    """Cells between powers of two, borders in both; 0 is alone."""

    def upper(c: Column) -> Column:
        # the number of binary digits is exact where a logarithm may round
        return F.when(c == 0, F.lit(0)).otherwise(F.expr("1L") * F.pow(F.lit(2.0), F.length(F.bin(c.cast("long"))))).cast("long")

    # a power of two is also the upper border of the cell below its own
    return Quantizer("LOG2", lambda c: F.shiftright(upper(c), 1).cast("long"), upper, lambda c: (F.when(c == 0, F.lit(0.0)).otherwise(F.greatest(upper(c) / 4, F.lit(1.0))), upper(c).cast("double")))


def quantizer(method: str, parameter: float | None = None) -> Quantizer:
    """By name, in any case; PERC and GRID need a parameter."""
    method = method.upper()
    if method == "LOG2":
        return log2()
    if method not in ("PERC", "GRID"):
        raise ValueError(f"unknown quantizer {method!r}")
    if parameter is None:
        raise ValueError(f"{method} needs a parameter")
    return percent(parameter) if method == "PERC" else grid(parameter)
