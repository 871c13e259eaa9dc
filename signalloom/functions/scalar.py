"""Scalar functions on coverage, references and variants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper borders of the error report's coverage buckets. Fixed values.
BUCKETS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
GOLDEN_RATIO = (1 + math.sqrt(5)) / 2


def prefixed(ref: Column) -> Column:
    """The name with the prefix chr, once."""
    return F.regexp_replace(ref, "^(?!chr)", "chr")


def category(ref: Column) -> Column:
    """AUTOSOME, X, Y or OTHER."""
    ref = prefixed(ref)
    return F.when(ref.rlike(r"^chr\d+$"), "AUTOSOME").when(ref == "chrX", "X").when(ref == "chrY", "Y").otherwise("OTHER")


def scaled(cov: Column, factor: float) -> Column:
    """Linear scaling; a factor that is 0 or not finite is refused."""
    if factor == 0 or not math.isfinite(factor):
        raise ValueError("the scale factor must be finite and not 0")
    return cov * F.lit(float(factor))


def median_factor(text: str, median: float) -> float:
    """'median' scales the median to 1, 'median*X' to X."""
    head, _, tail = text.partition("*")
    if head.strip().lower() != "median":
        raise ValueError(f"not a median scale: {text!r}")
    return (float(tail) if tail else 1.0) / median


def combined(a: Column, b: Column, operator: str) -> Column:
    """ADD, SUBTRACT, DIFF, MIN, MAX or AVG of two values."""
    table = {
        "ADD": a + b,
        "SUBTRACT": a - b,
        "DIFF": F.abs(a - b),
        "MIN": F.least(a, b),
        "MAX": F.greatest(a, b),
        "AVG": (a + b) / F.lit(2.0).cast("double"),
    }
    if operator.upper() not in table:
        raise ValueError(f"unknown operator {operator!r}")
    return table[operator.upper()]


def error_bucket(cov: Column) -> Column:
    """The first bucket whose border is not below the value, else the last."""
    out = F.lit(len(BUCKETS) - 1)
    for i, border in reversed(list(enumerate(BUCKETS))):
        out = F.when(cov <= border, F.lit(i)).otherwise(out)
    return out


def binned(value: Column, width: float) -> Column:
    """Lower end of the value's bin."""
    return F.floor(value / F.lit(float(width))) * F.lit(width)


def zygosity(gt: Column) -> Column:
    """HOM for two equal alleles that are not the reference, HET for two different ones, else null."""
    a = F.split(gt, r"[/|]")
    x, y = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    return F.when((x == y) & ~x.isin("0", "."), "HOM").when(x != y, "HET")


def formatted(value: Column, digits: int = 1, missing: str = "n/a") -> Column:
    """The value with so many digits, or `missing` for null (which a format string alone would write as letters of "null")."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double"))).otherwise(F.lit(missing))


def zero_if_missing(x: Column) -> Column:
    return F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def rounded_log2(x: float) -> int:
    return 0 if x <= 0 else math.floor(math.log2(x) + 0.5)


def pow2(x: Column) -> Column:
    """2 to the power of a whole number from 0 to 62; others are refused."""
    wrong = F.raise_error(F.concat(F.lit("the exponent must be from 0 to 62: "), x.cast("string"))).cast("long")
    return F.when(x.between(0, 62), F.expr("1L") * F.pow(F.lit(2.0), x)).otherwise(wrong).cast("long")


def log2_rounded(x: Column) -> Column:
    """The rounded binary logarithm of a whole number; 0 for those that are not positive."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.floor(F.log2(x.cast("double")) + 0.5)).cast("long")


def log2_floored(x: Column) -> Column:
    """The floored binary logarithm of a whole number, exact: its binary digits less one; 0 for those that are not positive."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.length(F.bin(x.cast("long"))) - 1).cast("long")


def lognormal(normal: Column, mean: float, deviation: float) -> Column:
    """What standard normal numbers become as whole lognormal ones of this mean and standard deviation, cut towards 0."""
    s2 = math.log((deviation / mean) ** 2 + 1)
    return F.exp(normal * math.sqrt(s2) + (math.log(mean) - s2 / 2)).cast("long")


def genomic_order(ref: Column) -> Column:
    """Sorts references as people do: numbers by value, then X, Y, M, then other names, with or without the prefix chr."""
    name = F.regexp_replace(ref, "^chr", "")
    rank = F.when(name.rlike(r"^\d+$"), 0).when(name == "X", 1).when(name == "Y", 2).when(name.isin("M", "MT"), 3).otherwise(4)
    return F.struct(rank.alias("rank"), F.coalesce(name.try_cast("long"), F.lit(0)).alias("number"), ref.alias("name"))


def golomb_parameter(mean: float) -> int:
    """Bits of the remainder that suit geometric gaps of this mean."""
    if mean <= 0:
        return 0
    inner = math.floor(math.log(GOLDEN_RATIO - 1) / math.log(mean / (mean + 1)))
    return max(0, 1 + rounded_log2(inner))


def hit_text(cov: Column, lower: Column, upper: Column) -> Column:
    """A value with its corridor, marked where they differ; null where there is no value."""
    fuzzy = F.coalesce(lower != upper, F.lit(False))
    return F.when(cov.isNull(), F.lit(None).cast("string")).when(fuzzy, F.format_string("~%.2f [%.2f-%.2f]", cov, lower.cast("double"), upper.cast("double"))).otherwise(F.format_string("%.2f", cov))
