"""Range joins as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a bin of long intervals; those that are no longer than it have bins of their own.
BIN = 1 << 12
#: Bins of short intervals in a bin.
SPLIT = 64


def _fine(width: int) -> int:
    return max(1, width // SPLIT)


def _keys(lo, hi, width: int, kind: int, kinds: int):
    """Keys of the bins that [lo, hi) touches; each kind of bins has keys of its own."""
    return F.transform(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)), lambda b: b * kinds + kind)


def _placed(df: DataFrame, lo: str, hi: str, width: int, short: int, long: int, name: str) -> DataFrame:
    """A row for each key of an interval: `short` and `long` are the kinds in which it meets long and short ones of the other side."""
    keys = lambda w, kind: _keys(F.col(lo), F.col(hi), w, kind, 4)
    size = F.col(hi) - F.col(lo)
    near, far = F.concat(keys(_fine(width), 0), keys(width, short)), F.concat(keys(width, long), keys(width, 3))
    return df.where(size > 0).withColumn(name, F.explode(F.when(size <= width, near).otherwise(far)))


def points_in_spans(points: DataFrame, spans: DataFrame, pos: str = "pos", lo: str = "start1", hi: str = "end1", on: tuple[str, ...] = ("ref",), how: str = "inner", width: int = BIN, unique: bool = False) -> DataFrame:
    """Joins points to the spans [lo, hi) that hold them. how: inner, left, left_semi, left_anti.

    Spans are looked up once for each different (on, pos), and what is found is joined back by equality, so points that
    share a position cost a row each. unique: the points have none in common, so an inner join needs no such step.
    A point has a fine bin, which short spans meet it in, and a wide one for long spans.
    """
    at = points if unique and how == "inner" else points.select(*on, pos).distinct()
    fine = _fine(width)
    bins = F.array(F.floor(F.col(pos) / fine) * 2, F.floor(F.col(pos) / width) * 2 + 1)
    p = at.where(F.col(pos).isNotNull()).withColumn("_bin", F.explode(bins))
    s = spans.where(F.col(hi) > F.col(lo))
    s = s.withColumn("_bin2", F.explode(F.when(F.col(hi) - F.col(lo) <= width, _keys(F.col(lo), F.col(hi), fine, 0, 2)).otherwise(_keys(F.col(lo), F.col(hi), width, 1, 2))))
    s = s.withColumnsRenamed({k: f"_on_{k}" for k in on})
    cond = (p["_bin"] == s["_bin2"]) & (p[pos] >= s[lo]) & (p[pos] < s[hi])
    for k in on:
        cond = cond & (p[k] == s[f"_on_{k}"])
    hit = p.join(s, cond).drop("_bin", "_bin2", *[f"_on_{k}" for k in on])
    if at is points:
        return hit
    hit = hit.withColumnsRenamed({k: f"_at_{k}" for k in (*on, pos)})
    same = points[pos] == hit[f"_at_{pos}"]
    for k in on:
        same = same & (points[k] == hit[f"_at_{k}"])
    return points.join(hit, same, how).drop(*[f"_at_{k}" for k in (*on, pos)])


def overlaps(a: DataFrame, b: DataFrame, a_range: tuple[str, str] = ("start1", "end1"), b_range: tuple[str, str] = ("lo", "hi"), on: tuple[str, ...] = ("ref",), width: int = BIN) -> DataFrame:
    """Pairs of intervals that overlap, each once: in the first bin that both touch. Adds overlap, its length.

    Two short intervals meet in fine bins (kind 0), a long a and a short b in wide ones (kind 1), as do a short a and a long b (2)
    and two long ones (3). So short intervals of a wide bin are compared with near ones only.
    """
    (al, ah), (bl, bh) = a_range, b_range
    fine = _fine(width)

    x, y = _placed(a, al, ah, width, 2, 1, "_bin"), _placed(b, bl, bh, width, 1, 2, "_bin2")
    y = y.withColumnsRenamed({k: f"_on_{k}" for k in on})
    size = F.when(F.pmod(x["_bin"], F.lit(4)) == 0, F.lit(fine)).otherwise(F.lit(width))
    cond = (x["_bin"] == y["_bin2"]) & (x[al] < y[bh]) & (y[bl] < x[ah]) & (F.floor(x["_bin"] / 4) == F.floor(F.greatest(x[al], y[bl]) / size))
    for k in on:
        cond = cond & (x[k] == y[f"_on_{k}"])
    out = x.join(y, cond).drop("_bin", "_bin2", *[f"_on_{k}" for k in on])
    return out.withColumn("overlap", F.least(ah, bh) - F.greatest(al, bl))
