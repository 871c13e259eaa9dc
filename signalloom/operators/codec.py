"""Corridor quantization and the sequence codecs over knots."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantize import Quantizer
from .windows import TILE, with_running, with_runs


def segments(spans: DataFrame, quantizer: Quantizer, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """spans with _seg, which grows where the corridor fold is known to set a new anchor, and the values before (_c) and starts after (_n)."""

    def known(a, b):
        least, greatest = quantizer.reach(a["cov"])
        return (b["cov"] < least) | (b["cov"] > greatest)

    return with_runs(spans, [*by, "ref"], "start1", known, "_seg", before={"_c": "cov"}, after={"_n": "start1"}, tile=tile)


def lossy_knots(spans: DataFrame, quantizer: Quantizer, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Knots where the value leaves the corridor of the anchor, which then moves to the new value.

    The fold looks at changes only, so it runs over spans. It is cut wherever the state is known: at values that
    lie outside the corridor of every anchor that could hold the value before them, which must become the
    anchor. So signals without zeros fold in many tasks too. A segment streams through its task in order, in
    constant memory.
    """
    keys = [*by, "ref"]
    runs = segments(spans, quantizer, by, tile)
    runs = runs.withColumns({"lo": quantizer.lower(F.col("cov")).cast("long"), "hi": quantizer.upper(F.col("cov")).cast("long")})
    runs = runs.select(*keys, F.col("_seg").cast("long").alias("seg"), F.col("start1").cast("long").alias("start1"), F.col("end1").cast("long").alias("end1"), F.col("cov").cast("long").alias("cov"), F.coalesce("_c", F.lit(0)).cast("long").alias("before"), F.col("_n").isNull().alias("last"), "lo", "hi")
    dealt = runs.repartition(*keys, "seg").sortWithinPartitions(*keys, "seg", "start1")
    key_types = ", ".join(f"{k} {spans.schema[k].dataType.simpleString()}" for k in keys)

    def fold(batches):
        now, lo, hi = None, 0, 0
        for b in batches:
            rows = []
            ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            for k, seg, start, end, cov, before, last, a, z in zip(ks, *(b.column(c).to_pylist() for c in ("seg", "start1", "end1", "cov", "before", "last", "lo", "hi")), strict=True):
                if (k, seg) != now:
                    now, fresh = (k, seg), True
                    # a segment begins at a value that is surely an anchor: no corridor holds it
                    lo, hi = (0, 0) if seg == 0 else (1, 0)
                if cov < lo or cov > hi:
                    rows.append((*k, start, before, cov))
                    lo, hi = a, z
                if last:
                    rows.append((*k, end, cov, 0))
            names = [*keys, "pos", "c1", "c2"]
            types = [b.schema.field(k).type for k in keys] + [pa.int64()] * 3
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return dealt.mapInArrow(fold, f"{key_types}, pos long, c1 long, c2 long")


def numbered(knots: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Adds n, the 0-based number of a knot along its reference."""
    return with_running(knots, [*by, "ref"], "pos", {"n": F.lit(1).cast("long")}, tile).withColumn("n", F.col("n") - 1)


def blocked(knots: DataFrame, block_size: int, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Adds block_id: every block_size knots of a reference."""
    return numbered(knots, by, tile).withColumn("block_id", F.floor(F.col("n") / block_size)).drop("n")


def delta_encoded(knots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds delta: the distance to the knot before in the same block (to position 1 at its start)."""
    w = Window.partitionBy(*by, "ref", "block_id").orderBy("pos")  # a block has a bounded number of knots
    return knots.withColumn("delta", F.col("pos") - F.lag("pos", 1, 1).over(w))


def delta_decoded(deltas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positions back from deltas, block by block; rows carry their order n in the block."""
    w = Window.partitionBy(*by, "ref", "block_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("pos", F.sum("delta").over(w) + 1)


def run_length_encoded(df: DataFrame, keys: Sequence[str], at: str, value: str, tile: int = TILE) -> DataFrame:
    """(keys, start, n, value): runs of equal values in the order of `at`."""
    keys = list(keys)
    runs = with_runs(df.select(*dict.fromkeys((*keys, at, value))), keys, at, lambda a, b: ~a[value].eqNullSafe(b[value]), tile=tile)
    return runs.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.count("*").alias("n"), F.first(value).alias("value")).drop("_run")


def run_length_decoded(runs: DataFrame) -> DataFrame:
    """One row a repetition again, numbered within its run."""
    return runs.select("*", F.posexplode(F.expr("array_repeat(value, cast(n as int))")).alias("i", "v")).drop("value", "n").withColumnRenamed("v", "value")


def positions_per_block(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ref, blocks, mean_positions): how far apart the first knots of neighbouring blocks lie; null for one block."""
    w = Window.partitionBy(*by, "ref").orderBy("block_id")  # a row a block
    gap = F.lead("first_pos").over(w) - F.col("first_pos")
    return sizes.withColumn("_gap", gap).groupBy(*by, "ref").agg(F.count("*").alias("blocks"), F.avg("_gap").alias("mean_positions"))


def counters(spans: DataFrame, knots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(name, value): positions read, knots made, and knots where the value left its corridor upwards or downwards; closing
    knots, one a reference, count as neither."""
    ends = knots.groupBy(*by, "ref").agg(F.max("pos").alias("pos"))
    inner = knots.join(ends, [*by, "ref", "pos"], "left_anti").agg(
        F.coalesce(F.sum((F.col("c2") > F.col("c1")).cast("long")), F.lit(0)).alias("left-upper-border"),
        F.coalesce(F.sum((F.col("c2") < F.col("c1")).cast("long")), F.lit(0)).alias("left-lower-border"),
    )
    one = spans.agg(F.coalesce(F.sum(F.col("end1") - F.col("start1")), F.lit(0)).cast("long").alias("coverage-values")).join(knots.agg(F.count("*").alias("codewords")), how="cross").join(inner, how="cross")  # three rows of one
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("long").alias("value")) for c in one.columns])).alias("x")).select("x.*")


def block_sizes(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Knots and first and last position of each block."""
    return blocks.groupBy(*by, "ref", "block_id").agg(F.count("*").alias("knots"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
