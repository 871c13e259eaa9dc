"""Facade: build, open and query signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.quantize import Quantizer, quantizer
from .functions.scalar import hit_text, median_factor
from .operators import codec, lookup, regions, signal, stats, variants
from .sources import store, text


@dataclass
class Signal:
    """Knots with the quantizer they were made by, a scale and, if known, reference lengths."""

    spark: SparkSession
    knots: DataFrame
    quantizer: Quantizer
    scale: float = 1.0
    lengths: DataFrame | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def query(self, ref: str, pos: int):
        """One position: a Row with cov, lower, upper, fuzzy and padding."""
        ask = self.spark.createDataFrame([(ref, pos)], "ref string, pos int")
        return self.query_all(ask).first()

    def query_all(self, points: DataFrame) -> DataFrame:
        return lookup.point_query(points, self.knots, self.quantizer, self.scale, self.lengths)

    def text(self, ref: str, pos: int) -> str | None:
        ask = self.spark.createDataFrame([(ref, pos)], "ref string, pos int")
        return self.query_all(ask).select(hit_text(F.col("cov"), F.col("lower"), F.col("upper"))).first()[0]

    def scan(self) -> DataFrame:
        """Every position from the first knot to the last."""
        return signal.knots_to_dense(self.knots, scale=self.scale)

    def spans(self) -> DataFrame:
        return signal.pieces_to_spans(signal.knots_to_spans(self.knots), scale=self.scale)

    def regions(self, low: int = 0, high: int = (1 << 31) - 1) -> DataFrame:
        """Where the rounded value lies in [low, high]: solved by piece, then joined where pieces touch."""
        parts = signal.crossings(signal.knots_to_spans(self.knots), low, high, scale=self.scale)
        return regions.islands(parts, F.lit(True))

    def references(self) -> DataFrame:
        return self.knots.select("ref").distinct().orderBy("ref")

    def at(self, *refs: str, skip: Sequence[str] = ()) -> Signal:
        """The same signal on these references alone (all, if none are named), without those in `skip`."""
        kept = self.knots.where(F.col("ref").isin(*refs)) if refs else self.knots
        return replace(self, knots=kept.where(~F.col("ref").isin(*skip)) if skip else kept)

    def after(self, ref: str, pos: int) -> DataFrame:
        """Every position of a reference beyond pos, in order: pieces that end before it are never read out."""
        pieces = signal.knots_to_spans(self.knots.where(F.col("ref") == ref)).where(F.col("end1") > pos + 1)
        cut = pieces.withColumn("pos", F.explode(F.expr(f"sequence(greatest(start1, {int(pos)} + 1), end1 - 1)")))
        return cut.select("ref", "pos", (signal.interpolated(F.col("pos")) * F.lit(float(self.scale))).alias("cov")).orderBy("pos")

    def bytes(self, ref: str) -> Iterator[int]:
        """Rounded values of a reference in order, from its first knot on, each as a byte (its lowest 8 bits)."""
        rows = self.scan().where(F.col("ref") == ref).orderBy("pos").select(signal.half_up(F.col("cov")).alias("v"))
        for r in rows.toLocalIterator():
            yield r["v"] & 255

    def spliced(self, variant_depths: DataFrame) -> Signal:
        """The signal with knots at variants(ref, pos, dp) inside its pieces: their depth stands at their position
        alone. A variant without a depth leaves the value that is there."""
        return replace(self, knots=variants.spliced(self.knots, variant_depths))


def compress(
    spark: SparkSession, source: str | DataFrame, out: str, method: str = "PERC", parameter: float | None = 0.2, roi: DataFrame | None = None,
    variant_depths: DataFrame | None = None, read_filter: str | None = None, scale: float = 1.0, weight_by_x0: bool = False, block_size: int = 1_000_000, compression: str = "zstd",
) -> None:
    """Reads a signal (a path, by extension, or spans), keeps regions, lets variants override, quantizes and stores it."""
    spans = source if isinstance(source, DataFrame) else text.read_signal(spark, source, scale, read_filter, weight_by_x0)
    if roi is not None:
        spans = regions.in_regions(spans, roi)
    if variant_depths is not None:
        spans = variants.override(spans, variant_depths)
    spans = spans.withColumn("cov", signal.half_up(F.col("cov")).cast("long"))
    q = quantizer(method, parameter)
    knots = codec.lossy_knots(spans, q)
    medians = {r["category"]: r["median"] for r in stats.medians(stats.histogram(spans)).collect()}  # three categories and OTHER
    meta = {"method": method, "parameter": "" if parameter is None else parameter} | {f"median-{k}": v for k, v in medians.items()}
    store.write_store(knots, out, meta, block_size, compression)


def load(spark: SparkSession, path: str, scale: float | str = 1.0, lengths: DataFrame | None = None) -> Signal:
    """Opens a stored signal; scale may be a number or 'median' or 'median*X', by the stored autosomal median."""
    meta = {r["key"]: r["value"] for r in store.describe(spark, path).collect()}
    factor = median_factor(scale, float(meta["median-AUTOSOME"])) if isinstance(scale, str) else float(scale)
    q = quantizer(meta["method"], float(meta["parameter"]) if meta["parameter"] else None)
    return Signal(spark, store.read_store(spark, path).drop("block_id"), q, factor, lengths, meta)
