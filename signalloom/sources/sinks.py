"""Exports. Each is a DataFrame of lines or rows first; writing is one call, a file a partition, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import genomic_order
from ..operators.signal import half_up, spans_to_dense


def without_leading_zeros(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense rows from the first position of positive coverage of each reference on."""
    keys = [*by, "ref"]
    first = spans.where("cov > 0").groupBy(*keys).agg(F.min("start1").alias("_from"))
    kept = spans.join(first, keys).where(F.col("end1") > F.col("_from")).withColumn("start1", F.greatest("start1", "_from")).drop("_from")
    return spans_to_dense(kept, by)


def zooms(spans: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Max, min and median of coverage in windows of 2^z positions, for each level z. Windows hold weighted
    values (the lengths of spans in them), so no position is made."""
    z = F.explode(F.array(*[F.lit(x) for x in levels])).alias("zoom")
    s = spans.select("ref", "start1", "end1", "cov", z).withColumn("_w", F.expr("cast(shiftleft(1L, zoom) as bigint)"))
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start1") / F.col("_w")), F.floor((F.col("end1") - 1) / F.col("_w")))))
    n = F.least(F.col("end1"), (F.col("bin") + 1) * F.col("_w")) - F.greatest(F.col("start1"), F.col("bin") * F.col("_w"))
    s = s.withColumn("_n", n.cast("long"))
    return s.groupBy("ref", "zoom", "bin").agg(F.max("cov").alias("max_cov"), F.min("cov").alias("min_cov"), F.percentile("cov", F.lit(0.5), F.col("_n")).alias("median_cov"))


def wig_lines(spans: DataFrame) -> DataFrame:
    """(ref, start1, line): a variableStep declaration and value for each span of rounded coverage."""
    text = F.concat(F.lit("variableStep chrom="), "ref", F.lit(" span="), (F.col("end1") - F.col("start1")).cast("string"), F.lit("\n"), F.col("start1").cast("string"), F.lit(" "), half_up(F.col("cov")).cast("string"))
    return spans.select("ref", "start1", text.alias("line"))


def bed_lines(regions: DataFrame, names: str = "region") -> DataFrame:
    """(ref, start1, line): 0-based BED lines, named by their place in their reference."""
    from ..operators.windows import with_running

    n = with_running(regions, ["ref"], "start1", {"_n": F.lit(1).cast("long")})
    text = F.concat_ws("\t", "ref", (F.col("start1") - 1).cast("string"), (F.col("end1") - 1).cast("string"), F.concat(F.lit(names), F.col("_n").cast("string")))
    return n.select("ref", "start1", text.alias("line"))


def coverage_lines(dense: DataFrame) -> DataFrame:
    return dense.select("ref", F.col("pos").alias("start1"), F.concat_ws("\t", "ref", F.col("pos").cast("string"), half_up(F.col("cov")).cast("string")).alias("line"))


def vcf_lines(variants: DataFrame, field: str, value: str) -> DataFrame:
    """VCF lines whose INFO got field=value, where the value is not null."""
    info = F.array_join(F.transform(F.map_entries("info"), lambda x: F.when(x["value"] == "", x["key"]).otherwise(F.concat(x["key"], F.lit("="), x["value"]))), ";")
    more = F.when(F.col(value).isNotNull(), F.concat(F.lit(f"{field}="), F.col(value).cast("string")))
    both = F.concat_ws(";", F.when(info != "", info), more)
    cols = [F.col("ref_orig"), F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), F.col("ref_allele"), F.col("alt"), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.coalesce("filter", F.lit(".")), F.coalesce(F.when(both != "", both), F.lit("."))]
    rest = F.when(F.col("format").isNotNull(), F.concat_ws("\t", F.array_join("format", ":"), F.array_join("samples", "\t")))
    return variants.select("ref", F.col("pos").alias("start1"), F.concat_ws("\t", *cols, rest).alias("line"))


def wide(matrix: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """The long matrix as 'Pos, track, ...': the tracks are given, so no pass looks for them."""
    at = F.concat("ref", F.lit(":"), F.col("pos").cast("string")).alias("Pos")
    return matrix.groupBy("ref", "pos").pivot("track", list(tracks)).agg(F.first("cov")).select(at, *[F.col(f"`{t}`") for t in tracks])


def in_order(lines: DataFrame, header: str | None = None, trailer: str | None = None, references: Sequence[str] | None = None) -> DataFrame:
    """(value): lines in the order of references and of start1, as write_lines writes them."""
    rank = F.lit(0)
    if references is not None:
        rank = F.coalesce(F.nullif(F.array_position(F.lit(list(references)), F.col("ref")), F.lit(0)), F.lit(len(references) + 1))
    out = lines.select(F.lit(1).alias("_part"), rank.cast("long").alias("_rank"), "ref", F.col("start1").cast("long").alias("start1"), "line")
    for part, text in ((0, header), (2, trailer)):
        if text is not None:
            one = lines.sparkSession.range(1).select(F.lit(part).alias("_part"), F.lit(0).cast("long").alias("_rank"), F.lit("").alias("ref"), F.lit(0).cast("long").alias("start1"), F.lit(text).alias("line"))
            out = out.unionByName(one)
    # keys are columns: a sort would work out an expression anew for each comparison
    out = out.withColumn("_o", genomic_order(F.col("ref"))).select("_part", "_rank", F.col("_o.rank").alias("_o1"), F.col("_o.number").alias("_o2"), F.col("_o.name").alias("_o3"), "start1", "line")
    return out.orderBy("_part", "_rank", "_o1", "_o2", "_o3", "start1").select(F.col("line").alias("value"))


def write_lines(lines: DataFrame, path: str, header: str | None = None, trailer: str | None = None, references: Sequence[str] | None = None) -> None:
    """Text files in the order of references and of start1, between a header and a trailer, if there are any. References
    go in the order given (such as that of their first appearance; others come last), else in genomic order."""
    in_order(lines, header, trailer, references).write.mode("overwrite").text(path)


def write_routes(variants: DataFrame, path: str) -> None:
    """A folder for each route."""
    variants.write.mode("overwrite").partitionBy("route").parquet(path)
