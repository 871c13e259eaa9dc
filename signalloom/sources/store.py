"""A signal on disk: knots as Parquet by reference, sorted by position, with a metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codec import blocked


def write_store(knots: DataFrame, path: str, metadata: dict[str, str] | None = None, block_size: int = 1_000_000, compression: str = "zstd") -> None:
    """Folders by reference, files by block and sorted, so row groups hold ranges of positions; metadata as (key, value)."""
    rows = blocked(knots, block_size)
    rows.repartition("ref", "block_id").sortWithinPartitions("ref", "pos").write.mode("overwrite").option("compression", compression).partitionBy("ref").parquet(f"{path}/knots")
    spark = knots.sparkSession
    meta = {"block_size": str(block_size), "compression": compression} | {k: str(v) for k, v in (metadata or {}).items()}
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_store(spark: SparkSession, path: str, ref: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Knots; a reference prunes folders, a range of positions prunes row groups. For values inside a range one knot
    on either side is needed: choose a range that is wide enough, or none."""
    k = spark.read.parquet(f"{path}/knots")
    if ref is not None:
        k = k.where(F.col("ref") == ref)
    if low is not None:
        k = k.where(F.col("pos") >= low)
    if high is not None:
        k = k.where(F.col("pos") <= high)
    return k.select("ref", "pos", "c1", "c2", "block_id")


def load_block(spark: SparkSession, path: str, ref: str, block_id: int) -> DataFrame:
    """The knots of one block, in order, with the first knot of the next one, at which its last piece ends. Folders are
    pruned by reference and row groups by block."""
    k = read_store(spark, path, ref)
    end = k.where(F.col("block_id") == block_id + 1).orderBy("pos").limit(1)
    return k.where(F.col("block_id") == block_id).unionByName(end).orderBy("pos")


def block_of(spark: SparkSession, path: str, ref: str, pos: int) -> int | None:
    """The block that holds the value at a position: that of the last knot up to it; null where there is none, or past the last knot."""
    k = read_store(spark, path, ref)
    got = k.agg(F.max(F.when(F.col("pos") <= pos, F.struct("pos", "block_id"))).alias("k"), F.max("pos").alias("last")).first()
    return None if got["k"] is None or pos > got["last"] else int(got["k"]["block_id"])


def describe(spark: SparkSession, path: str) -> DataFrame:
    """The header as (key, value), in order."""
    return spark.read.parquet(f"{path}/metadata").orderBy("key")
