"""Shared helpers: column picking, shared-storage tables, code shipping, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch: a few MB of text, so a worker's memory stays bounded.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
#: Largest number of 8-byte keys that may be broadcast; beyond it joins shuffle.
BROADCAST_KEYS = 200_000


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and makes this package importable on executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # shuffles are read in tasks of the advised size, not in as many as there are cores: fewer, fuller files
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as e:  # an older Spark without this setting
        if "CANNOT_MODIFY" not in str(e) and "not exist" not in str(e):
            raise
    sc = spark.sparkContext
    if getattr(sc, "_signalloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "signalloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._signalloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; or, only where it is unset and Spark runs in one
    process, as in tests, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="signalloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows of a file of narrow rows, and of rows with signatures or texts, where a table's rows are counted or bounded.
NARROW_ROWS, WIDE_ROWS = 1_000_000, 50_000


def stored(df: DataFrame, name: str, rows: int | None = None, each: int = NARROW_ROWS) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor loses nothing.
    If `rows`, a bound of its rows, is known, it is written in as many tasks as hold `each` of them, not more."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = f"{shared_dir(spark)}/signalloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unclashed(df: DataFrame) -> DataFrame:
    """The same rows under positional names, whatever (equal, or equal but for case) names the columns have."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def index_of(df: DataFrame, name: str) -> int:
    """Position of the column of exactly this name, else the first that equals it but for case."""
    for match in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if match(c):
                return i
    raise ValueError(f"no column {name!r} in {df.columns}")


def picked(df: DataFrame, **names: str) -> DataFrame:
    """picked(df, new="old"): only these columns, under the new names."""
    at = {new: index_of(df, old) for new, old in names.items()}
    return unclashed(df).select(*[F.col(f"_c{i}").alias(new) for new, i in at.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """mapInArrow over whole batches; `rows` returns columns by name in the order of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = rows(b)
                yield pa.RecordBatch.from_arrays([_as_array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of df, of any types, with the fields of `more` after it."""
    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_hash(*columns) -> "F.Column":
    """A reproducible uniform number in [0, 1) from the columns' text (md5, 52 bits); the same in other SQL engines."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
