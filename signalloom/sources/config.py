"""Options of a build from a properties file, then from the session, then defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Session settings that stand in for options a file does not have begin so.
PREFIX = "signalloom."
#: What `compress` takes, with the kind of each value.
KINDS = {"method": str, "parameter": float, "read_filter": str, "scale": float, "weight_by_x0": lambda v: v.strip().lower() == "true", "block_size": int, "compression": str}


def read_options(spark: SparkSession, path: str | None = None) -> dict:
    """Keyword arguments for `api.compress`: lines `name = value` (or `name: value`) of a small file, # and ! begin comments;
    names that the file lacks are looked up as session settings. Unknown names are refused."""
    found = {}
    if path is not None:
        lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#!]|$)")).limit(1000).collect()
        for r in lines:
            head, mark, tail = r["value"].partition("=" if "=" in r["value"] else ":")
            if not mark or head.strip() not in KINDS:
                raise ValueError(f"no option: {r['value']!r}")
            found[head.strip()] = tail.strip()
    for name in KINDS:
        value = spark.conf.get(PREFIX + name, None)
        if name not in found and value is not None:
            found[name] = value
    return {name: KINDS[name](value) for name, value in found.items()}
