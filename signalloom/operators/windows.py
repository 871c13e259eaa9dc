"""Neighbour and running values along a reference, without one task for each reference.

A window partitioned by reference alone gives a whole reference to one task. Here positions are cut to
tiles; windows run inside a tile, and what crosses a tile border comes from one small row a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Positions of a tile.
TILE = 1 << 20


def _in_tiles(df: DataFrame, keys: Sequence[str], at: str, tile: int) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """(df, stored once and dealt by tile; the columns that name a tile; the keys, from these).

    A null key is a text of its own and a bit of _null, so rows and tile summaries meet by plain equality: rows stay where
    their windows were worked out, and only summaries move. Both come from one shuffle.
    """
    t = stored(df)
    bit = lambda i: F.when(F.col(keys[i]).isNull(), 1 << i).otherwise(0)
    nulls = bit(0)
    for i in range(1, len(keys)):
        nulls = nulls + bit(i)
    names = {f"_p_{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    t = t.withColumns(names | {"_null": nulls, "_tile": F.floor(F.col(at) / tile)}).where("_tile is not null").drop(*keys)
    parts = [*names, "_null", "_tile"]
    back = {k: F.when(F.col("_null").bitwiseAND(F.lit(1 << i)) == 0, F.col(f"_p_{i}").cast(df.schema[k].dataType)) for i, k in enumerate(keys)}
    return t.repartition(*parts), parts, back


def _joined(rows: DataFrame, tiles: DataFrame, parts: list[str]) -> DataFrame:
    """rows with the columns of their tile, which has them named _t_..., as `rows` are where they are."""
    on = rows[parts[0]] == tiles[f"_t{parts[0]}"]
    for p in parts[1:]:
        on = on & (rows[p] == tiles[f"_t{p}"])
    return rows.join(tiles, on)


def along(df: DataFrame, keys: list[str], at: str, before: dict[str, str] | None = None, after: dict[str, str] | None = None, sums: dict[str, Column | str] | None = None, tile: int = TILE) -> DataFrame:
    """Adds columns of the row before and after (new name -> column; null at the ends) and running sums (new
    name -> expression, up to and including the row), in the order of `at` within `keys`.

    Rows and tile summaries both come from df, which is therefore stored once. Keys are texts or whole numbers.
    """
    before, after = before or {}, after or {}
    sums = {k: F.expr(v) if isinstance(v, str) else v for k, v in (sums or {}).items()}
    t, parts, back = _in_tiles(df, keys, at, tile)
    values = {f"_v_{k}": v for k, v in sums.items()}
    near = sorted({*before.values(), *after.values()} or {at})
    w = Window.partitionBy(*parts).orderBy(at)
    over = Window.partitionBy(*parts[:-1]).orderBy("_tile")  # a row a tile
    row, own = F.struct(*near), [c for c in df.columns if c not in keys]
    # _all keeps each column, so that rows and summaries read the same shuffle
    edge = t.groupBy(*parts).agg(F.min_by(row, at).alias("_tile_first"), F.max_by(row, at).alias("_tile_last"), *[F.sum(v).alias(f"_s_{k}") for k, v in sums.items()], F.max(F.xxhash64(*own)).alias("_all")).where("_all is not null")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *[F.col(p).alias(f"_t{p}") for p in parts], F.lag("_tile_last").over(over).alias("_tile_before"), F.lead("_tile_first").over(over).alias("_tile_after"),
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    added = {"_place": F.row_number().over(w), "_next": F.lead(at).over(w)}
    added |= {f"_b_{c}": F.lag(c).over(w) for c in set(before.values())} | {f"_a_{c}": F.lead(c).over(w) for c in set(after.values())}
    added |= {f"_r_{k}": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, v in sums.items()}
    out = _joined(t.withColumns(added), edge, parts)
    new = {n: F.when(F.col("_place") == 1, F.col("_tile_before")[c]).otherwise(F.col(f"_b_{c}")) for n, c in before.items()}
    new |= {n: F.when(F.col("_next").isNull(), F.col("_tile_after")[c]).otherwise(F.col(f"_a_{c}")) for n, c in after.items()}
    new |= {k: F.coalesce(F.col(f"_r_{k}"), F.lit(0)) + F.col(f"_o_{k}") for k in sums}
    kept = {c: back[c] if c in back else F.col(c) for c in df.columns}
    return out.select(*[x.alias(c) for c, x in (kept | new).items()])


def with_neighbours(df: DataFrame, keys: list[str], at: str, before: dict[str, str] | None = None, after: dict[str, str] | None = None, tile: int = TILE) -> DataFrame:
    return along(df, keys, at, before, after, tile=tile)


def with_running(df: DataFrame, keys: list[str], at: str, sums: dict[str, Column | str], tile: int = TILE) -> DataFrame:
    return along(df, keys, at, sums=sums, tile=tile)


def with_runs(df: DataFrame, keys: Sequence[str], at: str, new: Callable[[Column, Column], Column], run: str = "_run", before: dict[str, str] | None = None, after: dict[str, str] | None = None, tile: int = TILE) -> DataFrame:
    """Adds `run`, the number of rows so far (from 0 at the first one) for which new(row before, row) holds, and
    neighbours as `along` does.

    One pass over tiles: what a tile's first row is compared with, and how many runs begin before it, come from a row
    a tile. df is stored once.
    """
    keys, before, after = list(keys), before or {}, after or {}
    t, parts, back = _in_tiles(df, keys, at, tile)
    own = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*parts).orderBy(at)
    rows = t.withColumns({"_place": F.row_number().over(w), "_next": F.lead(at).over(w)} | {f"_b_{c}": F.lag(c).over(w) for c in own} | {f"_a_{c}": F.lead(c).over(w) for c in set(after.values())})
    # keys are equal on both sides, so `new` may name them too
    here = {c: F.col(c) for c in own} | back
    fresh = new({c: F.col(f"_b_{c}") for c in own} | back, here)
    rows = rows.withColumn("_fresh", F.when((F.col("_place") > 1) & fresh, 1).otherwise(0))
    row = F.struct(*own)
    tiles = rows.groupBy(*parts).agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"), F.sum("_fresh").alias("_n"))
    over = Window.partitionBy(*parts[:-1]).orderBy("_tile")  # a row a tile
    tiles = tiles.withColumns({"_tile_before": F.lag("_last").over(over), "_tile_after": F.lead("_first").over(over)})
    of = lambda x: {c: F.col(x)[c] for c in own} | back
    tiles = tiles.withColumn("_first_new", F.when(F.col("_tile_before").isNotNull() & new(of("_tile_before"), of("_first")), 1).otherwise(0))
    so_far = F.coalesce(F.sum(F.col("_n") + F.col("_first_new")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiles = tiles.select(*[F.col(p).alias(f"_t{p}") for p in parts], "_tile_before", "_tile_after", (so_far + F.col("_first_new")).alias("_base"))
    out = _joined(rows.withColumn("_so_far", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))), tiles, parts)
    added = {run: (F.col("_base") + F.col("_so_far")).cast("long")}
    added |= {k: F.when(F.col("_place") == 1, F.col("_tile_before")[c]).otherwise(F.col(f"_b_{c}")) for k, c in before.items()}
    added |= {k: F.when(F.col("_next").isNull(), F.col("_tile_after")[c]).otherwise(F.col(f"_a_{c}")) for k, c in after.items()}
    kept = {c: back[c] if c in back else F.col(c) for c in df.columns}
    return out.select(*[x.alias(c) for c, x in (kept | added).items()])


def running_total(df: DataFrame, at: str, value: str, name: str, parts: int = 32) -> tuple[DataFrame, int]:
    """(df with `name`: the sum of `value`, whole numbers, up to and including the row in the order of `at`; the sum of all).

    Ranges of rows are summed apart and offset by the sums of the ranges before, `parts` numbers in the driver, so no
    task holds the whole table.
    """
    t = stored(df.repartitionByRange(parts, at).withColumn("_part", F.spark_partition_id()))
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in t.groupBy("_part").agg(F.sum(value).alias("n")).collect()):
        offsets.append((part, total))
        total += int(n or 0)
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _base long")
    w = Window.partitionBy("_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return t.join(F.broadcast(base), "_part").withColumn(name, F.sum(value).over(w) + F.col("_base")).drop("_part", "_base"), total
