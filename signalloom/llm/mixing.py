"""Mixing sources to target weights: repetition rates per source, then floor(rate) copies and a seeded Bernoulli one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, index_of, picked, stored, unclashed, unit_hash

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 17
#: Turns of the hashes that are tried for each source, where asked for.
TURNS = 32


def word_count(text) -> F.Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def _ranked(sources: DataFrame, parts: int = 16) -> DataFrame:
    """Adds pos, the 0-based place in code point order (null last), without one task seeing all sources:
    ranges of sources are numbered apart, and offset by the counts of the ranges before (`parts` numbers)."""
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(parts, "nil", "source").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets or [(0, 0)], "part int, before long")
    w = Window.partitionBy("part").orderBy("nil", "source")
    return dealt.join(F.broadcast(offset), "part").withColumn("pos", F.row_number().over(w) - 1 + F.col("before")).drop("part", "before")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """nil, source, source_size, target for sized(source, size).

    Sources in code point order (null last) weigh weights[0], weights[1], ... repeating, and share the sum
    of all sizes. A target stops at cap x source_size; what is cut off is shared again by weight until no
    target is above its cap. A round is one aggregate of two numbers; targets only rise, so rounds end.
    """
    sums = sized.select(F.col("source").isNull().alias("nil"), F.coalesce("source", F.lit("")).alias("source"), "size")
    sums = stored(sums.groupBy("nil", "source").agg(F.sum("size").alias("source_size")), "sources")
    n = sums.count()
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("pos") % len(weights)).cast("int")]
    ranked = stored(_ranked(sums).withColumn("weight", weight.cast("long")), "weights", n)
    big = "decimal(38,0)"
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cut, open_weight, capped = 0, None, F.lit(False)
    while True:
        got = ranked.agg(F.sum(F.when(capped, limit).otherwise(0)).alias("c"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("w")).first()
        now = (got["c"] or 0, got["w"] or 0)
        if now == (cut, open_weight):
            break
        cut, open_weight = now
        if not open_weight:
            break
        capped = F.col("weight").cast(big) * F.lit(total - cut).cast(big) > limit.cast(big) * F.lit(open_weight).cast(big)
    share = F.col("weight").cast("double") * float(total - cut) / float(open_weight or 1)
    return ranked.select("nil", "source", "source_size", F.when(capped, limit.cast("double")).otherwise(share).alias("target"))


def _copies(u) -> F.Column:
    """floor(rate) and one more with a probability of what is left of the rate, as the uniform number u says."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return F.floor(rate) + (u < rate - F.floor(rate)).cast("long")


def _joined(rows: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """rows with the columns of their source's row of targets, which is broadcast only if they are counted to be few."""
    few = targets.count() <= BROADCAST_KEYS
    right = targets.withColumnsRenamed({"nil": "_nil", "source": "_src"})
    on = (F.col(source).isNull() == F.col("_nil")) & (F.coalesce(F.col(source), F.lit("")) == F.col("_src"))
    return rows.join(F.broadcast(right) if few else right, on).drop("_nil", "_src")


def with_turns(targets: DataFrame, sized: DataFrame, seed: int, turns: int = TURNS) -> DataFrame:
    """targets with `turn`: what is added, mod 1, to the hashes of a source's documents so that what is taken of it comes
    nearest to its target, of `turns` equal steps, the smaller one of equals.

    A turned hash is as uniform as the hash, so every document keeps its probability. All steps are summed in one
    aggregate by source, combined before its shuffle. sized has doc_id, source, size.
    """
    u = unit_hash(F.col("doc_id"), F.lit(seed))
    rows = _joined(sized.withColumn("_u", u), targets, "source")
    taken = [F.sum(F.col("size") * _copies(F.pmod(F.col("_u") + k / turns, F.lit(1.0)))).alias(f"t{k}") for k in range(turns)]
    sums = rows.groupBy(F.col("source").isNull().alias("nil"), F.coalesce("source", F.lit("")).alias("source"), "target").agg(*taken)
    off = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k / turns).alias("turn")) for k in range(turns)])
    best = sums.select("nil", "source", F.array_min(off)["turn"].alias("turn"))
    return stored(targets.join(best, ["nil", "source"], "left").withColumn("turn", F.coalesce("turn", F.lit(0.0))), "turns")


def _with_copies(rows: DataFrame, targets: DataFrame, doc_id: str, source: str, seed: int) -> DataFrame:
    """Adds source_size, target and copies."""
    u = unit_hash(F.col(doc_id), F.lit(seed))
    if "turn" in targets.columns:
        u = F.pmod(u + F.col("turn"), F.lit(1.0))
    return _joined(rows, targets, source).withColumn("copies", _copies(u)).drop("turn")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, turns: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row.

    size is the number of words of the whole text; taken = size x copies. The copy decided by chance
    depends on doc_id and seed alone, so reruns and retried tasks agree; repeated rows decide alike.
    Null texts have size 0; null sources are a source of their own, last; a source of size 0 has target 0. With more
    than one of `turns` the hashes of each source are turned to come near its target (with_turns).
    """
    sized = picked(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", word_count("text").alias("size"))
    sized = stored(sized, "sized")
    targets = source_targets(sized)
    out = _with_copies(sized, targets if turns == 1 else with_turns(targets, sized, seed, turns), "doc_id", "source", seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, turns: int = 1) -> DataFrame:
    """The mix itself: each row of docs as often as its copies say, all columns kept, of any name.

    Null and blank texts have size 0 but are copied by their source's rate like others; null sources are a
    source of their own; repeated rows are copied alike; a source of size 0 and an empty table give no rows.
    `turns` is as in mixed_sizes.
    """
    flat, i, t, s = unclashed(docs), index_of(docs, id_col), index_of(docs, text_col), index_of(docs, source_col)
    sized = flat.select(F.col(f"_c{i}").alias("doc_id"), F.col(f"_c{s}").alias("source"), word_count(f"_c{t}").alias("size"))
    if turns > 1:
        sized = stored(sized, "sized")
    targets = source_targets(sized)
    out = _with_copies(flat, targets if turns == 1 else with_turns(targets, sized, seed, turns), f"_c{i}", f"_c{s}", seed)
    out = out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*flat.columns).toDF(*docs.columns)


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT source, s, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sums),
total AS (SELECT CAST(sum(s) AS BIGINT) AS t, CAST(sum(w) AS BIGINT) AS w FROM ranked),
cum AS (SELECT source, s, r.w, t,
    t - coalesce(sum({CAP} * s) OVER o, 0) AS left_t, total.w - coalesce(sum(r.w) OVER o, 0) AS left_w
  FROM ranked r, total WINDOW o AS (ORDER BY {CAP}.0 * s / r.w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (CAST(w AS HUGEINT) * left_t > CAST({CAP} * s AS HUGEINT) * left_w) AS cap FROM cum),
fin AS (SELECT max(t) - coalesce(sum({CAP} * s) FILTER (cap), 0) AS t, coalesce(sum(w) FILTER (NOT cap), 1) AS w FROM capped),
targets AS (SELECT c.source, CAST(c.s AS BIGINT) AS s,
    CASE WHEN cap THEN CAST({CAP} * c.s AS DOUBLE) ELSE CAST(c.w AS DOUBLE) * CAST(fin.t AS DOUBLE) / CAST(fin.w AS DOUBLE) END AS target FROM capped c, fin),
rated AS (SELECT d.doc_id, d.size, x.source, x.s AS source_size, x.target, CASE WHEN x.s > 0 THEN x.target / x.s ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), '{SEED}')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized d JOIN targets x ON d.source IS NOT DISTINCT FROM x.source),
turned AS (SELECT *, CAST(k AS DOUBLE) / {TURNS} AS turn, CAST(floor(rate) + CAST(u + turn - floor(u + turn) < rate - floor(rate) AS INT) AS BIGINT) AS copies
  FROM rated, (SELECT unnest(range({TURNS})) AS k)),
best AS (SELECT source, turn FROM (
    SELECT source, turn, row_number() OVER (PARTITION BY source ORDER BY abs(CAST(sum(size * copies) AS DOUBLE) - max(target)), turn) AS place FROM turned GROUP BY source, turn)
  WHERE place = 1)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(t.size * t.copies AS BIGINT) AS taken, t.copies
FROM turned t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.turn = b.turn"""
