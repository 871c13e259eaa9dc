"""The driver's tables seen as reads, variants, features and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import pileup

DAY0 = "1995-01-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(col: str):
    return F.datediff(F.col(col).cast("date"), F.lit(DAY0).cast("date")) + 1


def _ref(key):
    return F.element_at(F.array(F.lit("chr1"), F.lit("chrX"), F.lit("chrY")), (key % 3 + 1).cast("int"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_returnflag") == "A", "chr1").when(F.col("l_returnflag") == "N", "chrX").otherwise("chrY")
    minus = F.col("l_linestatus") == "O"
    flag = F.when(minus, 16).otherwise(0) + F.when(F.col("l_linenumber") == 7, 1024).when(F.col("l_linenumber") == 6, 512).otherwise(0)
    h0 = F.when(F.col("l_suppkey") % 5 == 0, F.lit(None).cast("string")).otherwise((F.col("l_suppkey") % 3).cast("string"))
    return li.select(
        ref.alias("ref"), _day("l_shipdate").alias("start1"), (_day("l_shipdate") + F.col("l_quantity").cast("int")).alias("end1"),
        F.when(minus, "-").otherwise("+").alias("strand"), flag.alias("flag"), F.round(F.col("l_tax") * 100).cast("int").alias("mapq"),
        F.map_from_arrays(F.array(F.lit("NM"), F.lit("H0")), F.array(F.round(F.col("l_discount") * 100).cast("int").cast("string"), h0)).alias("tags"),
        F.col("l_linestatus").alias("track"), F.col("l_suppkey").alias("supp"),
    )


def track(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spans of the reads of one line status, F or O."""
    return pileup(reads(spark, sf_dir).where(F.col("track") == name).select("ref", "start1", "end1"))


def tracks(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """Spans of n tracks, by supplier."""
    return pileup(reads(spark, sf_dir).select((F.col("supp") % n).cast("string").alias("track"), "ref", "start1", "end1"), ("track",))


def sparse_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with gaps of depth 0: each reference of each supplier is one of its own."""
    return pileup(reads(spark, sf_dir).select(F.concat_ws("_", "ref", F.col("supp").cast("string")).alias("ref"), "start1", "end1"))


def sparse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants, dealt to the references of the first ten suppliers."""
    supplier = (F.pmod(F.col("o_custkey"), F.lit(10)) + 1).cast("string")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), supplier.alias("supp"))
    return variants(spark, sf_dir).join(o, "id").withColumn("ref", F.concat_ws("_", "ref", "supp")).drop("supp")


def sparse_lengths(spark: SparkSession) -> DataFrame:
    refs = [(f"{r}_{s}", 3000) for r in ("chr1", "chrX", "chrY") for s in range(1, 11)]
    return spark.createDataFrame(refs, "ref string, length int")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    mark = F.when(F.col("o_orderpriority").startswith("1"), "PASS").when(F.col("o_orderpriority").startswith("2"), ".").otherwise("LowQual")
    return o.select(
        F.col("o_orderkey").alias("id"), _ref(F.col("o_orderkey")).alias("ref"), _day("o_orderdate").alias("pos"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("dp"),
        mark.alias("filter"), F.when(F.col("o_custkey") % 2 == 0, "HOM").otherwise("HET").alias("zygosity"), (F.col("o_orderkey") % 7 < 4).alias("tumor"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    start = ((F.col("p_partkey") * 37) % 2400).cast("int")
    return p.select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("gene"), _ref(F.col("p_partkey")).alias("ref"), start.alias("start0"), (start + F.col("p_size")).alias("end0"))


def lengths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("chr1", 3000), ("chrX", 3000), ("chrY", 3000)], "ref string, length int")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    hour = F.expr("cast(timestampdiff(HOUR, timestamp'2024-01-01 00:00:00', ts) as int) + 1")
    return e.groupBy(F.col("event_type").alias("ref"), hour.alias("pos")).agg(F.count("*").alias("cov"))


READS = """reads AS (SELECT CASE l_returnflag WHEN 'A' THEN 'chr1' WHEN 'N' THEN 'chrX' ELSE 'chrY' END AS ref,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS start1,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 + CAST(l_quantity AS INT) AS end1,
  CASE l_linestatus WHEN 'O' THEN '-' ELSE '+' END AS strand,
  CASE l_linestatus WHEN 'O' THEN 16 ELSE 0 END + CASE l_linenumber WHEN 7 THEN 1024 WHEN 6 THEN 512 ELSE 0 END AS flag,
  CAST(round(l_tax * 100) AS INT) AS mapq, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 END AS h0,
  l_linestatus AS track, l_suppkey AS supp FROM lineitem)"""
VARIANTS = """variants AS (SELECT o_orderkey AS id, ['chr1', 'chrX', 'chrY'][o_orderkey % 3 + 1] AS ref,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 AS pos, CAST(floor(o_totalprice / 1000) AS BIGINT) AS dp,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'PASS' WHEN o_orderpriority LIKE '2%' THEN '.' ELSE 'LowQual' END AS filter,
  CASE WHEN o_custkey % 2 = 0 THEN 'HOM' ELSE 'HET' END AS zygosity, o_orderkey % 7 < 4 AS tumor FROM orders)"""
FEATURES = """features AS (SELECT p_partkey AS feature_id, p_brand AS gene, ['chr1', 'chrX', 'chrY'][p_partkey % 3 + 1] AS ref,
  (p_partkey * 37) % 2400 AS start0, (p_partkey * 37) % 2400 + p_size AS end0 FROM part)"""
EVENTS = """event_signal AS (SELECT event_type AS ref, date_diff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS pos, count(*) AS cov FROM events GROUP BY ALL)"""


def spans_sql(name: str, source: str, keys: str = "ref") -> str:
    """A common table of spans over (keys, start1, end1) rows of `source`."""
    return f"""{name} AS (SELECT {keys}, pos AS start1, end1, cov FROM (
  SELECT {keys}, pos, lead(pos) OVER w AS end1, CAST(sum(d) OVER w AS BIGINT) AS cov FROM (
    SELECT {keys}, pos, sum(d) AS d FROM (SELECT {keys}, start1 AS pos, 1 AS d FROM {source} WHERE end1 > start1 UNION ALL SELECT {keys}, end1, -1 FROM {source} WHERE end1 > start1)
    GROUP BY {keys}, pos HAVING sum(d) <> 0) WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) WHERE end1 IS NOT NULL)"""


TRACK_F = ",\n".join([READS, spans_sql("f", "(SELECT * FROM reads WHERE track = 'F')")])
TRACK_O = spans_sql("o", "(SELECT * FROM reads WHERE track = 'O')")
TRACKS = ",\n".join([READS, "tr AS (SELECT CAST(supp % 5 AS VARCHAR) AS track, ref, start1, end1 FROM reads)", spans_sql("t", "tr", "track, ref")])
ALL_SPANS = ",\n".join([READS, spans_sql("s", "reads")])
SPARSE = ",\n".join([READS, spans_sql("s", "(SELECT ref || '_' || supp AS ref, start1, end1 FROM reads)")])
SPARSE_VARIANTS = VARIANTS.replace("variants AS (", "variants0 AS (") + """,
variants AS (SELECT v.* REPLACE (v.ref || '_' || (o.o_custkey % 10 + 1) AS ref) FROM variants0 v JOIN orders o ON o.o_orderkey = v.id)"""


def dense_sql(name: str, spans: str, keys: str = "ref") -> str:
    return f"{name} AS (SELECT {keys}, unnest(range(start1, end1)) AS pos, cov FROM {spans})"


def islands_sql(name: str, spans: str, keep: str, keys: str = "ref") -> str:
    return f"""{name} AS (SELECT {keys}, min(start1) AS start1, max(end1) AS end1 FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY start1) AS run FROM (
    SELECT *, CASE WHEN lag(end1) OVER (PARTITION BY {keys} ORDER BY start1) = start1 THEN 0 ELSE 1 END AS fresh FROM {spans} WHERE {keep})) GROUP BY {keys}, run)"""
