"""Text formats as DataFrames. Lines are parsed by column expressions; only WIG needs the order of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import prefixed, zygosity
from ..operators.signal import dense_to_spans, merged


def _fields(spark: SparkSession, path: str, skip: str = "^(#|track|browser|$)") -> DataFrame:
    """Tab- or space-separated fields f of the lines that are no comment."""
    lines = spark.read.text(path).where(~F.col("value").rlike(skip))
    return lines.select(_once(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), r"\t"), "f"))


def _once(x, name: str):
    """x as a column that is worked out once a row: filters above a generator do not repeat its expression."""
    return F.inline(F.array(F.struct(x.alias(name))))


def _at(i: int):
    return F.get(F.col("f"), F.lit(i))


def _refs():
    return prefixed(_at(0)).alias("ref"), _at(0).alias("ref_orig")


def read_coverage(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """ref, position (1-based), coverage: spans, gaps between positions kept."""
    rows = _fields(spark, path).select(*_refs(), _at(1).cast("int").alias("pos"), (_at(2).cast("double") * F.lit(float(scale))).alias("cov"))
    return dense_to_spans(rows.where("pos is not null").drop("ref_orig"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """ref, start0, end0, name; comment, track and browser lines are passed over."""
    return _fields(spark, path).select(*_refs(), _at(1).cast("int").alias("start0"), _at(2).cast("int").alias("end0"), _at(3).alias("name"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(*_refs(), _at(1).cast("long").alias("length"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_at(0).alias("ref"), _at(1).alias("alias"))


def renamed(df: DataFrame, aliases: DataFrame, ref: str = "ref") -> DataFrame:
    """References under their alias, where there is one."""
    a = aliases.select(F.col("ref").alias("_ref"), F.col("alias").alias("_alias"))
    out = df.join(a, F.col(ref) == F.col("_ref"), "left").withColumn(ref, F.coalesce("_alias", ref))
    return out.drop("_ref", "_alias")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Exons of a UCSC gene table with a header: gene, ref, strand, start0, end0."""
    t = spark.read.csv(path, sep="\t", header=True)
    t = t.toDF(*[c.lstrip("#") for c in t.columns])
    gene = F.col("name2") if "name2" in t.columns else F.col("name")
    ends = F.arrays_zip(F.split("exonStarts", ",").alias("s"), F.split("exonEnds", ",").alias("e"))
    rows = t.select(gene.alias("gene"), prefixed(F.col("chrom")).alias("ref"), "strand", F.explode(ends).alias("x"))
    rows = rows.select("gene", "ref", "strand", F.expr("try_cast(x.s as int)").alias("start0"), F.expr("try_cast(x.e as int)").alias("end0"))
    return rows.where("start0 is not null and end0 is not null")


def _variants(spark: SparkSession, path: str) -> DataFrame:
    info = F.map_from_entries(F.transform(F.filter(F.split(_at(7), ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.split(x, "=")[0], F.coalesce(F.regexp_extract(x, "=(.*)$", 1), F.lit("")))))
    return _fields(spark, path, "^(#|$)").select(
        *_refs(), _at(1).cast("int").alias("pos"), _at(2).alias("id"), _at(3).alias("ref_allele"), _at(4).alias("alt"),
        F.expr("try_cast(get(f, 5) as double)").alias("qual"), _at(6).alias("filter"), info.alias("info"), F.split(_at(8), ":").alias("format"),
        F.expr("if(size(f) > 9, slice(f, 10, size(f) - 9), cast(array() as array<string>))").alias("samples"),
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with INFO as a map, dp (INFO DP) and the first sample's genotype and zygosity. Plain or gzip."""
    v = _variants(spark, path)
    gt = F.get(F.split(F.get("samples", F.lit(0)), ":"), F.array_position("format", "GT").cast("int") - 1)
    return v.withColumns({"dp": F.col("info")["DP"].try_cast("int"), "genotype": gt}).withColumn("zygosity", zygosity(F.col("genotype")))


def read_gvcf(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """Spans of depth: each record from its position to INFO END (itself, if absent), value DP or the sample's DP or MIN_DP."""
    v = _variants(spark, path)
    sample = lambda name: F.get(F.split(F.get("samples", F.lit(0)), ":"), F.array_position("format", name).cast("int") - 1)
    depth = F.coalesce(*[x.try_cast("double") for x in (sample("MIN_DP"), sample("DP"), F.col("info")["DP"])], F.lit(0.0))
    end = F.coalesce(F.col("info")["END"].try_cast("int"), F.col("pos")) + 1
    rows = v.select("ref", F.col("pos").alias("start1"), end.alias("end1"), (depth * F.lit(float(scale))).alias("cov"))
    return merged(rows.groupBy("ref", "start1").agg(F.max("end1").alias("end1"), F.max_by("cov", "end1").alias("cov")))


def read_wig(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """fixedStep, variableStep and bedGraph data as spans.

    A data line belongs to the last declaration before it in its file. Lines are numbered by partition and
    place; a declaration is carried on inside a partition, and from one to the next by a row a partition.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    lines = lines.where(~F.col("value").rlike(r"^\s*(#|track|browser|$)")).withColumn("part", F.floor(F.col("n") / (1 << 33)))
    key = lambda name: F.regexp_extract("value", rf"\b{name}=(\S+)", 1)
    is_decl = F.col("value").rlike(r"^\s*(fixedStep|variableStep)\b")
    decl = F.when(is_decl, F.struct(F.col("value").rlike(r"^\s*fixed").alias("fixed"), key("chrom").alias("chrom"), key("start").try_cast("int").alias("start"), F.coalesce(key("step").try_cast("int"), F.lit(1)).alias("step"), F.coalesce(key("span").try_cast("int"), F.lit(1)).alias("span"), F.col("n").alias("at")))
    marked = lines.withColumn("d", decl)
    lasts = marked.where("d is not null").groupBy("file", "part").agg(F.max_by("d", "n").alias("d"))
    parts = marked.select("file", "part").distinct().join(lasts, ["file", "part"], "left")
    over = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("file", "part", F.last("d", True).over(over).alias("before"))
    w = Window.partitionBy("file", "part").orderBy("n")
    data = marked.join(carried, ["file", "part"]).withColumn("d", F.coalesce(F.last("d", True).over(w), "before")).where(~is_decl)
    # place after the declaration: rows between it and this one, in this partition and in those before
    counts = data.groupBy("file", "part", "d.at").agg(F.count("*").alias("c"))
    over = Window.partitionBy("file", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "part", F.col("at").alias("_at"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("base"))
    data = data.join(base, (data["file"] == base["file"]) & (data["part"] == base["part"]) & data["d.at"].eqNullSafe(base["_at"])).drop(base["file"]).drop(base["part"])
    i = F.row_number().over(Window.partitionBy("file", "part", "d.at").orderBy("n")) - 1 + F.col("base")
    f = F.split(F.trim("value"), r"\s+")
    bed = F.size(f) >= 4
    start = F.when(bed, f[1].try_cast("int") + 1).when(F.col("d.fixed"), F.col("d.start") + i * F.col("d.step")).otherwise(f[0].try_cast("int"))
    value = F.when(bed, F.get(f, F.lit(3))).when(F.col("d.fixed"), f[0]).otherwise(F.get(f, F.lit(1)))
    end = F.when(bed, f[2].try_cast("int") + 1).otherwise(start + F.col("d.span"))
    rows = data.select(prefixed(F.when(bed, f[0]).otherwise(F.col("d.chrom"))).alias("ref"), start.cast("int").alias("start1"), end.cast("int").alias("end1"), (value.try_cast("double") * F.lit(float(scale))).alias("cov"))
    return merged(rows.where("start1 is not null and cov is not null"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Aligned reads: qname, flag, ref, pos, mapq, cigar, strand, fop_strand, tags, and blocks of aligned bases.

    Blocks are the M, = and X parts of the CIGAR; D and N move on without depth. Unmapped reads are left out.
    fop_strand is the strand of the first read of a pair: a second read's strand turned round.
    """
    return reads_of(_fields(spark, path, "^(@|$)"))


def reads_of(raw: DataFrame) -> DataFrame:
    """What read_sam tells, of the fields f of alignment lines."""
    flag = _at(1).cast("int")
    tags = F.expr("if(size(f) > 11, slice(f, 12, size(f) - 11), cast(array() as array<string>))")
    # of tags that are named twice the first counts, so a malformed line does not stop the job
    all_names = F.transform(tags, lambda t: F.substring_index(t, ":", 1))
    values = F.transform(tags, lambda t: F.regexp_extract(t, "^[^:]*:[^:]*:(.*)$", 1))
    names = F.array_distinct(all_names)
    firsts = F.transform(names, lambda k: F.element_at(values, F.array_position(all_names, k).cast("int")))
    tag_map = F.map_from_arrays(names, F.when(F.size(names) == F.size(tags), values).otherwise(firsts))
    minus = flag.bitwiseAND(F.lit(16)) != 0
    second = flag.bitwiseAND(F.lit(128)) != 0
    steps = F.regexp_extract_all(_at(5), F.lit(r"(\d+[MIDNSHP=X])"))
    start = _at(3).cast("int")

    def step(acc, s):
        n, op = F.regexp_extract(s, r"^(\d+)", 1).cast("int"), F.regexp_extract(s, r"(\D)$", 1)
        moves = op.isin("M", "=", "X", "D", "N")
        block = F.array(F.struct(acc["at"].alias("start1"), (acc["at"] + n).alias("end1")))
        return F.struct(F.when(moves, acc["at"] + n).otherwise(acc["at"]).alias("at"), F.when(op.isin("M", "=", "X"), F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    none = F.expr("cast(array() as array<struct<start1: int, end1: int>>)")
    blocks = F.aggregate(steps, F.struct(start.alias("at"), none.alias("blocks")), step)["blocks"]
    rows = raw.where((flag.bitwiseAND(F.lit(4)) == 0) & (_at(2) != "*"))
    return rows.select(
        _at(0).alias("qname"), flag.alias("flag"), prefixed(_at(2)).alias("ref"), start.alias("pos"), _at(4).cast("int").alias("mapq"), _at(5).alias("cigar"),
        F.when(minus, "-").otherwise("+").alias("strand"), F.when(minus != second, "-").otherwise("+").alias("fop_strand"), tag_map.alias("tags"), blocks.alias("blocks"),
    )


def read_blocks(reads: DataFrame, weight_by_x0: bool = False) -> DataFrame:
    """(ref, start1, end1, weight) of aligned blocks; the weight is 1, or 1 / X0 where the tag is set."""
    w = F.lit(1.0)
    if weight_by_x0:
        x0 = F.col("tags")["X0"].try_cast("double")
        w = F.when(x0 > 0, 1 / x0).otherwise(1.0)
    made = reads.select("ref", w.alias("weight"), _once(F.col("blocks"), "blocks"))
    return made.select("ref", F.explode("blocks").alias("b"), "weight").select("ref", "b.start1", "b.end1", "weight")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide table 'Pos <tab> track ...' with # lines before it, as (ref, pos, track, cov)."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#")
    where, tracks = t.columns[0], t.columns[1:]
    long = t.select(F.col(f"`{where}`").alias("at"), F.explode(F.array(*[F.struct(F.lit(c).alias("track"), F.col(f"`{c}`").alias("cov")) for c in tracks])).alias("x"))
    return long.select(prefixed(F.regexp_extract("at", r"^(.*):\d+$", 1)).alias("ref"), F.regexp_extract("at", r":(\d+)$", 1).cast("int").alias("pos"), "x.track", F.col("x.cov").try_cast("double").alias("cov"))


def filtered_blocks(reads: DataFrame, read_filter=None, weight_by_x0: bool = False) -> DataFrame:
    """read_blocks of the reads that a filter keeps; tags are read once for all its conditions."""
    from ..operators.filters import read_filter as compiled

    kept = reads.select(*[c for c in reads.columns if c != "tags"], _once(F.col("tags"), "tags")).where(compiled(read_filter))
    return read_blocks(kept, weight_by_x0)


def read_signal(spark: SparkSession, path: str, scale: float = 1.0, read_filter=None, weight_by_x0: bool = False) -> DataFrame:
    """Spans from a file, by its extension: sam, bam, wig, vcf, gvcf or gz; all else is three columns."""
    from ..operators.signal import pileup

    name = path.lower().rstrip("/")
    if name.endswith((".sam", ".bam")):
        from .bam import read_bam

        reads = (read_sam if name.endswith(".sam") else read_bam)(spark, path)
        blocks = filtered_blocks(reads, read_filter, weight_by_x0)
        return pileup(blocks, weight=F.col("weight") if weight_by_x0 else None)
    if name.endswith((".vcf", ".gz", ".gvcf")):
        return read_gvcf(spark, path, scale)
    return read_wig(spark, path, scale) if name.endswith(".wig") else read_coverage(spark, path, scale)


def synthetic_ids(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """prefix followed by 0, 1, ..."""
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias("id"))
