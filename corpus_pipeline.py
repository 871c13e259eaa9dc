"""From raw documents to packed training sequences: five stages, each an operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Results are written
as Parquet and read again between stages, so a lost executor costs the tasks it ran and no stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import langid, lines, mixing, neardup, packing
from signalloom.llm.common import index_of, stored, table, unclashed
from signalloom.llm.queries import split_pattern, tokenizer

#: Similarity of near-duplicates on five-word shingles, in percent.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those without a letter, and the few below its threshold."""
    n = len(docs.columns)
    flat = unclashed(langid.identified(docs))  # the columns of docs, then lang_pred, score, rejected
    return flat.where(~F.col(f"_c{n + 2}")).select(flat.columns[:n]).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines and single passages that stand earlier in the corpus are cut out of the texts; every document stays."""
    n, text = len(docs.columns), f"_c{index_of(docs, 'text')}"
    flat = unclashed(lines.dedup_lines(docs))  # the columns of docs, then n_lines, n_deleted
    if "n_chars" in docs.columns:
        size = f"_c{index_of(docs, 'n_chars')}"
        flat = flat.withColumn(size, F.when(F.col(f"_c{n + 1}") > 0, F.length(text).cast("long")).otherwise(F.col(size)))
    return flat.select(flat.columns[:n]).toDF(*docs.columns)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest id. Rows without an id are linked too and
    go if a row with one is near; null and blank texts stay alone; of repeated rows one stays."""
    return neardup.drop_near_duplicates(docs, SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its hash say; hashes are turned, source by source, so that what is
    taken comes near the target. Null texts and sources, ties and repeated rows are as in mixed_documents."""
    return mixing.mixed_documents(docs, turns=mixing.TURNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 1024. A null text has its closing id alone; copies of a document are
    packed like others."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_neardup", minhash_neardup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
