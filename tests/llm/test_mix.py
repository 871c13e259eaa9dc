"""What is taken of each source, with hashes turned towards its target."""

import collections

import pytest
from pyspark.sql import functions as F

from signalloom.llm import mixing
from signalloom.llm.common import table


@pytest.mark.parametrize(("sf", "off"), [("0.01", 0.08), ("0.1", 0.03)])
def test_each_source_comes_near_its_target(spark, sf, off):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents")
    rows = mixing.mixed_sizes(docs, turns=mixing.TURNS).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target", "source_size").agg(F.sum("taken").alias("t"), F.max(F.col("copies")).alias("c"), F.count("*").alias("n")).collect()
    assert len(rows) > 3 and all(r["c"] <= 3 for r in rows)
    heavy = [r for r in rows if r["n"] >= 20]
    assert heavy and all(abs(r["t"] / r["target"] - 1) <= off for r in heavy), [(r["source"], r["t"] / r["target"] - 1) for r in heavy]


def test_turned_copies_are_those_of_the_sizes_and_reruns_agree(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(docs, turns=8).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs.repartition(5), turns=8).collect())
    assert {i: got[i] for i in copies} == copies
    assert mixing.mixed_documents(docs.limit(0), turns=8).count() == 0
