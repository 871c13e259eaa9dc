"""Packing: extreme texts, layouts, repeated rows, and what is cut."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import packing
from signalloom.llm.common import table
from signalloom.llm.queries import split_pattern, tokenizer

SF = "/root/testdata/sf0.001"


def packed(df):
    return packing.packed(df, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


def library_ids(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", "a" + "\t" * 400_000 + "<|endoftext|> b", "x" * 500_000])
def test_very_long_runs_are_encoded_as_the_library_does(spark, text):
    ids = library_ids(text)
    got = sorted((r["start"], r["length"], r["ids_crc32"]) for r in packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    end = 0
    for start, length, crc in got:
        assert start == end and crc == zlib.crc32(ids[start : start + length].tobytes())
        end += length
    assert end == len(ids)


def test_result_depends_on_the_rows_alone(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same again").alias("text")))
    want = collections.Counter(map(tuple, packed(docs.coalesce(1)).collect()))
    assert collections.Counter(map(tuple, packed(docs.repartition(7)).collect())) == want
    assert sum(n for r, n in want.items() if r[0] == 7 and r[4] == len(library_ids("the same again"))) == 300


def test_fewest_windows_and_whole_rests():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sizes = rng.integers(1, 1024, 300)
        got = packing.fitted(sizes, 1024)
        load, parts = collections.Counter(), collections.defaultdict(list)
        for i, start, n, w in got:
            load[w] += n
            parts[i].append((start, n))
        assert len(load) == -(-sizes.sum() // 1024) and max(load.values()) <= 1024
        assert all(sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and sum(n for _, n in p) == sizes[i] for i, p in parts.items())
        assert len(parts) == 300 and sum(len(p) == 1 for p in parts.values()) > 0.85 * 300
    assert packing.fitted(np.empty(0, np.int64), 1024) == []
