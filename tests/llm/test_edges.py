"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalloom.llm import ann, htmltext, langid, lines, media, mixing, neardup, packing, tokens, toxicity
from signalloom.llm.queries import split_pattern, tokenizer

LONG = "and the words go on and on, one after another. " * 6000
ROWS = [
    (1, "one line of words here\nand a second line\nthird", "en", "a", 5), (1, "one line of words here\nand a second line\nthird", "en", "a", 5),
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", None, "b", 4), (5, LONG, "en", "b", len(LONG)), (6, LONG + "end", "fr", None, None),
    (None, "one line of words here\nand a second line\nthird", "en", "a", 5), (None, None, None, None, None), (7, "12 345 !!", "de", "a", 9), (8, "Ünïcödé 日本語 \U0001f600", "de", "a", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    # extra columns named like internal ones, and like the table's own but for case
    return df.withColumns({"size": F.lit(1), "key": F.lit("x"), "node": F.lit(2.0), "_c0": F.lit(0), "target": F.array(F.lit(1))}).select("*", F.lit("y").alias("TEXT"), F.lit(9).alias("Doc_Id"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def packed(d):
    return packing.packed(d, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


OPERATORS = {
    "lines": lines.dedup_lines, "tokens": lambda d: tokens.token_counts(d, tokenizer("piece_bpe_32k.model")), "neardup": neardup.near_duplicates,
    "langid": langid.identified, "mixing": mixing.mixed_sizes, "media": lambda d: media.media_features(media.encode_media(d)),
    "toxicity": lambda d: toxicity.scored(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, empty, name):
    assert len(OPERATORS[name](docs).collect()) == len(ROWS)
    assert OPERATORS[name](empty).count() == 0


def test_packing_holds_every_id(docs, empty):
    got = packed(docs).collect()
    assert sum(r["length"] for r in got if r["start"] == 0 or True) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert packed(empty).count() == 0


def test_lines_of_odd_rows(docs):
    got = {(r[0], r[4]): (r[-2], r[-1]) for r in lines.dedup_lines(docs).collect()}
    assert got[None, 5] == (3, 3)  # a null id comes after all others
    assert got[1, 5] == (3, 0) and got[2, None] == (0, 0) and got[4, 4] == (0, 0)


def test_languages_of_odd_rows(docs):
    got = {r[0]: (r[-3], r[-2]) for r in langid.identified(docs).collect()}
    assert got[2] == ("und", 0.0) and got[3] == ("und", 0.0) and got[7] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())


def test_near_duplicates_of_odd_rows(docs):
    got = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert [r for r in got if r[0] is None and r[1]] == [(None, r[1], 1, False) for r in got if r[0] is None and r[1]]
    assert {r[0]: r[2] for r in got}[6] == 5


def test_mixing_counts_null_sources_last(docs):
    got = {r["doc_id"]: r for r in mixing.mixed_sizes(docs).collect() if r["doc_id"] is not None}
    assert got[2]["size"] == 0 and got[2]["taken"] == 0
    assert got[6]["source_size"] == got[6]["size"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a<p>b &amp; c"), (4, "u", "plain"), (5, "u", "<" * 1000 + "<p>x</p><!-- never closed <p>y")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in htmltext.extracted(df).collect()}
    assert got[1] == "" and got[2] == "" and got[None] == "a\n\nb & c" and got[4] == "plain" and "x" in got[5]


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("x"))
    got = sorted(tuple(r) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 0, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, empty, tmp_path):
    full = spark.createDataFrame(ROWS, empty.schema)
    more = full.withColumns({c: F.lit(1) for c in ("rejected", "score", "lang_pred", "n_lines", "n_deleted", "copies", "starts", "_row", "size", "nil")})
    for k, start in enumerate((full, more, empty)):
        d = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{i}")
            stage(spark, d, "").write.parquet(path)
            d = spark.read.parquet(path)
            if i < 4:
                assert d.columns == start.columns


def test_stages_with_names_that_differ_by_case(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0
