"""Repeated ids in training, columns of any type, rows without an id, and what a filter's pooling computes."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalloom.llm import langid, lines, neardup, toxicity

WORDS = "one line of words here that goes on for a while and then ends with this last word of all"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with a struct whose field has a space, a map, an array of structs and a binary column."""
    rows = [(1, WORDS, "en", "a", 5), (1, WORDS, "en", "a", 6), (2, WORDS + " more", "en", "b", 7), (None, WORDS, None, "a", 8), (None, "a text without an id that stands here alone and twice", "en", "a", 9), (None, "a text without an id that stands here alone and twice", "en", "a", 9), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({
        "s": F.struct(F.lit(1).alias("a b"), F.col("source").alias("x`y")), "m": F.create_map(F.lit("k"), F.col("n_chars")),
        "l": F.array(F.struct(F.lit("z").alias("q-r"))), "b": F.col("text").cast("binary"), "d": F.lit("2020-01-01").cast("date"),
    })


def test_columns_of_any_type_pass_through(spark, odd):
    for made in (langid.identified(odd), lines.dedup_lines(odd), toxicity.scored(odd, None)):
        assert made.select(*odd.columns).schema == odd.schema and len(made.collect()) == 7
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "").collect()


def test_rows_without_id_are_linked(spark, odd):
    got = [tuple(r) for r in neardup.drop_near_duplicates(odd).select("doc_id", "text", "n_chars").collect()]
    assert sorted(got, key=str) == sorted([(1, WORDS, 5), (None, "a text without an id that stands here alone and twice", 9), (3, None, None)], key=str)
    base = [f"word{i}" for i in range(60)]
    near = [" ".join([*base[:-k], *("new" for _ in range(k))]) if k else " ".join(base) for k in range(4)]
    df = spark.createDataFrame([(None, t) for t in near] + [(None, near[0])], "doc_id long, text string")
    assert neardup.drop_near_duplicates(df).count() == 1
    marked = neardup.near_duplicates(df.union(spark.createDataFrame([(9, near[3])], df.schema))).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in marked} == {(None, 9, False), (9, 9, True)}
    with pytest.raises(Exception, match="ids must be below"):
        neardup.near_duplicates(spark.createDataFrame([(1 << 62, "x")], "doc_id long, text string")).collect()


def test_one_key_with_a_large_group_and_strangers(spark):
    """A group of copies and texts unlike each other and it, all under one key of a plan of few symbols."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    docs = [" ".join([*base, f"tail{k}"]) for k in range(40)]
    docs += [" ".join([*base[:150], *(f"x{rng.integers(1 << 30)}" for _ in range(150))]) for _ in range(30)]
    docs += [" ".join([*base[:150], *(f"y{k // 2}_{j}" for j in range(150))]) for k in range(10)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    want = {}
    for i, s in enumerate(sets):
        near = [want[j] for j in range(i) if 100 * len(s & sets[j]) >= 85 * len(s | sets[j])]
        want[i] = min(near, default=i)
    old, neardup.BLOCK = neardup.BLOCK, 8  # many blocks
    try:
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 85, p=neardup.Plan(85, 12, 4, 1, 23)).collect()}
    finally:
        neardup.BLOCK = old
    assert got == want


def test_training_samples_are_bounded_and_blind_to_repeats(spark, monkeypatch):
    rows = [(i, f"some words of number {i} in this language", "en" if i % 2 else "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    again = docs.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some words of number 7 in this language").alias("text"), F.lit("en").alias("lang")))
    again = again.unionByName(docs.where("doc_id = 9").withColumn("text", F.lit("another text of the same document")))
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, y, names: seen.append((x.shape[0], sorted(collections.Counter(y.tolist()).items()))))
    for d in (docs, again):
        langid.train(d, per_language=5)
    assert seen[0] == seen[1] == (10, [(0, 5), (1, 5)])
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(40)] + [(7, None), (7, True), (None, True)], "doc_id long, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"))
    seen.clear()
    monkeypatch.setattr(toxicity, "fit", lambda d, y, lang: seen.append(sorted(y.tolist())))
    for d in (docs, again, again.unionByName(docs.where("doc_id = 7").withColumn("text", F.repeat(F.lit("w "), 5000)))):
        toxicity.train(d, labels, per_label=6)
    assert seen == [[0] * 6 + [1] * 6] * 3
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(docs.limit(0), labels) is None
    assert toxicity.train(docs, labels.withColumn("toxic", F.lit(None).cast("int"))) is None
    assert langid.train(docs.limit(0)) is None


@pytest.mark.parametrize("text", ["²½ ①", "Ⅷ ⅷ 12 _ -", "٣٤", "́̂", ""])
def test_no_letter_is_no_language(spark, text):
    docs = spark.createDataFrame([(i, "words in a language", "en") for i in range(8)] + [(100, text, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(docs).collect()}
    assert got[100] == ("und", 0.0) and got[0][0] == "en" and langid.has_letter("1ª") and langid.has_letter("日")


def test_scores_are_the_convolution_over_all_words():
    rng = np.random.default_rng(4)
    filters = [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    m = toxicity.ToxicityModel(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), filters, [rng.normal(size=toxicity.FILTERS) for _ in filters], rng.normal(size=3 * toxicity.FILTERS), 0.1, rng.normal(size=(toxicity.BUCKETS, 2)), np.array([0.3, 0.6, 0.5]))
    for text in ("", "one", "two Words,", " ".join(f"w{i % 37}" for i in range(500))):
        x = [sum(m.embedding[b] for b in toxicity.buckets_of(w)) for w in text.split()]
        pooled = []
        for w, bias in zip(m.filters, m.filter_bias, strict=True):
            for f in range(toxicity.FILTERS):
                values = [bias[f] + sum(float(x[i + j] @ w[j, :, f]) for j in range(len(w))) for i in range(len(x) - len(w) + 1)]
                pooled.append(max(0.0, *values) if values else 0.0)
        p = 1 / (1 + np.exp(-(np.array(pooled) @ m.out + m.bias)))
        votes = sum((m.evidence[toxicity.buckets_of(w)[0]] for w in text.split()), np.zeros(2))
        t = m.thresholds[int(votes.argmax()) if text.split() else 2]
        want = 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / (1 - t)
        assert toxicity.Scorer(m).scores([text])[0] == pytest.approx(want, abs=1e-4)


def test_runs_and_passages_by_brute_force(spark):
    rng = random.Random(9)
    pool = ["a b", "c", "  ", "one two three four five six seven", "one two three four five six seven eight", "\tnine or more words are in this line\r", "字" * 7, "字" * 8, "字 " * 4 + "a b c d"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"only {i} {k}" for k in range(rng.randint(0, 9)))) for i in range(60)]
    runs, single, want = set(), set(), {}
    for i, t in docs:
        ls = t.split("\n")
        solid, gone = [k for k, x in enumerate(ls) if x.strip()], set()
        for a, b in itertools.pairwise(solid):
            gone |= {a, b} if (ls[a], ls[b]) in runs else set()
            runs.add((ls[a], ls[b]))
        for k in solid:
            if len(ls[k].split()) + ls[k].count("字") >= 8:
                gone |= {k} if ls[k] in single else set()
                single.add(ls[k])
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and any(want[i] != t for i, t in docs)
