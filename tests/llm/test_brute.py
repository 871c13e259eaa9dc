"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalloom.llm import ann, components, htmltext, langid, lines, media, mixing, neardup, packing, queries, tokens
from signalloom.llm.common import table

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_are_the_brute_force_groups(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice((3, 8, 60, 200)))]
        for _ in range(12):
            t = list(text)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs[len(docs)] = " ".join(t).upper() if rng.random() < 0.2 else "  ".join(t)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in docs.items()}
    want = groups(sets, percent)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(df, percent).collect()) == sorted(i for i in want if want[i] == i)


def test_signatures_within_the_limit_share_a_key():
    p, rng = neardup.plan(85), np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, p.symbols)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(p.symbols, p.limit, replace=False)] ^= 1
    ka, kb = neardup.index_keys(a, p), neardup.index_keys(b, p)
    assert (ka == kb).any(1).all()
    assert all(ka[i, s] == kb[i, s] and not (ka[i, :s] == kb[i, :s]).any() for i in range(200) for s in neardup.first_slots(a[i], b[i : i + 1], p))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (300, 301), (None, 5)]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def test_token_counts(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in queries.op3_token_counts(spark, SF).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(sp.encode(t or "")) for i, t in texts.items()}


def tokenizer_path(name):
    return queries.tokenizer(name)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (100, 16), (500, 50)])
def test_overlap_resynchronisation(texts, chunk, overlap):
    model = tokens.load(tokenizer_path("piece_bpe_32k.model"))
    odd = ["x" * 999, " " * 700, "é" * 300 + " a" * 300, "日本語" * 200, "a\n" * 400, "<s> </s> " * 80, "\U0001f600 " * 200, "ab  " * 150]
    for t in [*odd, *list(texts.values())[:40]]:
        assert model.count(t, chunk, overlap) == len(model.sp.encode(t))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: np.array(slow.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in texts.items()}
    got = queries.op4_packing(spark, SF).collect()
    at, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces, size in [(sorted(p), len(ids[i])) for i, p in at.items()] + [(sorted(p), None) for p in sequences.values()]:
        end = 0
        for start, length in pieces:
            assert start == end
            end += length
        assert end == size if size else end <= 1024
    assert set(at) == set(ids)
    assert sum(map(len, ids.values())) > 0.97 * 1024 * len(sequences)


def test_encoders_agree_on_special_strings():
    args = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), queries.split_pattern()
    fast, slow = packing.Encoder(*args), packing.Encoder(args[0], None, None)
    for t in ["", " ", "a<|endoftext|>b", "<|endoftext|>", "it's  we'll\n\n x\t", "日本 \U0001f600 é", "1234 !!??   x", "\r\n \r\n", "don't DON'T"]:
        assert fast.ids(t).tolist() == slow.ids(t).tolist()


def test_differencing_balances():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 100, rng.integers(1, 80))
        bins = int(rng.integers(1, 12))
        got = packing.differencing(sizes, bins)
        load = np.bincount(got, sizes, bins)
        assert got.max() < bins and load.sum() == sizes.sum()
        if len(sizes) > 6 * bins:
            assert load.max() - load.min() <= sizes.max()
        assert np.bincount(packing.balanced(sizes, 100), sizes).max() <= 100


def test_lines_by_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice("abcdefgh") * 3 if rng.random() < 0.9 else " " for _ in range(rng.randint(0, 14)))) for i in range(80)]
    for run in (2, 3):
        seen, want = set(), {}
        for i, t in docs:
            ls = t.split("\n")
            solid = [k for k, x in enumerate(ls) if x.strip()]
            gone = set()
            for s in range(len(solid) - run + 1):
                gram = tuple(ls[k] for k in solid[s : s + run])
                gone |= set(solid[s : s + run]) if gram in seen else set()
                seen.add(gram)
            want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_single_passages_go(spark):
    long, more, cjk, short = "a copied paragraph of more than seven words", "another one of nine words that stands here once", "一二三四五六七八九十", "only a few words"
    docs = [(1, f"x\n{long}\ny\n{short}"), (2, f"z\n{long}\nw"), (3, long), (4, f"{short}\n{more}"), (5, f"q\n{cjk}\nr\n{cjk}\ns"), (None, long)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()}
    assert got == {**dict(docs), 2: "z\nw", 3: "", 5: f"q\n{cjk}\nr\ns", None: ""}


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for run in (2, 3, 5):
        h = rng.integers(0, 6, 60).astype(np.uint64)
        at = set(lines.minima(h, run).tolist())
        assert all(at & set(range(i, i + run)) for i in range(len(h) - run + 1))


def test_languages_held_out(spark):
    lang = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF2}/documents.parquet'").fetchall())
    got = [r for r in queries.op6_language_id(spark, SF2).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got) and len(got) > 150
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95
    assert np.mean([r["rejected"] for r in got]) < 0.02


def test_toxicity_held_out(spark):
    toxic = dict(duckdb.connect().execute(f"SELECT doc_id, toxic FROM '{SF2}/labels.parquet'").fetchall())
    got = [r for r in queries.op9_toxicity(spark, SF2).collect() if r["held_out"] and r["doc_id"] in toxic]
    hit = collections.Counter((toxic[r["doc_id"]], r["predicted"]) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert hit[1, 1] >= 0.6 * (hit[1, 0] + hit[1, 1]) and hit[0, 1] <= 0.1 * (hit[0, 0] + hit[0, 1])


def test_words_add_up_to_the_text():
    rng = np.random.default_rng(0)
    m = langid.LanguageModel(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)), np.zeros(2), 1.0, 0.0)
    for t in ("one two one three", "Été ÉTÉ x", "x"):
        assert np.allclose(langid.Scorer(m).logits([t])[0], langid.features(t) @ m.weights, atol=1e-4)


def test_recall(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF2}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = collections.defaultdict(list)
    for r in ann.nearest(table(spark, SF2, "embeddings")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = got[int(ids[i])]
        assert len(mine) == 20 and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        assert all(abs(score - s[ids == v][0]) < 1e-12 for v, score in mine)
        found.append(len(best & {v for v, _ in mine}) / 20)
    assert np.mean(found) >= 0.9


def test_media_round_trip():
    rng = np.random.default_rng(5)
    for text in ("", "a", "x" * 576, "é" * 5000, "".join(map(chr, rng.integers(32, 0x2FFF, 20000)))):
        payload, n = media.padded(text)
        stored = media.write_png(payload)
        assert media.read_png(stored).tobytes() == payload and payload[:n].decode() == text and len(payload) % 576 == 0 and payload
        for damaged in (stored[:-1], stored[:40] + bytes([stored[40] ^ 1]) + stored[41:], b"x" + stored[1:], stored[:-12]):
            with pytest.raises(media.MediaError):
                media.read_png(damaged)


def test_all_row_filters_are_undone():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 256, (40, 9)).astype(int)
    kind = rng.integers(0, 5, 40)
    out = np.zeros_like(x)
    for r in range(40):
        for c in range(9):
            a, b, d = (x[r, c - 1] if c else 0), (x[r - 1, c] if r else 0), (x[r - 1, c - 1] if r and c else 0)
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out[r, c] = (x[r, c] - (0, a, b, (a + b) // 2, paeth)[kind[r]]) % 256
    assert (media.unfiltered(kind.astype(np.uint8), out.astype(np.uint8)) == x).all()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id=main><article><h1>Head &amp; line</h1><p>First   paragraph,
with a break<br>and more words, and more.<p>Second <b>bold</b>part, closed by the next, that is long enough.<form><input value=x>Search here</form>
<aside>See also</aside><ul><li>item one<li>item two</ul></article></div><div class="comments"><p>A reader wrote this, at length, with commas, and points.</p></div>
<div class="AdBox"><p>Buy now, please.</p></div><script>var a = "<p>no</p>";</script><footer>&copy; us</footer></body></html>"""


def test_main_text():
    want = ["Head & line", "First paragraph, with a break and more words, and more.", "Second boldpart, closed by the next, that is long enough.", "item one", "item two"]
    assert htmltext.main_text(PAGE) == "\n\n".join(want)
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert htmltext.main_text(plain).split("\n\n")[1:3] == want[1:3] and "cookies" not in htmltext.main_text(plain) and "Buy" not in htmltext.main_text(plain)


@pytest.mark.parametrize("paths", [5, 60, 400])
def test_paths_are_smoothed_at_every_size(paths):
    rng = random.Random(paths)
    made = [("", "html", "body", *(rng.choice(("div", "p", "ul", "li", "b")) for _ in range(rng.randint(0, 12)))) for _ in range(paths)]
    nodes = []
    for p in made:
        node = htmltext._Node("", None, False, 0)
        for tag in p[1:]:
            node = htmltext._Node(tag, node, False, 0)
        nodes += [(node, 0, "word, " * rng.randint(1, 40))] * rng.randint(1, 3)
    sums = collections.defaultdict(lambda: np.zeros(3))
    for node, _, text in nodes:
        sums[node.path] += (1, len(text) - text.count(" "), text.count(","))
    got = htmltext.path_scores(nodes)
    assert got.keys() == sums.keys()
    for p in sums:
        total = sum(s * np.exp(-((len(p) + len(q) - 2 * next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))) ** 2) / 2) for q, s in sums.items())
        assert got[p] == pytest.approx(np.sqrt(total[1] / total[0] * (total[2] / total[0] + 0.1)), rel=1e-9)


def test_headings_of_pages_with_many_paths():
    body = "".join(f"<p>{'x' * 196}, ,, .</p>" for _ in range(20)) + "".join(f"<h2>heading number {i} here</h2>" for i in range(3))
    extra = "".join("<div>" + "".join(f"<{t}>" for t in c) + "z" + "</div>" for c in itertools.product(("b", "i", "u"), repeat=4))
    assert len(htmltext.path_scores(htmltext.leaves(f"<html><body>{body}{extra}</body></html>"))) > 64
    for page in (body, body + extra):
        assert "heading number 2 here" in htmltext.main_text(f"<html><body>{page}</body></html>")


def test_mix_copies_whole_documents(spark):
    docs = table(spark, SF, "documents")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(docs).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert {i: got[i] for i in copies} == copies and max(copies.values()) <= 3


def test_mix_comes_near_targets(spark):
    rows = mixing.mixed_sizes(table(spark, "/root/testdata/sf0.1", "documents").withColumn("source", F.substring("source", 1, 4))).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(r["over"] <= 0 for r in rows)
    assert abs(sum(r["t"] for r in rows) / sum(r["source_size"] for r in rows) - 1) < 0.05


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    docs, before = table(spark, SF, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        old, new = ([r.asDict() for r in d.collect()] for d in (docs, after))
        if name == "language_id":
            assert {r["doc_id"] for r in new} <= {r["doc_id"] for r in old} and len(new) >= 0.98 * len(old)
        if name == "line_dedup":
            assert len(new) == len(old) and all(r["n_chars"] == len(r["text"]) for r in new)
        if name == "minhash_neardup":
            want = groups({r["doc_id"]: shingles(r["text"]) for r in old}, 80)
            assert sorted(r["doc_id"] for r in new) == sorted(i for i, c in want.items() if i == c)
        docs = after
    assert corpus_pipeline.run(spark, SF).count() > 0
