"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, index_of, picked, prepare, unclashed, unit_hash, with_fields

#: Buckets of subwords, their lengths in bytes (a word stands between two bytes 32), embedding size.
BUCKETS, NGRAMS, DIM = 1 << 13, (1, 2, 3, 4), 16
#: Bounds of the labelled sample: documents a language, and in all; one in HOLD of them calibrates.
PER_LANGUAGE, SAMPLE, HOLD = 400, 2400, 5
UNKNOWN = "und"
_WORDS_KEPT = 100_000


def has_letter(text: str | None) -> bool:
    """A character of Unicode category L; no digit, fraction or numeral is one, whatever its form."""
    return any(map(str.isalpha, text or ""))


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword of each word, index of its word), both flat; from one pass over all bytes."""
    raw = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, 0x811C9DC5 + n, np.uint32)
            for i in range(n):
                h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            inside = word[: len(h)] == word[n - 1 :]
            found.append((h >> np.uint32(7))[inside] % np.uint32(buckets))
            owner.append(word[: len(h)][inside])
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.empty(0, np.uint32), np.empty(0, np.int64))


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Share of each bucket among all subwords of the whole text."""
    words = text.lower().split()
    unique, times = np.unique(np.array(words, dtype=object), return_counts=True) if words else ([], np.empty(0))
    b, owner = subwords(list(unique), buckets)
    out = np.bincount(b, weights=times[owner], minlength=buckets).astype(np.float32)
    return out / max(out.sum(), 1)


@dataclass
class LanguageModel:
    """weights [buckets, languages] are embeddings times the softmax layer: averaging commutes with it."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


class Scorer:
    """Logits of whole texts; what a word adds is remembered, up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.place = model, {}
        self.rows = np.empty((0, model.weights.shape[1] + 1))

    def logits(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        if len(self.place) > _WORDS_KEPT:
            self.place, self.rows = {}, self.rows[:0]
        new = list({w: None for words in split for w in words if w not in self.place})
        if new:
            b, owner = subwords(new, len(self.model.weights))
            columns = [self.model.weights[b, k] for k in range(self.model.weights.shape[1])] + [None]
            cells = np.stack([np.bincount(owner, c, len(new)) for c in columns], 1)
            self.place |= dict(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, cells])
        out = np.zeros((len(texts), self.model.weights.shape[1]))
        for i, words in enumerate(split):
            if words:
                at, n = np.unique(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)), return_counts=True)
                total = n @ self.rows[at]
                out[i] = total[:-1] / total[-1]
        return out


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5, epochs: int = 60, rate: float = 40.0, lost: float = 0.002) -> LanguageModel:
    """Stochastic gradient descent on embeddings [buckets, DIM] and softmax [DIM, languages].

    One row in HOLD is kept aside: it sets the temperature (least log loss) and the threshold under which
    a prediction is rejected: at most `lost` of the right ones fall below it, and never above one half.
    """
    rng = np.random.default_rng(seed)
    k = len(languages)
    aside = np.arange(len(y)) % HOLD == HOLD - 1
    tx, ty = x[~aside], y[~aside]
    e = rng.normal(0, 0.3, (x.shape[1], DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, k)).astype(np.float32)
    b = np.zeros(k, np.float32)
    share = np.bincount(ty, minlength=k) / max(len(ty), 1)
    heavy = (1 / np.maximum(share, 1e-9) / k)[ty].astype(np.float32)  # languages weigh alike
    for epoch in range(epochs):
        order = rng.permutation(len(ty))
        step = rate / (1 + 3 * epoch / epochs)
        for at in range(0, len(order), 32):
            i = order[at : at + 32]
            h = tx[i] @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), ty[i]] -= 1
            p *= (heavy[i] / len(i))[:, None]
            gw, gh = h.T @ p, p @ w.T
            e -= step * (tx[i].T @ gh)
            w -= 0.02 * step * gw
            b -= 0.02 * step * p.sum(0)
    model = LanguageModel(languages, (e @ w).astype(np.float64), b.astype(np.float64), 1.0, 0.0)
    cx, cy = (x[aside], y[aside]) if aside.any() else (x, y)
    logits = cx @ model.weights
    best = None
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        model.temperature = t
        p = model.probabilities(logits)
        loss = -np.log(np.maximum(p[np.arange(len(cy)), cy], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = best[1]
    p = model.probabilities(logits)
    right = p.max(1)[p.argmax(1) == cy]
    model.threshold = float(min(0.5, np.quantile(right, lost))) if len(right) else 0.0
    return model


def bucket(doc_id, parts: int) -> F.Column:
    """crc32 of the id's text, mod parts; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> LanguageModel | None:
    """A model from a bounded sample: documents with a language, a letter and an id whose crc32 mod 4 is not 2,
    in the order of a hash, at most per_language of each language and sample in all. Rows that share an id
    count once, by the text of least hash, so no more than `sample` rows reach the driver. Features are
    computed where the texts are. None if there is no such document."""
    rows = picked(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id"), 4) != 2))
    order = unit_hash(F.col("doc_id"), F.lit("langid"))
    w = Window.partitionBy("lang").orderBy("u", "doc_id")
    # what lies far beyond the bound in hash order is left out before languages are ranked; `sample` rows are broadcast
    often = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("count")).orderBy(F.desc("count"), "lang").limit(sample).withColumnRenamed("lang", "_lang")
    near = rows.withColumn("u", order).join(F.broadcast(often), F.col("lang") == F.col("_lang")).where(F.col("u") * F.col("count") <= 4 * per_language + 100)
    chosen = near.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "u").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language)
    chosen = chosen.orderBy("n", "u", "lang", "doc_id").limit(sample).select(F.col("doc_id").alias("chosen")).distinct()
    found = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["chosen"], "left_semi")  # `sample` ids at most
    found = found.where(F.col("text").rlike(r"\p{L}")).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")

    def vectors(b: pa.RecordBatch) -> dict:
        full = [features(t) for t in b.column("text").to_pylist()]
        at = [np.flatnonzero(v) for v in full]
        return {"doc_id": b.column("doc_id"), "lang": b.column("lang"), "at": [a.astype(np.int32) for a in at], "value": [v[a] for v, a in zip(full, at, strict=True)]}

    got = arrow_map(found, vectors, "doc_id long, lang string, at array<int>, value array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    keys, langs = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    order_ = sorted(range(len(keys)), key=lambda i: (zlib.crc32(str(keys[i]).encode()), keys[i], langs[i]))
    languages = sorted(set(langs))
    at, value = (got.column(c).combine_chunks() for c in ("at", "value"))
    x = np.zeros((len(keys), BUCKETS), np.float32)
    for row, i in enumerate(order_):
        x[row, at[i].values.to_numpy()] = value[i].values.to_numpy()
    return fit(x, np.array([languages.index(langs[i]) for i in order_]), languages)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added, from the whole text alone; no shuffle.

    Null texts and texts without a letter are `und` with score 0 and rejected. Others get the likeliest
    learned language and its calibrated probability, and are rejected under the model's threshold. Without
    a model all are `und`. Repeated rows agree; extra columns of any name stay; no rows give none.
    """
    flat = unclashed(docs)
    spec = with_fields(flat, "_lang string, _score double, _rejected boolean")
    text, kept, hold = f"_c{index_of(docs, text_col)}", flat.columns, []

    def rows(b: pa.RecordBatch) -> dict:
        if model and not hold:
            hold.append(Scorer(model))
        texts = b.column(text).to_pylist()
        at = [i for i, t in enumerate(texts) if model and has_letter(t)]
        lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if at:
            p = model.probabilities(hold[0].logits([texts[i] for i in at]))
            for i, q in zip(at, p, strict=True):
                k = int(q.argmax())
                lang[i], score[i], rejected[i] = model.languages[k], float(q[k]), bool(q[k] < model.threshold)
        return {c: b.column(c) for c in kept} | {"_lang": lang, "_score": score, "_rejected": rejected}

    return arrow_map(flat, rows, spec).toDF(*docs.columns, "lang_pred", "score", "rejected")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on docs and predicts every row of them."""
    prepare(docs.sparkSession)
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
