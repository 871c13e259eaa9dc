"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, index_of, picked, prepare, unclashed, unit_hash, with_fields
from .langid import bucket

#: Buckets of words and word beginnings, embedding size, filter widths and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: Characters of the word beginnings that share a bucket, besides the word itself.
STEMS = (4, 6)
#: Bounds of the labelled sample: documents of either label, and words of a document in it.
PER_LABEL, MAX_WORDS, HOLD = 2000, 4000, 5
STRIP = ".,;:!?%&*$#|\"'()[]{}<>-_=+/\\~^`@…«»“”‘’¿¡"
_WORDS_KEPT = 100_000


def buckets_of(word: str) -> list[int]:
    """The word's bucket, then those of its beginnings."""
    w = word.lower().strip(STRIP)
    return [zlib.crc32(f"{n}:{w[:n] if n else w}".encode("utf-8", "surrogatepass")) % BUCKETS for n in (0, *STEMS)]


@dataclass
class ToxicityModel:
    """Embeddings [BUCKETS, DIM]; filters by width [width, DIM, FILTERS]; an output layer; language evidence by
    bucket and a threshold for each language (the last one for texts without evidence)."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    out: np.ndarray
    bias: float
    evidence: np.ndarray
    thresholds: np.ndarray

    def word_rows(self, ids: np.ndarray) -> np.ndarray:
        """What words of bucket lists ids [n, 1 + stems] put into every place of every filter, and their evidence."""
        e = self.embedding[ids].sum(1)
        return np.concatenate([e @ w[i] for w in self.filters for i in range(len(w))] + [self.evidence[ids[:, 0]]], 1)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Max over all positions of each filter, for the rows of a whole text."""
        out, at, n = [], 0, len(rows)
        for width, bias in zip(WIDTHS, self.filter_bias, strict=True):
            if n < width:
                out.append(np.zeros(FILTERS))
            else:
                total = bias + sum(rows[i : n - width + 1 + i, at + i * FILTERS : at + (i + 1) * FILTERS] for i in range(width))
                out.append(np.maximum(total.max(0), 0))
            at += width * FILTERS
        return np.concatenate(out)

    def raw(self, rows: np.ndarray) -> tuple[float, int]:
        """(probability before calibration, index of the language that the text's words speak for)."""
        p = 1 / (1 + np.exp(-(self.pooled(rows) @ self.out + self.bias)))
        votes = rows[:, sum(WIDTHS) * FILTERS :].sum(0)
        return float(p), int(votes.argmax()) if len(votes) and votes.any() else len(self.thresholds) - 1

    def score(self, rows: np.ndarray) -> float:
        """The probability stretched so that its language's threshold lies at one half."""
        p, lang = self.raw(rows)
        t = self.thresholds[lang]
        return 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / max(1 - t, 1e-9)


class Scorer:
    """Rows of words are remembered, up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.model, self.place, self.rows = model, {}, None

    def scores(self, texts: list[str]) -> list[float]:
        split = [t.split() for t in texts]
        if len(self.place) > _WORDS_KEPT:
            self.place, self.rows = {}, None
        new = list({w: None for words in split for w in words if w not in self.place})
        if new or self.rows is None:
            ids = np.array([buckets_of(w) for w in new], np.int64).reshape(-1, 1 + len(STEMS))
            rows = self.model.word_rows(ids).astype(np.float32)
            at = 0 if self.rows is None else len(self.rows)
            self.place |= dict(zip(new, range(at, at + len(new)), strict=True))
            self.rows = rows if self.rows is None else np.concatenate([self.rows, rows])
        return [self.model.score(self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]) for words in split]


def _log_odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How much more often a bucket's words stand in documents of label 1: where embeddings start."""
    seen = np.full((2, BUCKETS), 0.5)
    for ids, label in zip(docs, y, strict=True):
        seen[label, np.unique(ids)] += 1
    n = np.bincount(y, minlength=2) + 1
    odds = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
    return odds * np.minimum(1, (seen.sum(0) - 1) / 8)  # rare words say little


def fit(docs: list[np.ndarray], y: np.ndarray, lang: list[str | None], seed: int = 9, epochs: int = 6, rate: float = 0.05) -> ToxicityModel:
    """Adagrad on logistic loss, label-balanced; gradients flow to the words that win the pooling.

    docs hold [words, 1 + stems] buckets. One document in HOLD is kept aside and sets the thresholds: for
    each language the one of best F1, drawn to the common one where its positives are few.
    """
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % HOLD == HOLD - 1
    own = np.flatnonzero(~aside)
    e = rng.normal(0, 0.05, (BUCKETS, DIM))
    e[:, 0] = _log_odds([docs[i] for i in own], y[own]) * 0.5
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[:, 0] = np.abs(w[:, 0]) / len(w) + 0.3 / len(w)
    fb = [np.full(FILTERS, -0.5) for _ in WIDTHS]
    out, bias = np.abs(rng.normal(0.3, 0.05, FILTERS * len(WIDTHS))), -1.0
    names = sorted({x for x in lang if x})
    m = ToxicityModel(e, filters, fb, out, bias, np.zeros((BUCKETS, len(names))), np.full(len(names) + 1, 0.5))
    ge, gf = np.full((BUCKETS, 1), 1e-2), [np.full(w.shape, 1e-2) for w in filters]
    gb, go = [np.full(FILTERS, 1e-2) for _ in WIDTHS], np.full(len(out), 1e-2)
    weight = np.where(y == 1, 0.5 / max((y[own] == 1).mean(), 1e-9), 0.5 / max((y[own] == 0).mean(), 1e-9))
    for epoch in range(epochs):
        for i in rng.permutation(own):
            ids = docs[i]
            x = m.embedding[ids].sum(1)
            hidden, wins = [], []
            for w, b in zip(m.filters, m.filter_bias, strict=True):
                k = len(w)
                if len(x) < k:
                    hidden.append(np.zeros(FILTERS))
                    wins.append(None)
                    continue
                z = b + sum(x[j : len(x) - k + 1 + j] @ w[j] for j in range(k))
                at = z.argmax(0)
                hidden.append(np.maximum(z[at, np.arange(FILTERS)], 0))
                wins.append(at)
            h = np.concatenate(hidden)
            p = 1 / (1 + np.exp(-(h @ m.out + m.bias)))
            g = (p - y[i]) * weight[i]
            if abs(g) < 1e-3:
                continue
            gh = g * m.out * (h > 0)
            d = g * h
            go += d * d
            m.out -= rate * d / np.sqrt(go)
            m.bias -= rate * 0.2 * g
            for k, (w, at) in enumerate(zip(m.filters, wins, strict=True)):
                if at is None:
                    continue
                mine = gh[k * FILTERS : (k + 1) * FILTERS]
                gb[k] += mine * mine
                m.filter_bias[k] -= rate * mine / np.sqrt(gb[k])
                for j in range(len(w)):
                    d = x[at + j].T * mine
                    dx = (w[j] * mine).T  # a row for each filter's winning word
                    gf[k][j] += d * d
                    w[j] -= rate * d / np.sqrt(gf[k][j])
                    for b in ids[at + j].T:
                        np.add.at(ge, b, (dx * dx).mean(1, keepdims=True))
                        np.add.at(m.embedding, b, -rate * dx / np.sqrt(ge[b]))
    if names:
        counts = np.full((BUCKETS, len(names)), 0.1)
        for i in own:
            if lang[i]:
                np.add.at(counts[:, names.index(lang[i])], docs[i][:, 0], 1)
        share = np.log(counts / counts.sum(0))
        m.evidence = share - share.mean(1, keepdims=True)
    tried = np.flatnonzero(aside) if aside.any() else own
    got = [m.raw(m.word_rows(docs[i])) for i in tried]
    p, at, truth = np.array([x[0] for x in got]), np.array([x[1] for x in got]), y[tried]
    common = _best_threshold(p, truth)
    m.thresholds[:] = common
    for k in range(len(names)):
        mine = at == k
        n = int((truth[mine] == 1).sum())
        if n:
            m.thresholds[k] = (n * _best_threshold(p[mine], truth[mine]) + 10 * common) / (n + 10)
    return m


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway in the widest stretch of probabilities of best F1."""
    cuts = np.unique(np.concatenate([[0.02, 0.98], np.clip(p, 0.02, 0.98)]))
    mids = (cuts[1:] + cuts[:-1]) / 2
    f1 = [2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum()) for t in mids]
    best = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(mids[max(best, key=lambda i: cuts[i + 1] - cuts[i])])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL, max_words: int = MAX_WORDS) -> ToxicityModel | None:
    """A model from a bounded sample of labelled rows whose crc32(doc_id) mod 5 is not 0: in the order of a
    hash at most per_label documents of either label, of at most max_words words. A document labelled more
    than once counts as toxic if any label says so; null labels do not count. Rows that share an id count once,
    by the short enough text of least hash, so no more than 2 x per_label rows reach the driver. None
    without both labels."""
    own = picked(labels, doc_id="doc_id", toxic="toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(bucket(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = picked(docs, doc_id=id_col, text=text_col, lang=lang_col).where("doc_id is not null and text is not null")
    fits = F.length("text") - F.length(F.translate("text", " \n\t", "")) < max_words
    sizes = rows.where(fits).select("doc_id").join(own, "doc_id").distinct()
    u = unit_hash(F.col("doc_id"), F.lit("toxic"))
    parts = [sizes.where(F.col("toxic") == k).orderBy(u, "doc_id").limit(per_label) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("chosen"), "toxic")
    found = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["chosen"])  # 2 x per_label rows at most
    # lengths are asked for again after the join alone, of the few rows that it leaves
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.when(fits, F.struct(F.xxhash64("text").alias("h"), "text", "lang"))).alias("r")).where("r is not null").select("doc_id", "toxic", "r.lang", "r.text")

    def ids(b: pa.RecordBatch) -> dict:
        lists = [np.array([buckets_of(w) for w in t.split()], np.int32).ravel() for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "lang": b.column("lang"), "ids": lists}

    got = arrow_map(found, ids, "doc_id long, toxic int, lang string, ids array<int>").toArrow()
    if not got.num_rows:
        return None
    ids_ = got.column("ids").combine_chunks()
    lists = [ids_[i].values.to_numpy().reshape(-1, 1 + len(STEMS)) for i in range(len(ids_))]
    keys, y, lang = (got.column(c).to_pylist() for c in ("doc_id", "toxic", "lang"))
    order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(f"{keys[i]}:toxic".encode()), keys[i], len(lists[i])))
    order = [i for i in order if len(lists[i])]
    y = np.array([y[i] for i in order], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return fit([lists[i] for i in order], y, [lang[i] for i in order])


def scored(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) added, from every word of the whole text alone; no shuffle.

    Null and blank texts get what a text without words gets; without a model all scores are 0. Repeated
    rows agree; extra columns of any name stay; no rows give none.
    """
    prepare(docs.sparkSession)
    flat = unclashed(docs)
    spec = with_fields(flat, "_toxicity double")
    text, kept, hold = f"_c{index_of(docs, text_col)}", flat.columns, []

    def rows(b: pa.RecordBatch) -> dict:
        if model and not hold:
            hold.append(Scorer(model))
        texts = [t or "" for t in b.column(text).to_pylist()]
        return {c: b.column(c) for c in kept} | {"_toxicity": hold[0].scores(texts) if model else [0.0] * len(texts)}

    return arrow_map(flat, rows, spec).toDF(*docs.columns, "toxicity")
