"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, arrow_map, index_of, mix64, picked, prepare, stored, unclashed, with_fields

#: A run of this many lines is found for certain, and a single line counts only if it is a passage.
RUN = 2
#: A line of this many words is a passage, which counts by itself.
PASSAGE = 8
#: Scripts that put no spaces between words: a character counts as a word.
_UNSPACED_SQL = r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]"
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def solid_lines(text: str) -> list[bytes]:
    """The lines that are not blank, in order."""
    return [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]


def line_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lines that are not blank, in order."""
    return np.array([xxhash.xxh3_64_intdigest(x) for x in solid_lines(text)], np.uint64)


def is_passage(line: bytes, words: int = PASSAGE) -> bool:
    found = len(line.split(None, words - 1))
    return found >= words or not line.isascii() and found + len(_UNSPACED.findall(line.decode("utf-8", "surrogatepass"))) >= words


def minima(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """Winnowing: places of the least hash of each window of `run` lines, the last one among equals."""
    if len(h) < run:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, run)[:, ::-1]
    return np.unique(np.arange(len(views)) + run - 1 - views.argmin(1))


def grams(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash for each window of `run` lines."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - run + 1), np.uint64)
        for i in range(run):
            out = mix64((out ^ h[i : i + len(out)]) + np.uint64(0x9E3779B97F4A7C15))
    return out


def _marks(run: int, passages: bool):
    def rows(b: pa.RecordBatch) -> dict:
        texts = [t or "" for t in b.column("text").to_pylist()]
        hashes = [line_hashes(t) for t in texts]
        alone = [np.array([k for k, x in enumerate(solid_lines(t)) if is_passage(x)] if passages else [], np.int64) for t in texts]
        prints = [np.union1d(minima(h, run), a) for h, a in zip(hashes, alone, strict=True)]
        return {
            "doc_id": b.column("doc_id"), "th": b.column("th"),
            "lines": [h.view(np.int64) for h in hashes], "at": [p.astype(np.int32) for p in prints], "prints": [h[p].view(np.int64) for h, p in zip(hashes, prints, strict=True)],
            "alone": [a.astype(np.int32) for a in alone],
        }

    return rows


def _around(run: int):
    """The windows that hold a repeated fingerprint: the first step of extending a match both ways. A passage is one of one line."""

    def rows(b: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("gram", "doc_id", "th", "start", "size")}
        for doc_id, th, lines, alone, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "lines", "alone", "hits")), strict=True):
            h = np.array(lines, np.int64).view(np.uint64)
            g = grams(h, run).view(np.int64)
            starts = np.unique((np.array(at, np.int64)[:, None] - np.arange(run)).ravel())
            starts = starts[(starts >= 0) & (starts < len(g))]
            single = np.intersect1d(np.array(alone, np.int64), np.array(at, np.int64))
            out["gram"] += g[starts].tolist() + grams(h, 1).view(np.int64)[single].tolist()
            out["start"] += starts.tolist() + single.tolist()
            out["size"] += [run] * len(starts) + [1] * len(single)
            out["doc_id"] += [doc_id] * (len(starts) + len(single))
            out["th"] += [th] * (len(starts) + len(single))
        return out

    return rows


def repeated_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """doc_id, th (hash of the text), starts, alone: where, counted in lines that are not blank, windows of
    `run` lines begin, and passages of one line stand, that are earlier in the corpus too, ordered by
    (doc_id, place), null ids last.

    (1) each text yields its lines' hashes and the winnowed fingerprints among them; every run of `run`
    lines or more holds one, and a passage is one itself. (2) Fingerprints that occur twice survive a pre-aggregated count. (3) Around
    these alone the windows are hashed, and each window's first place is an aggregate, joined back: so
    a match is extended both ways as far as windows go on repeating. No step pairs occurrences with
    each other: a passage that stands in a third of all texts costs one row each.
    """
    prepare(docs.sparkSession)
    docs = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    marks = stored(arrow_map(docs, _marks(run, passages), "doc_id long, th long, lines array<long>, at array<int>, prints array<long>, alone array<int>"), "marks").where(F.size("at") > 0)
    spots = marks.select("doc_id", "th", F.explode(F.arrays_zip("at", "prints")).alias("x")).select("doc_id", "th", F.col("x.at").alias("at"), F.col("x.prints").alias("print"))
    size = marks.agg(F.sum(F.size("at"))).first()[0] or 0  # fingerprints: bounds what comes of them
    twice = stored(spots.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "twice", size)  # a table, so a hot print can be split
    hits = spots.join(twice, "print", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("at").alias("hits"))
    near = marks.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "lines", "alone")
    near = near.join(hits, near["doc_id"].eqNullSafe(hits["doc_id"]) & (near["th"] == hits["th"])).select(near["doc_id"], near["th"], "lines", "alone", "hits")
    windows = stored(arrow_map(near, _around(run), "gram long, doc_id long, th long, start long, size int"), "windows", size)
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th", "start")
    first = stored(windows.groupBy("gram", "size").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("gram", "size", "first"), "first", size)
    later = windows.join(first, ["gram", "size"]).where(place > F.col("first"))
    single = F.col("size") < run
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.when(~single, F.col("start"))).alias("starts"), F.collect_set(F.when(single, F.col("start"))).alias("alone"))


def without_lines(text: str, starts: list[int], run: int = RUN, alone: list[int] = ()) -> tuple[str, int, int]:
    """(text without the lines in windows at `starts` and those of `alone`, lines that are not blank, lines deleted)."""
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").strip()]
    gone = {solid[s + k] for s in starts for k in range(run)} | {solid[s] for s in alone}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(solid), len(gone)


def dedup_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """docs with n_lines, n_deleted added and the text rewritten: lines in runs of at least `run` lines that
    stand earlier in the corpus (in an earlier document, or higher up in the same one) are deleted, and so
    are single lines of PASSAGE or more words (a character of a script without spaces counts as a word),
    unless `passages` is false.

    Lines are cut at "\\n" and compared byte for byte; blank lines are passed over and stay. Rows that
    share id and text are one document and get the same result; a null id comes after all others. Null
    texts stay null, and a text may become empty. Extra columns of any name are kept; no rows give none.
    """
    runs = stored(repeated_runs(docs, run, id_col, text_col, passages), "runs", docs.count(), WIDE_ROWS).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    flat = unclashed(docs)
    i, t = index_of(docs, id_col), index_of(docs, text_col)
    mine = flat.withColumn("_hash", F.xxhash64(f"_c{t}"))
    # texts are shuffled once at every size: runs grow with the corpus and are not to be broadcast
    both = mine.join(runs.hint("merge"), mine[f"_c{i}"].cast("long").eqNullSafe(runs["_id"]) & (mine["_hash"] == runs["_th"]), "left").drop("_id", "_th", "_hash")
    return _rewritten(both, f"_c{t}", run, docs.columns)


def _rewritten(flat: DataFrame, text: str, run: int, names: list[str]) -> DataFrame:
    spec = with_fields(flat.drop("starts", "alone"), "_n_lines long, _n_deleted long")
    kept = [c for c in flat.columns if c not in ("starts", "alone")]

    def rows(b: pa.RecordBatch) -> dict:
        texts, found, deleted = [], [], []
        for t, starts, alone in zip(*(b.column(c).to_pylist() for c in (text, "starts", "alone")), strict=True):
            t2, n, gone = without_lines(t or "", starts or [], run, alone or [])
            texts.append(None if t is None else t2)
            found.append(n)
            deleted.append(gone)
        out = {f: b.column(f) for f in kept}
        return out | {text: texts, "_n_lines": found, "_n_deleted": deleted}

    return arrow_map(flat, rows, spec).toDF(*names, "n_lines", "n_deleted")


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, n, line FROM (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') <> ''),
w AS (SELECT a.doc_id, a.k, a.line || chr(10) || b.line AS gram FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.k = a.k + {RUN - 1}),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY gram ORDER BY doc_id, k) AS occurrence FROM w),
p AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS occurrence FROM solid
  WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) + len(regexp_extract_all(line, '{_UNSPACED_SQL}')) >= {PASSAGE}),
gone AS (
  SELECT doc_id, k + d AS k FROM f, (SELECT unnest(range({RUN})) AS d) WHERE occurrence > 1
  UNION SELECT doc_id, k FROM p WHERE occurrence > 1),
kept AS (
  SELECT l.doc_id, l.n, l.line, solid.k, gone.k IS NOT NULL AS gone
  FROM l LEFT JOIN solid USING (doc_id, n) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = solid.k)
SELECT doc_id, count(k) AS n_lines, count(*) FILTER (gone) AS n_deleted,
  md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS text_md5
FROM kept GROUP BY doc_id"""
