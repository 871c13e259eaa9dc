"""Packing token ids into windows by Karmarkar-Karp multiway differencing: documents stay whole but for what overflows."""

from __future__ import annotations

import bisect
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, arrow_map, picked, prepare, stored

#: Capacity of a window; windows balanced at once; pieces of a group for each of its windows, at most, on average.
CAPACITY, WINDOWS, PIECES = 1024, 128, 64
#: Equal pieces (of repeated rows) that may share a group; more are dealt out.
EQUAL = 64


class Encoder:
    """Ids of a byte-level BPE `tokenizers` file.

    The same ids come faster from tiktoken over the same vocabulary and split pattern, which is used
    where the rank file is given; its added tokens are taken from the .json, as that library does. A text
    whose white space its pattern engine gives up on is encoded by `tokenizers` itself.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.fast, self.slow, self.path = None, None, path
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
            self.names = set(self.added)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.names, disallowed_special=()).astype(np.uint32)
            except ValueError as e:  # the stack of its pattern engine, which hundreds of thousands of spaces exceed
                if "Regex error" not in str(e):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def load(path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks_path, pattern)


def differencing(sizes: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each size. Every size starts as a partial partition of one filled and bins - 1 empty bins; the two
    partitions of largest spread are merged again and again, largest bins upon smallest."""
    n = len(sizes)
    if bins == 1 or n <= 1:
        return np.zeros(n, np.int64)
    # bins hold the number of a tree of items: below n an item, from n on two trees; -1 is empty
    children, parts, heap = [], [], []
    for i in range(n):
        load_, tree = np.zeros(bins, np.int64), np.full(bins, -1, np.int64)
        load_[-1], tree[-1] = sizes[i], i
        parts.append((load_, tree))
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (x, s), (y, t) = parts[a], parts[b]
        y, t = y[::-1], t[::-1]
        parts[b] = None
        total = x + y
        tree = np.where(s < 0, t, s)
        both = np.flatnonzero((s >= 0) & (t >= 0))
        if len(both):
            tree[both] = np.arange(len(both)) + n + len(children)
            children += zip(s[both].tolist(), t[both].tolist(), strict=True)
        order = np.argsort(total, kind="stable")
        parts[a] = (total[order], tree[order])
        heapq.heappush(heap, (-int(total[order[-1]] - total[order[0]]), a))
    out = np.empty(n, np.int64)
    for k, root in enumerate(parts[heap[0][1]][1].tolist()):
        todo = [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = k
            else:
                todo += children[x - n]
    return out


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size in near-equal windows of at most `capacity`: as few as hold the sum, and more (one in 32) whenever one overflows."""
    bins = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        got = differencing(sizes, bins)
        if np.bincount(got, sizes).max(initial=0) <= capacity:
            return got
        bins += max(1, bins // 32)


def fitted(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, start, length, window) of the pieces of items of `sizes` in as few windows as hold them all.

    Items are balanced whole. Windows that this takes beyond the fewest are given up, least filled first, and
    what they hold goes, cut where it must be, into the room that the others have.
    """
    if not len(sizes):
        return []
    at = balanced(sizes, capacity)
    load_ = np.bincount(at, sizes).astype(np.int64)
    fewest = -(-int(sizes.sum()) // capacity)
    order = np.argsort(-load_, kind="stable")
    window = np.full(len(load_), -1, np.int64)
    window[order[:fewest]] = np.arange(fewest)
    out = [(i, 0, int(sizes[i]), int(window[k])) for i, k in enumerate(at.tolist()) if window[k] >= 0]
    room = [(int(capacity - load_[k]), int(window[k])) for k in order[:fewest] if load_[k] < capacity]
    room.sort()
    for i in sorted((i for i, k in enumerate(at.tolist()) if window[k] < 0), key=lambda i: (-sizes[i], i)):
        start, left = 0, int(sizes[i])
        while left:
            k = min(bisect.bisect_left(room, (left, -1)), len(room) - 1)  # the least room that is enough, else the most
            free, w = room.pop(k)
            n = min(free, left)
            out.append((i, start, n, w))
            start, left = start + n, left - n
            if free > n:
                bisect.insort(room, (free - n, w))
    return out


_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids: each document's ids and a closing id 0 as full windows and a
    rest, which brings its ids (little-endian, four bytes each) along."""

    def rows(b: pa.RecordBatch) -> dict:
        encoder = load(tokenizer, ranks, pattern)
        cols = {k: [] for k in (*_PIECE, "ids")}
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.concatenate([encoder.ids(text or ""), np.zeros(1, np.uint32)]).astype("<u4")
            raw = memoryview(ids.tobytes())
            for start in range(0, len(ids), capacity):
                own = raw[4 * start : 4 * (start + capacity)]
                n = len(own) // 4
                for k, v in zip(cols, (doc_id, start, n, zlib.crc32(own), len(ids), bytes(own) if n < capacity else None), strict=True):
                    cols[k].append(v)
        return cols

    return arrow_map(picked(docs, doc_id=id_col, text=text_col), rows, ", ".join(f"{c} long" for c in _PIECE) + ", ids binary")


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """Every id of every document in exactly one piece, each piece in one sequence of at most `capacity` ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is empty and has its
    closing id alone. Full windows are sequences of their own; the rests are dealt by a hash of what they are
    to groups of about `windows` windows, and each group is balanced by differencing. Texts are encoded once.
    Groups have bounded size whatever the documents' sizes: of pieces that are equal to the last id (repeated
    rows) each copy beyond a few is dealt by its number. So the result depends on the rows alone, not on
    their order or partitions. Null ids and ties are pieces like any others. No rows give no pieces.
    """
    spark = docs.sparkSession
    prepare(spark)
    cuts = stored(pieces(docs, tokenizer, ranks, pattern, id_col, text_col, capacity), "pieces").withColumn("h", F.xxhash64(*_PIECE))
    got = cuts.agg(F.sum(F.when(F.col("ids").isNotNull(), F.col("length"))).alias("rests"), F.count("*").alias("n")).first()
    groups = max(1, -(-(got["rests"] or 0) // (windows * capacity)), -(-got["n"] // (PIECES * windows)))
    often = stored(cuts.groupBy("h").count().where(F.col("count") > EQUAL).select("h"), "often", -(-got["n"] // EQUAL))
    dealt = cuts.withColumn("copy", F.lit(0).cast("long"))
    n = often.count()
    if n:
        keys = F.broadcast(often) if n <= BROADCAST_KEYS else often
        alike = cuts.join(keys, "h", "left_semi").groupBy("h", *_PIECE).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
        alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
        dealt = dealt.join(keys, "h", "left_anti").unionByName(alike)
    dealt = dealt.select(F.pmod(F.xxhash64("h", "copy"), F.lit(groups)).alias("grp"), *_PIECE, "ids")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", *_PIECE)

    def place(group: int, rows: list[tuple]) -> list[tuple]:
        """The pieces of a group with sequence and offset; rests are the rows with ids."""
        rests = [r for r in rows if r[5] is not None]
        found = fitted(np.array([r[2] for r in rests], np.int64), capacity)
        first = max((w for *_, w in found), default=-1) + 1
        used, out = [0] * first, []
        for i, start, length, w in found:
            doc_id, at, size, crc, total, ids = rests[i]
            if length != size:
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            out.append((doc_id, at + start, length, crc, total, (group << 32) + w, used[w]))
            used[w] += length
        full = (r for r in rows if r[5] is None)
        return out + [(*r[:5], (group << 32) + first + k, 0) for k, r in enumerate(full)]

    kinds = [*_PIECE, "sequence_id", "offset"]

    def run(batches):
        now, rows = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*place(now, rows), strict=True)], kinds)

        for b in batches:
            for grp, *row in zip(*(b.column(c).to_pylist() for c in ("grp", *_PIECE, "ids")), strict=True):
                if grp != now:
                    if rows:
                        yield done()
                    now, rows = grp, []
                rows.append(tuple(row))
        if rows:
            yield done()

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in kinds))
