"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts. A small classifier learns
the parts from the vectors. It places every vector, and routes each query to its most probable parts,
where candidates are reranked exactly. How many parts there are, and how many are probed, is measured on
rows of the sample that the classifier has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, picked, prepare, stored, unit_hash

#: Vectors of the sample, one in HOLD of which only measures; neighbours in its graph.
SAMPLE, HOLD, DEGREE = 4000, 5, 10
#: Numbers of parts that are tried, rows of the sample that a part needs to be learned, and rows that it is to hold.
PARTS, LEARNED, PART_ROWS = (16, 64, 256), 12, 500
#: Rows of a part, and queries, scored at once.
BLOCK, ASKED = 4096, 2048
#: Neighbours told; the share of neighbours that the probed parts must hold; what a probe costs, in rows scored.
TOP, COVERAGE, PROBE = 20, 0.93, 100


@dataclass
class Router:
    """Mean and scale of inputs, then a linear softmax over parts."""

    mean: np.ndarray
    scale: float
    w: np.ndarray
    b: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The `degree` others of largest inner product of each row, and an edge back for each."""
    n = len(x)
    near = np.zeros((n, n), np.float32)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        k = min(degree, n - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), int)
        near[np.arange(a, a + len(s))[:, None], top] = 1
    return np.maximum(near, near.T)


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Recursive bisection at the median of the second eigenvector of the normalised graph: halves of equal
    size with few edges cut. A faint link by position joins what the graph leaves apart."""
    out = np.zeros(len(graph), np.int64)
    todo = [(np.arange(len(graph)), 0, parts)]
    while todo:
        rows, first, k = todo.pop()
        out[rows] = first
        if k == 1 or len(rows) < 2:
            continue
        g = graph[np.ix_(rows, rows)]
        root = 1 / np.sqrt(g.sum(1) + 1e-3)
        centred = x[rows] - x[rows].mean(0)
        centred = centred / max(np.abs(centred).max(), 1e-9)
        v = rng.normal(size=(len(rows), 4)).astype(np.float32)
        top = (1 / root)[:, None]
        top = top / np.linalg.norm(top)
        for _ in range(60):
            v = v - top @ (top.T @ v)
            v = root[:, None] * (g @ (root[:, None] * v)) + v + 1e-2 / len(rows) * (centred @ (centred.T @ v))
            v, _ = np.linalg.qr(v)
        order = np.argsort(v[:, 0], kind="stable")
        half = len(rows) // 2
        todo += [(rows[order[:half]], first, k // 2), (rows[order[half:]], first + k // 2, k // 2)]
    return out


def fit(x: np.ndarray, parts: int, seed: int = 3, epochs: int = 20) -> Router:
    """Trains the router on the sample's parts: cross entropy against the parts of a row and its neighbours."""
    rng = np.random.default_rng(seed)
    x32 = x.astype(np.float32)
    graph = neighbour_graph(x32)
    part = balanced_parts(graph, x32, parts, rng)
    hot = np.eye(parts, dtype=np.float32)[part]
    goal = hot + graph @ hot  # where the row and its neighbours lie
    goal /= goal.sum(1, keepdims=True)
    mean = x32.mean(0)
    scale = float(x32.std()) or 1.0
    z = (x32 - mean) / scale
    w = (hot.T @ z / np.maximum(hot.sum(0), 1)[:, None]).T.copy()
    state = [w, np.zeros(parts, np.float32)]
    moment, square, t = [np.zeros_like(a) for a in state], [np.zeros_like(a) for a in state], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 64):
            i, t = order[at : at + 64], t + 1
            o = z[i] @ state[0] + state[1]
            p = np.exp(o - o.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - goal[i]) / len(i)
            for a, g, m, s in zip(state, (z[i].T @ p, p.sum(0)), moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                a -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    w, b = (a.astype(np.float64) for a in state)
    return Router(mean.astype(np.float64), scale, w, b)


def probes_needed(router: Router, x: np.ndarray, aside: np.ndarray, rows: int, top: int = TOP, coverage: float = COVERAGE) -> tuple[int, float]:
    """(fewest parts, most probable first, that hold `coverage` of the neighbours of the unseen rows `aside` of the
    sample x; the share of all rows in them).

    Of the `top` nearest of all `rows` the sample holds its share: so many of its own nearest are looked for, one at least.
    """
    z = router.logits(x)
    parts = z.shape[1]
    own = z.argmax(1)
    order = np.argsort(-z[aside], axis=1, kind="stable")
    share = (np.bincount(own, minlength=parts) / len(x))[order].cumsum(1).mean(0)
    k = min(max(1, round(top * len(x) / max(rows, 1))), len(x) - 1)
    if k < 1 or not len(aside):
        return parts, 1.0
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None], axis=1)
    s = x[aside] @ x.T
    s[np.arange(len(aside)), aside] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(rank, own[near], axis=1)
    probes = int(np.quantile(found, coverage, method="higher")) + 1
    return probes, float(share[probes - 1])


def chosen(x: np.ndarray, rows: int, top: int = TOP, coverage: float = COVERAGE, part_rows: int = PART_ROWS) -> tuple[Router, int, float]:
    """The router of least cost a query on unseen rows, its probes and the share of rows that it visits. A query
    costs the rows it is scored against, and PROBE for each part."""
    aside = np.arange(len(x)) % HOLD == HOLD - 1
    best = None
    for parts in PARTS:
        if best and (parts * LEARNED > (~aside).sum() or parts * part_rows > rows):
            break
        router = fit(x[~aside], parts)
        probes, share = probes_needed(router, x, np.flatnonzero(aside), rows, top, coverage)
        cost = share * rows + PROBE * probes
        if best is None or cost < best[0]:
            best = (cost, router, probes, share)
    return best[1:]


def usable(vector) -> F.Column:
    """Not null, without null or non-finite components, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles of equal length, without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, part_rows: int = PART_ROWS, coverage: float = COVERAGE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the `top` others of largest
    inner product found, ties to the smaller id; fewer only if there are fewer candidates.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
    length than the commonest (the shorter of equally common ones), nor rows with a null id. Of rows that share
    an id the smallest vector asks; all are candidates for others, none for their own id. All rows are indexed,
    each in its most probable part; a part is cut into blocks of about BLOCK rows, and its queries into groups
    of about ASKED, by hashes, so a third of all rows, or of all queries, in one part is many tasks. A block
    answers a query in one row of its `top` best. Queries probe as many parts as unseen rows of the sample
    show to be needed for `coverage`, and more if those hold few rows. Only the sample, of a fixed number of
    vectors, and two counts for each part reach the driver.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = picked(vectors, vec_id=id_col, v=vector_col).where(F.col("vec_id").isNotNull() & usable("v"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    width = sizes["d"]
    rows = rows.where(F.size("v") == width)
    order = unit_hash(F.col("vec_id"), F.lit("sample"))
    drawn = rows.select("vec_id", "v", order.alias("u")).orderBy("u", "vec_id", "v").limit(sample).select("v").toArrow().column("v").combine_chunks()
    router, probes, _ = chosen(_matrix(drawn, width), sizes["count"], top, coverage, part_rows)

    def routed(b: pa.RecordBatch) -> dict:
        best = np.argsort(-router.logits(_matrix(b.column("v"), width)), axis=1, kind="stable")
        ids = b.column("vec_id").to_pylist()
        return {"vec_id": ids, "v": b.column("v"), "part": best[:, 0], "ranked": [p.tolist() if i % every == 0 else None for p, i in zip(best, ids, strict=True)]}

    placed = stored(arrow_map(rows, routed, "vec_id long, v array<double>, part int, ranked array<int>"), "placed")
    filled = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # as many numbers as parts
    blocks = {p: -(-n // BLOCK) for p, n in filled.items()}

    def places(b: pa.RecordBatch) -> dict:
        """The parts that each query visits: its probed ones, and further ones until they hold 4 x top rows."""
        parts, at = [], []
        for i, ranked in enumerate(b.column("ranked").to_pylist()):
            seen = 0
            for k, part in enumerate(ranked):
                if k >= probes and seen >= 4 * top:
                    break
                seen += filled.get(part, 0)
                if part in filled:
                    parts.append(part)
                    at.append(i)
        at = pa.array(at, pa.int64())
        return {"part": parts, "vec_id": b.column("vec_id").take(at), "v": b.column("v").take(at)}

    asking = placed.where("ranked is not null").groupBy("vec_id").agg(F.min(F.struct("v", "ranked")).alias("r")).select("vec_id", "r.v", "r.ranked")
    asked = stored(arrow_map(asking, places, "part int, vec_id long, v array<double>"), "asked")
    groups = {r["part"]: -(-r["count"] // ASKED) for r in asked.groupBy("part").count().collect()}

    def number(of: dict[int, int]) -> F.Column:
        return F.create_map(*[F.lit(x) for p in filled for x in (p, of.get(p, 0))])[F.col("part")]

    asked = asked.select("part", F.explode(F.sequence(F.lit(0), number(blocks) - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), number(groups)).cast("int").alias("grp"), F.lit(0).alias("role"), "vec_id", "v")
    data = placed.withColumn("n", number(groups)).where("n > 0").select("part", F.pmod(F.xxhash64("vec_id", "v"), number(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("grp"), F.lit(1).alias("role"), "vec_id", "v")
    met = asked.unionByName(data).repartition("part", "block", "grp").sortWithinPartitions("part", "block", "grp", "role", "vec_id")
    hits = met.mapInArrow(_rerank(top, width), "query_id long, ids array<long>, scores array<double>")
    return hits.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(top), schema)


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 0) of the `top` largest scores of each value of `of`, ties to smaller ids; by value, best first."""
    order = np.lexsort((ids, -scores, of))
    by = of[order]
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[rank < top], rank[rank < top]


def _merged(top: int):
    """Streams the answers of blocks by query and ranks them together."""

    def told(of, ids, scores, rank):
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array((rank + 1).astype(np.int32)), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])

    def run(batches):
        held = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64))  # of the query that may go on
        for b in batches:
            if not b.num_rows:
                continue
            own = np.repeat(b.column("query_id").to_numpy(), np.diff(b.column("ids").offsets.to_numpy()))
            of, ids, scores = (np.concatenate(x) for x in zip(held, (own, b.column("ids").flatten().to_numpy(), b.column("scores").flatten().to_numpy()), strict=True))
            at, rank = _best(of, ids, scores, top)
            of, ids, scores = of[at], ids[at], scores[at]
            last = of == of[-1]
            held = (of[last], ids[last], scores[last])
            if not last.all():
                yield told(of[~last], ids[~last], scores[~last], rank[~last])
        if len(held[0]):
            yield told(*held, np.arange(len(held[0])))

    return run


def _rerank(top: int, width: int):
    """Streams (part, block, group) cells, queries first: exact scores of their rows, the best `top` of each query."""

    def best(q_ids, q, ids, x):
        for a in range(0, len(q), 256):
            rough = q[a : a + 256] @ x.T
            rough[q_ids[a : a + 256, None] == ids[None]] = -np.inf
            k = min(top, len(ids))
            floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            slack = np.where(np.isfinite(floor), 1e-9 * (1 + np.abs(floor)), 0)
            of, at = np.nonzero((rough >= (floor - slack)[:, None]) & (rough > -np.inf))
            if not len(of):
                continue
            exact = (x[at] * q[a + of]).sum(1)  # the same sum for equal vectors, wherever they stand
            order, _ = _best(of, ids[at], exact, top)
            of, found, exact = of[order], ids[at][order], exact[order]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            ends = pa.array(np.append(first, len(of)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (found, exact))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + of[first]]), *lists], ["query_id", "ids", "scores"])

    def run(batches):
        now, sides = None, ([], [])  # (ids, vectors) of queries, and of rows

        def done():
            if sides[0] and sides[1]:
                (q_ids, q), (ids, x) = ([np.concatenate(y) for y in zip(*side, strict=True)] for side in sides)
                yield from best(q_ids, q, ids, x)

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("part", "block", "grp", "role")], 1)
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("v"), width)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                cell = tuple(keys[i, :3].tolist())
                if cell != now:
                    yield from done()
                    now, sides = cell, ([], [])
                sides[keys[i, 3]].append((ids[i:j], x[i:j]))
        yield from done()

    return run
