"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A text's set holds its distinct 5-word shingles. K minima over seeded permutations, each cut to b
bits, make its signature; two texts of similarity s differ in about (1 - s)K symbols. For a
threshold T on that distance the K symbols are split into m chunks of c symbols with
m = floor(T / (e + 1)) + 1, so by the pigeonhole principle two signatures within T have at least
one chunk with at most e errors. Every choice of e error places in a chunk is enumerated: the
other c - e symbols are an index key. Signatures within T therefore always share a key.
T lies `z` standard deviations above the distance expected at the similarity limit.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, WIDE_ROWS, arrow_map, index_of, mix64, picked, prepare, stored, unclashed
from .components import connected_components

SHINGLE = 5
SYMBOL_BITS = 16
#: Spokes that are checked beside one copy of their hub; members of a key compared in one block, where a text counts
#: once more for every so many shingles.
SPOKES, BLOCK, HEAVY = 256, 512, 2000
#: Rows without an id stand under numbers from here on, made of their texts.
NAMELESS = 1 << 62


@dataclass(frozen=True)
class Plan:
    """Signature of `chunks` x `chunk` symbols; distance threshold `limit`; errors enumerated per chunk."""

    percent: int
    chunks: int
    chunk: int
    errors: int
    limit: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk


def plan(percent: int, errors: int = 1, z: float = 5.0) -> Plan:
    """The fewest index keys for which T >= mean + z sd at this similarity.

    Keys keep three symbols at least, and T stays under 2.6 times the expected distance, so that texts
    that only share a passage are seldom compared.
    """
    best = None
    far = 1 - percent / 100
    for chunk in range(errors + 3, 13):
        for chunks in range(1, 200):
            k, limit = chunk * chunks, chunks * (errors + 1) - 1
            if limit >= far * k + z * math.sqrt(k * far * (1 - far)):
                keys = chunks * math.comb(chunk, errors)
                if limit > 2.6 * far * k:
                    continue
                if best is None or keys < best[0] or keys == best[0] and chunk > best[1].chunk:
                    best = (keys, Plan(percent, chunks, chunk, errors, limit))
                break
    if best is None:
        raise ValueError(f"no plan for {percent} percent and {errors} errors")
    return best[1]


class _Hashes(dict):
    """64-bit word hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()
_MUL = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white spaces: exactly what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer than five words one for the whole sequence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        s = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            s += h[i : n - width + 1 + i] * _MUL[i]
        s = mix64(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signatures(sets: list[np.ndarray], p: Plan) -> np.ndarray:
    """Symbols uint16 [sets, K] of non-empty sets."""
    k = np.arange(p.symbols, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mul, add = mix64(k + np.uint64(11)) | np.uint64(1), mix64(k + np.uint64(1 << 20))
        x = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        low = np.empty((len(sets), p.symbols), np.uint64)
        for i in range(p.symbols):
            low[:, i] = np.minimum.reduceat(x * mul[i] + add[i], starts)
        return (mix64(low) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.uint16)


def index_keys(symbols: np.ndarray, p: Plan) -> np.ndarray:
    """Keys int64 [sets, slots]: a slot is a choice of error places (outer) and a chunk (inner)."""
    with np.errstate(over="ignore"):
        parts = symbols.astype(np.uint64).reshape(-1, p.chunks, p.chunk)
        base = mix64(np.arange(p.chunks, dtype=np.uint64) + np.uint64(101))
        keys = []
        for j, wrong in enumerate(itertools.combinations(range(p.chunk), p.errors)):
            key = np.broadcast_to(base + np.uint64(j), parts.shape[:2]).copy()
            for i in range(p.chunk):
                if i not in wrong:
                    key = mix64((key ^ parts[:, :, i]) + np.uint64(0x9E3779B97F4A7C15))
            keys.append(key)
    return np.concatenate(keys, 1).view(np.int64)


def first_slots(a: np.ndarray, b: np.ndarray, p: Plan) -> np.ndarray:
    """The first slot in which each row of symbols b has the same key as a."""
    same = (a == b).reshape(len(b), p.chunks, p.chunk)
    slots = [np.delete(same, wrong, axis=2).all(2) for wrong in itertools.combinations(range(p.chunk), p.errors)]
    return np.concatenate(slots, 1).argmax(1)


def _fingerprint(p: Plan):
    def rows(b: pa.RecordBatch) -> dict:
        sets, classes, at = [], [None] * b.num_rows, []
        sizes = np.zeros(b.num_rows, np.int64)
        for i, t in enumerate(b.column("text").to_pylist()):
            words = words_of(t) if t else []
            if words:
                s = shingle_set(words)
                sets.append(s)
                at.append(i)
                sizes[i] = len(s)
                classes[i] = hashlib.md5(b" ".join(words)).digest()
        sigs = [None] * b.num_rows
        if sets:
            for i, symbols in zip(at, signatures(sets, p), strict=True):
                sigs[i] = symbols.tobytes()
        return {"doc_id": b.column("doc_id"), "cls": classes, "n_shingles": sizes, "sig": sigs}

    return rows


def _symbols(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), -1)


def _keyed(p: Plan):
    def rows(b: pa.RecordBatch) -> dict:
        keys = index_keys(_symbols(b.column("sig").to_pylist()), p)
        node = b.column("node").to_numpy(zero_copy_only=False)
        size = b.column("n_shingles").to_numpy(zero_copy_only=False)
        return {"node": np.repeat(node, keys.shape[1]), "size": np.repeat(size, keys.shape[1]), "key": keys.ravel(), "slot": np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))}

    return rows


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of these nodes. The node list is broadcast only while its counted size is under a bound."""
    n = nodes.count()
    right = F.broadcast(nodes) if n <= BROADCAST_KEYS else nodes
    return docs.select(F.col("doc_id").alias("node"), "text").join(right, "node", "left_semi")


def _confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the pairs (hub, node) with 100 |A & B| >= percent |A | B|, on full sets.

    A hub's spokes are dealt out in parts of about SPOKES rows, each beside one copy of the hub's text,
    and stream past it, so a hub with any number of spokes neither meets in one task nor multiplies its text.
    """
    n = pairs.count()
    degree = pairs.groupBy("hub").count()
    salted = pairs.join(degree, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / SPOKES)).cast("int"))
    salted = stored(salted.select("hub", "salt", "node"), "pairs", n)
    nodes = stored(salted.select(F.col("hub").alias("node")).unionByName(salted.select("node")).distinct(), "nodes", 2 * n)
    texts = stored(_texts_of(docs, nodes), "texts")
    hubs = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("node"), "text")
    spokes = salted.join(texts, "node").select("hub", "salt", "node", "text")
    rows = hubs.unionByName(spokes).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node").asc_nulls_first())

    def check(batches):
        now, sets = None, []
        for b in batches:
            u, v = [], []
            for hub, salt, node, text in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "node", "text")), strict=True):
                if (hub, salt) != now:
                    now, sets = (hub, salt), []
                s = shingle_set(words_of(text or ""))
                if node is None:
                    sets.append(s)
                    continue
                for h in sets:
                    both = _common(h, s)
                    if both and 100 * both >= percent * (len(h) + len(s) - both):
                        u.append(hub)
                        v.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return stored(rows.mapInArrow(check, "u long, v long").distinct(), "links", n)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


MEMBER = "key long, slot int, lo int, hi int, side int, node long, comp long, n_shingles long, sig binary"
_KEYS = [x.split()[0] for x in MEMBER.split(", ")]


def _candidates(rows: list[tuple], p: Plan):
    """For each member i of a (key, block pair): i and the later members that it must be compared with here.

    They lie in another component and, in a pair of different blocks, in the other block; sizes and
    signature distance allow the similarity; and this key is the first one that the two share.
    """
    slot, apart = rows[0][1], rows[0][2] != rows[0][3]
    side, comp, size = (np.array([r[i] for r in rows], np.int64) for i in (4, 6, 7))
    sig = _symbols([r[8] for r in rows])
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        ok = (comp[j] != comp[i]) & (100 * np.minimum(size[j], size[i]) >= p.percent * np.maximum(size[j], size[i]))
        if apart:
            ok &= side[j] != side[i]
        j = j[ok]
        j = j[(sig[j] != sig[i]).sum(1) <= p.limit] if len(j) else j
        j = j[first_slots(sig[i], sig[j], p) == slot] if len(j) else j
        if len(j):
            yield i, j


def _groups(batches, names: list[str]):
    """Rows of each (key, lo, hi) in turn, from rows sorted by these."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            at = (row[0], row[2], row[3])
            if at != now:
                if rows:
                    yield rows
                now, rows = at, []
            rows.append(row)
    if rows:
        yield rows


def _active(p: Plan):
    """The members of each (key, block pair) that have anything to be compared with: at most the rows read."""

    def run(batches):
        for rows in _groups(batches, _KEYS):
            live = sorted({int(k) for i, j in _candidates(rows, p) for k in (i, *j)})
            if live:
                yield pa.RecordBatch.from_pylist([dict(zip(_KEYS, rows[i], strict=True)) for i in live], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary())])


def _forest(p: Plan):
    """Compares the full sets of a group's members in place, and tells only links that join components: fewer than members."""

    def run(batches):
        for rows in _groups(batches, [*_KEYS, "text"]):
            sets = [shingle_set(words_of(r[9] or "")) for r in rows]
            root: dict[int, int] = {}

            def find(x, root=root):
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            u, v = [], []
            for i, others in _candidates(rows, p):
                for j in others.tolist():
                    a, b = find(rows[i][6]), find(rows[j][6])
                    if a == b:
                        continue
                    both = _common(sets[i], sets[j])
                    if both and 100 * both >= p.percent * (len(sets[i]) + len(sets[j]) - both):
                        root[max(a, b)] = min(a, b)
                        u.append(rows[i][5])
                        v.append(rows[j][5])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def own_number(doc_id: str, text: str) -> F.Column:
    """The id, or for a null one a number from NAMELESS on, made of the text."""
    own = F.col(doc_id).cast("long")
    wrong = F.raise_error(F.lit(f"ids must be below {NAMELESS}")).cast("long")
    return F.when(own >= NAMELESS, wrong).otherwise(F.coalesce(own, F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)))


def _named(number: F.Column) -> F.Column:
    """The number, if it is an id."""
    return F.when(number < NAMELESS, number)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", p: Plan | None = None, numbers: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and, if asked for, _own, the number of own_number) for every row of docs.

    Steps: (1) fingerprint each text once; texts with equal words form a class whose smallest id stands
    for it; (2) keys shared by two or more classes survive a counted, pre-aggregated join; (3) in every
    key the members are compared with the one that most other texts share keys with (a hub), and linked
    if their full sets agree; (4) keys whose members lie in different components after that are
    searched fully, in blocks of bounded size that carry the texts and tell only links between
    components, so no such link is lost and no pairs are listed; a key's largest component only meets the
    key's other members, not itself, so a group of copies with a few strangers in its key costs in
    proportion to its members; (5) components.

    Null or blank texts have n_shingles 0 and stay alone. Rows that share an id are one document, and so are
    rows with a null id and the same text; these are linked like others, come after all ids, get the smallest
    id of their component, or null, and are kept only if no row of it has an id and theirs is the text that
    stands for it. Ties go to the smaller id. Ids of NAMELESS and more are refused. Extra columns of any name are
    ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    p = p or plan(percent)
    docs = picked(docs, doc_id=id_col, text=text_col).select(own_number("doc_id", "text").alias("doc_id"), "text")
    marks = stored(arrow_map(docs, _fingerprint(p), "doc_id long, cls binary, n_shingles long, sig binary"), "marks")
    texts_ = marks.count()
    ids = stored(marks.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("node")), "classes", texts_)
    nodes = ids.where("node is not null").select("node").distinct()
    reps = marks.where("cls is not null and doc_id is not null").join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    reps = stored(reps.select(F.col("doc_id").alias("node"), "n_shingles", "sig").distinct(), "reps", texts_, WIDE_ROWS)
    slots = reps.count() * p.chunks * math.comb(p.chunk, p.errors)  # rows of the index, which bounds what comes of it
    keyed = arrow_map(reps, _keyed(p), "node long, size int, key long, slot int")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key", "n")
    counts = stored(counts, "counts", slots)  # tables on both sides of a join let a hot key be split
    members = stored(keyed.join(counts, "key"), "members", slots)
    popular = members.groupBy("node").agg(F.sum("n").alias("fame"))
    ranked = members.join(popular, "node").select("key", F.struct("fame", (-F.col("node")).alias("low"), "size").alias("r"))
    hubs = ranked.groupBy("key").agg(F.max("r").alias("r")).select("key", (-F.col("r.low")).alias("hub"), F.col("r.size").alias("hub_size"))
    alike = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    pairs = members.join(hubs, "key").where((F.col("hub") != F.col("node")) & alike).select("hub", "node").distinct()
    links = _confirm(stored(pairs, "candidates", members.count()), docs, percent)
    comp = stored(connected_components(links), "stars_of", 2 * links.count())

    placed = members.join(comp, "node", "left").select("key", "slot", "node", "size", F.coalesce("comp", "node").alias("comp"))
    shares = placed.groupBy("key", "comp").agg(F.sum(1 + F.col("size") / HEAVY).alias("w"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("w", (-F.col("comp")).alias("low"))).alias("most"), F.sum("w").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    few, many = F.greatest(F.ceil((F.col("all") - F.col("most.w")) / BLOCK), F.lit(1)), F.ceil(F.col("most.w") / BLOCK)
    mixed = mixed.select("key", (-F.col("most.low")).alias("main"), few.cast("int").alias("few"), many.cast("int").alias("many"))
    # blocks 0 to few - 1 hold the smaller components, and meet all; the blocks after them hold the main one, and meet these alone
    main, spread = F.col("comp") == F.col("main"), lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rest = placed.join(mixed, "key").withColumn("mine", F.when(main, F.col("few") + spread("many")).otherwise(spread("few")))
    last = F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    rest = rest.select("key", "slot", "node", "comp", "mine", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    side = (F.col("mine") < F.col("other")).cast("int").alias("side")
    rest = rest.select("key", "slot", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), side, "node", "comp").join(reps, "node").select(*_KEYS)
    dealt = rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    active = stored(dealt.mapInArrow(_active(p), MEMBER), "active", members.count(), WIDE_ROWS // 10)
    live = active.count()
    texts = _texts_of(docs, stored(active.select("node").distinct(), "nodes", live))
    full = active.join(texts, "node").select(*_KEYS, "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    more = stored(full.mapInArrow(_forest(p), "u long, v long").distinct(), "more", live)
    if not more.isEmpty():
        comp = stored(connected_components(links.unionByName(more)), "components", 2 * (links.count() + more.count()))

    labels = ids.join(comp, "node", "left").select("cls", F.coalesce("comp", "node").alias("component_id"))
    out = marks.select("doc_id", "n_shingles", "cls").join(labels, "cls", "left")
    component, own = F.coalesce("component_id", "doc_id"), [F.col("doc_id").alias("_own")] if numbers else []
    return out.select(_named(F.col("doc_id")).alias("doc_id"), "n_shingles", _named(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"), *own)


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one of the smallest id, or, where no row of it
    has an id, one text. Of rows that share an id, or a null id and the text, one stays: the first by text, then
    by the other columns as JSON, so columns of any type, maps too, do. Columns of any name are kept."""
    flat = unclashed(docs)
    i, t = index_of(docs, id_col), index_of(docs, text_col)
    keep = near_duplicates(docs, percent, id_col, text_col, numbers=True).where("kept").groupBy("_own").agg(F.count("*").alias("_rows"))
    mine = flat.withColumn("_id", own_number(f"_c{i}", f"_c{t}")).join(keep, F.col("_id") == F.col("_own"))
    others = [c for c in flat.columns if c not in (f"_c{i}", f"_c{t}")]
    again = mine.where("_rows > 1").withColumn("_json", F.to_json(F.struct(*others)) if others else F.lit(""))
    w = Window.partitionBy("_id").orderBy(f"_c{t}", "_json")
    again = again.withColumn("_row", F.row_number().over(w)).where("_row = 1")
    return mine.where("_rows = 1").select(*flat.columns).unionByName(again.select(*flat.columns)).toDF(*docs.columns)
