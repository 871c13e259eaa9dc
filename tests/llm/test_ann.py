"""Learned partitions: recall against brute force, the share of rows visited, repeated ids, hot parts."""

import collections
import glob

import duckdb
import numpy as np
import pytest

from signalloom.llm import ann


def exact(ids, x, i, top=20):
    s = (x * x[i]).sum(1)
    return [(int(v), float(s[j])) for j in np.lexsort((ids, -s)) if (v := ids[j]) != ids[i]][:top]


@pytest.mark.parametrize(("pattern", "most"), [("sf0.1/embeddings.parquet", 0.85), ("check_s/embeddings.parquet/*.parquet", 0.82), ("check_l/embeddings.parquet/*.parquet", 0.66)])
def test_recall_and_visited_share(pattern, most):
    """These vectors point anywhere alike, so neighbours are spread wide: see README."""
    path = f"/root/testdata/{pattern}"
    if not glob.glob(path):
        pytest.skip("no such table")
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    router, probes, share = ann.chosen(x[np.random.default_rng(5).permutation(len(x))[: ann.SAMPLE]], len(x))
    asked = np.flatnonzero(ids % 20 == 0)
    z = router.logits(x)
    own, visited = z.argmax(1), np.argsort(-z[asked], axis=1, kind="stable")[:, :probes]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-s, 19, axis=1)[:, :20]
    assert np.mean([np.isin(own[n], v).mean() for n, v in zip(near, visited, strict=True)]) >= 0.9
    true = np.bincount(own, minlength=z.shape[1])[visited].sum(1).mean() / len(x)
    assert true <= most and abs(true - share) < 0.03


def test_clusters_need_few_probes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 32)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, _, share = ann.chosen(x[:4000], len(x))
    assert share < 0.15


@pytest.mark.parametrize(("block", "group"), [(4096, 2048), (16, 3)])
def test_repeated_ids_and_split_cells(spark, monkeypatch, block, group):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "ASKED", group)
    monkeypatch.setattr(ann, "probes_needed", lambda router, *_: (len(router.b), 1.0))  # all parts: exact answers
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 8)), 1)  # ties
    x[100:200] = x[100]  # a third of all rows in one part
    ids = rng.integers(0, 260, 300)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df.repartition(5)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    asking = sorted({int(i) for i in ids if i % 20 == 0})
    assert sorted(got) == asking
    for i in asking:
        at = min(np.flatnonzero(ids == i), key=lambda k: tuple(x[k]))  # the smallest vector asks
        want = exact(ids, x, at)
        assert got[i] == want
