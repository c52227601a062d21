import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediaprism.llm import crosspolytope as C


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS bucket", "2 AS ids", "'x' AS vector")


def search(spark, rows, **options):
    out = C.search(frame(spark, rows), F.col("vec_id") % 20 == 0, **options).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def share(found, x, k=20):
    """Recall against brute force; lists are whole and scores are inner products."""
    hits = total = 0
    for q, near in found.items():
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:k]
        ids = [i for i, _ in near]
        assert len(ids) == len(set(ids)) == len(want) and q not in ids and np.allclose([v for _, v in near], s[ids], rtol=1e-12, atol=1e-300)
        assert near == sorted(near, key=lambda e: (-e[1], e[0]))
        hits, total = hits + len(set(ids) & set(want)), total + len(want)
    return hits / total


@pytest.mark.parametrize("n", [400, 3000])
def test_one_rule_at_every_size(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = search(spark, list(zip(range(n), x.tolist(), strict=True)), chunk=300)
    assert len(found) == n // 20 and share(found, x) >= 0.95


def test_recall(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(6000, 32)) * np.where(np.arange(6000) % 5, 1, 3)[:, None]
    found = search(spark, [(i, v.tolist()) for i, v in enumerate(x)], chunk=700)
    assert len(found) == 300 and share(found, x) >= 0.95


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [3.0]), (60, [])]
    found = search(spark, rows, k=3)
    assert found[0] == [(40, 3.0), (1, 1.0), (20, 1.0)]
    assert found[20] == [(40, 3.0), (40, 3.0), (0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)]  # two rows with one id, each with its list
    assert found[40] == [(0, 3.0), (1, 3.0), (20, 3.0)] and set(found) == {0, 20, 40}
    assert search(spark, [(20, [1.0])]) == {} and search(spark, []) == {}


def test_a_third_of_the_rows_alike(spark):
    r = np.random.default_rng(3)
    x = [[1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else r.normal(size=4).tolist() for i in range(900)]
    found = search(spark, list(enumerate(x)))
    assert len(found) == 45 and share(found, np.array(x)) >= 0.95


def test_norms_of_any_size(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 5))
    x[::7] *= 1e160
    x[::11] *= 1e-170
    found = search(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for q, near in found.items():
            s = (x * x[q]).sum(1)
            assert len(near) == 20 and [v for _, v in near] == sorted((v for _, v in near), reverse=True)
            if q % 7:
                s[q] = -np.inf
                assert len(set(i for i, _ in near) & set(np.argsort(-s)[:20].tolist())) >= 15


def test_negative_products(spark):
    """All rows point away from the query: every cell is probed."""
    x = -np.abs(np.random.default_rng(4).normal(size=(400, 8)))
    x[0] = 1.0
    found = search(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    s = x @ x[0]
    assert [i for i, _ in found[0]] == [i for i in np.argsort(-s).tolist() if i != 0][:20]


@pytest.mark.parametrize("size", [1, 2, 8, 64, 128])
def test_hadamard(size):
    signs = C.rotations(2, size)
    x = np.random.default_rng(0).normal(size=(5, size))
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.kron([[1, 1], [1, -1]], h)
    want = x
    for s in signs[1, 0]:
        want = (want * s) @ h / np.sqrt(size)
    assert np.allclose(C.rotate(x, signs[1, 0]), want)
    assert (C.axes(x, signs[1, 1]).argmax(1) % size == np.abs(C.rotate(x, signs[1, 1])).argmax(1)).all()


def test_query(spark):
    e = pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = {}
    for r in sorted(C.query(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.zeros((e.vec_id.max() + 1, 64))
    x[e.vec_id] = np.array(e.embedding.tolist(), dtype=np.float64)
    assert len(e) == len(x) and len(found) == len(x) // 20 and share(found, x) >= 0.95
