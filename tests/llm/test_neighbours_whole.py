import numpy as np
from pyspark.sql import functions as F

from mediaprism.llm import crosspolytope as C


def search(spark, x, **options):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in sorted(C.search(rows, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    return found


def unit(n, size):
    x = np.random.default_rng(5).normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_one_long_row(spark):
    x = unit(2000, 64)
    x[7] *= 10
    found = search(spark, x)
    assert len(found) == 100
    hits = 0
    for q, near in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20].tolist()
        assert len(near) == 20 and (7 in near) == (7 in want)
        hits += len(set(near) & set(want))
    assert hits >= 0.95 * 2000


def test_no_list_is_short(spark):
    found = search(spark, unit(1000, 64), tables=1)
    assert len(found) == 50 and all(len(set(near) - {q}) == 20 for q, near in found.items())
