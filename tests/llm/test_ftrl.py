import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mediaprism.llm import toxicity as T

MASK = (1 << 64) - 1


def scalar_fit(examples, epochs):
    """FTRL-proximal, one coordinate at a time."""
    z, n, bias = {}, {}, "bias"

    def weight(k):
        zk, rate = z.get(k, 0.0), (T.BETA + math.sqrt(n.get(k, 0.0))) / T.ALPHA + T.L2
        if k == bias:
            return -zk / rate
        return 0.0 if abs(zk) <= T.L1 else -(zk - math.copysign(T.L1, zk)) / rate

    for _ in range(epochs):
        for places, label in examples:
            keys = [*places, bias]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for k in keys:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / T.ALPHA * w[k]
                n[k] = old + g * g
    return {k: weight(k) for k in z if k != bias and weight(k) != 0}, weight(bias)


def test_fit_equals_the_scalar_form():
    r = random.Random(1)
    examples = []
    for i in range(300):
        places = set(r.sample(range(60), 12)) | {1000 + i}
        label = int(7 in places or (9 in places and r.random() < 0.5))
        examples.append((np.array(sorted(places), np.uint32), label))
    at, w, bias = T.fit(examples, 5)
    want, want_bias = scalar_fit([(p.tolist(), y) for p, y in examples], 5)
    assert want and set(at.tolist()) == set(want) and max(at) < 1000
    assert all(math.isclose(want[int(k)], float(v), rel_tol=1e-5) for k, v in zip(at, w, strict=True)) and math.isclose(bias, want_bias, rel_tol=1e-9)


def test_features_by_hand():
    text = "You, IDIOT -- (the) Énd\tyou\n"
    words = ["you", "idiot", "the", "énd", "you"]
    h = [xxhash.xxh3_64_intdigest(w.encode()) | 1 for w in words]
    pair = lambda a, b, salt: ((a * 0x9E3779B97F4A7C15 & MASK) ^ (b + salt) * 0xC2B2AE3D27D4EB4F & MASK) * 0xD6E8FEB86659FD93 & MASK
    want = [x >> 44 for x in [*h, *(pair(a, b, 1) for a, b in zip(h, h[1:], strict=False)), *(pair(a, b, 2) for a, b in zip(h, h[2:], strict=False))]]
    assert T.all_features(text).tolist() == want
    assert T.all_features(None).tolist() == T.all_features("").tolist() == T.all_features(" -- \n").tolist() == []


def test_repeated_documents_and_bounds(spark, make):
    """A row that stands there a thousand times is one example; an id with several texts gives one each, within the bounds."""
    rows = [(i, f"word{i % 7} other{i % 5} " + ("scum" if i % 3 == 0 else "fine"), "s") for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    model = lambda docs, **o: tuple(np.asarray(x).tolist() for x in T.train(make(docs), marks, **o))
    once = model(rows)
    assert once[0] and model(rows + [rows[4]] * 1000) == once
    free = next(i for i in range(300) if i % 3 == 0 and rows[i] and __import__("zlib").crc32(str(i).encode()) % 3 != 1)
    many = rows + [(free, f"text {k} scum", "s") for k in range(500)]
    assert model(many) != once and model(many, max_rows=400)[0]
    assert model(rows, max_places=1) == ([], [], 0.0)


def test_scores_equal_a_loop(spark, make):
    rows = [(i, f"a{i % 11} b{i % 3} " + "bad " * (i % 4 == 0), "s") for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    docs = make(rows)
    places, weights, bias = T.train(docs, marks)
    table = dict(zip(places.tolist(), weights.tolist(), strict=True))
    out = {r.doc_id: r.score for r in T.score_texts(docs, (places, weights, bias)).select("doc_id", F.col("score")).collect()}
    for i, text, _ in rows:
        s = sum(table.get(k, 0.0) for k in set(T.all_features(text).tolist())) + bias
        assert math.isclose(out[i], 1 / (1 + math.exp(-s)), rel_tol=1e-6)
