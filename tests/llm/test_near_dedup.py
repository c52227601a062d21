import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from mediaprism.llm import golay, simhash
from mediaprism.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps):
    """Smallest position reachable, by comparing all pairs."""
    at = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 and at[i] != at[j]:
            a, b = sorted((at[i], at[j]))
            at = [a if x == b else x for x in at]
    return at


def test_golay():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 3000)
    narrow, wide = golay.keys(words)
    assert (golay.tables()[2] >= 0).sum(1).max() == 6 and len(set(narrow)) > 1000
    for bit in range(23):
        near, _ = golay.keys(words ^ (1 << bit))
        assert (wide == near[:, None]).any(1).all()
    assert (wide == narrow[:, None]).any(1).all()


def test_no_link_is_lost(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for b in base.tolist():
        for k in range(8):
            fps.add(b ^ sum(1 << int(i) for i in r.choice(64, k % 6, replace=False)))
    fps = sorted(fps)
    want = {tuple(sorted(np.array([a, b], np.uint64).view(np.int64).tolist())) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    assert {(x.a, x.b) for x in simhash.links(df).collect()} == want and want


def test_keys_are_not_broadcast(spark):
    """48 wide keys a fingerprint look like one to Spark; over 0.6 GB of documents the driver had no memory for them."""
    plan = simhash.links(spark.range(2000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents(spark, make):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = ["The cat sat on the mat today", "the CAT sat on\tthe mat  today", None, "", " \n ", "É a B", long, long + " x", long.replace("w7 ", "v7 "), "one", "one", "two words"]
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)] + [(5, texts[0]), (None, "one")]
    out = simhash.near_duplicates(make(rows)).collect()
    assert len(out) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    at = classes(fps)
    for r in out:
        k = next(i for i, (d, t) in enumerate(rows) if d == r.doc_id)
        assert r.fp & (2**64 - 1) == fps[k]
        assert r.component_id == min(d for i, (d, _) in enumerate(rows) if at[i] == at[k] and d is not None)
    kept = simhash.keep_first(make(rows)).select("doc_id", "score").collect()
    assert sorted(r.doc_id for r in kept) == sorted({min(d for i, (d, _) in enumerate(rows) if at[i] == c and d is not None) for c in set(at)})
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.keep_first(make([])).count() == 0


def test_query(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    out = simhash.query(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id").loc[docs.doc_id]
    fps = [plain_fingerprint(t) for t in docs.text]
    assert out.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    at = classes(fps)
    ids = docs.doc_id.tolist()
    assert out.component_id.tolist() == [min(ids[i] for i in range(len(ids)) if at[i] == at[k]) for k in range(len(ids))]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 7), (300, 301), (301, 300)] + [(1000, 400 + i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[200] == 0 and found[301] == 300 and 100 not in found and found[1000] == 400 and found[449] == 400
    assert components(spark.createDataFrame([], "a bigint, b bigint")).filter(F.lit(True)).count() == 0
