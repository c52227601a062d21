import itertools
import random

import corpus_pipeline
from mediaprism.llm import minhash, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(texts):
    """Smallest position reachable at a similarity of 0.8, by comparing all pairs."""
    sets, at = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if at[i] != at[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((at[i], at[j]))
            at = [a if x == b else x for x in at]
    return at


def changed(r, words, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
    return " ".join(words)


def test_stage_takes_near_copies(spark, make, tmp_path):
    r = random.Random(1)
    rows = []
    for g in range(20):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, changed(r, words, 3)), (10 * g + 2, changed(r, words, 40))]
    bits = [(simhash.fingerprint(rows[3 * g][1]) ^ simhash.fingerprint(rows[3 * g + 1][1])).bit_count() for g in range(20)]
    assert sum(b > 3 for b in bits) >= 5
    kept = corpus_pipeline.near_dedup(spark, make(rows), str(tmp_path))
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == [x for g in range(20) for x in (10 * g, 10 * g + 2)]


def test_components_equal_brute_force(spark, make):
    r = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    texts = [changed(r, base, r.randrange(1, 9)) for _ in range(150)]
    texts += [" ".join(f"q{r.randrange(9)}" for _ in range(r.randrange(1, 12))) for _ in range(60)]
    texts += ["one two", "ONE\ttwo", "one two three", None, "", " \n ", "a b c d e f g h i", "a b c d e f g h i j", "a b c d e f g h", texts[0], texts[0]]
    rows = [(i + 3, t) for i, t in enumerate(texts)] + [(3, texts[0]), (None, "one two")]
    texts = [t for _, t in rows]
    at, empty = classes(texts), [i for i, t in enumerate(texts) if not plain_set(t)]
    at = [empty[0] if i in empty else x for i, x in enumerate(at)]
    out = minhash.near_duplicates(make(rows)).collect()
    assert len(out) == len(rows) and len(set(at)) > 40
    roots = {}
    for x in out:
        k = next(i for i, (d, _) in enumerate(rows) if d == x.doc_id)
        assert roots.setdefault(at[k], x.root) == x.root
    assert len(set(roots.values())) == len(set(at))
    kept = minhash.keep_first(make(rows)).select("doc_id").collect()
    assert sorted(x.doc_id for x in kept) == sorted({min(d for i, (d, _) in enumerate(rows) if at[i] == c and d is not None) for c in set(at)})
    assert minhash.keep_first(make([])).count() == 0


def test_simhash_is_the_first_search(spark, make, tmp_path):
    """Pairs at exactly 0.8 without a common MinHash bucket, which were lost, have equal fingerprints here."""
    rows = []
    for k in (3684, 13778):
        head = "x " * 60 + " ".join(f"{c}{k}" for c in "abcdefg")
        rows += [(k, f"{head} h{k}"), (k + 1, f"{head} i{k}")]
        a, b = (minhash.shingle_set(t) for _, t in rows[-2:])
        assert not set(minhash.buckets(a)) & set(minhash.buckets(b))
    rows += [(1, "x " * 60 + "a b c d e f g"), (2, "x " * 60 + "h i j k l m n")]  # equal fingerprints, too, but not similar
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    kept = corpus_pipeline.near_dedup(spark, make(rows), str(tmp_path))
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == [1, 2, 3684, 13778]


def test_simhash_classes_share_buckets(spark, make):
    """Every two similar sets within one class share a bucket, whatever their sizes are."""
    rows = [(i, i + 1, 7) for i in range(400)]
    found = minhash.simhash_buckets(spark.createDataFrame(rows, "node bigint, size int, fp bigint")).collect()
    by = {}
    for x in found:
        by.setdefault(x.size, set()).add(x.bucket)
    assert all(by[a] & by[b] for a in by for b in by if 5 * a >= 4 * b and a <= b) and not by[100] & by[200]


def test_blocks_of_a_drifting_group(spark, make, monkeypatch):
    """Near copies that drift apart, cut into many small blocks: the same components as all pairs give."""
    r, base = random.Random(11), [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(r.randrange(0, 5)):
            words[r.randrange(60)] = f"x{r.randrange(400)}"
        texts.append(" ".join(words))
    docs = make([(i, t) for i, t in enumerate(texts)])
    sets = [set(minhash.shingle_set(t).tolist()) for t in texts]
    root = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if k in (x, y) else k for k in root]
    want = sorted(tuple(i for i in range(150) if root[i] == k) for k in set(root))

    def groups():
        out = {}
        for x in minhash.near_duplicates(docs).collect():
            out.setdefault(x.root, []).append(x.doc_id)
        return sorted(tuple(sorted(g)) for g in out.values())

    assert groups() == want and 1 < len(want) < 150
    for nodes, shingles in ((7, 1 << 20), (1024, 500)):
        monkeypatch.setattr(minhash, "BLOCK_NODES", nodes)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        assert groups() == want
