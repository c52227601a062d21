import hashlib
import random
from collections import Counter

import pandas as pd

from mediaprism.llm import substrings


def plain(texts, size=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


def test_planted(spark, make):
    r = random.Random(0)
    word = lambda: "w" + str(r.randrange(10**9))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(n) for n in (34, 35, 36, 50, 120)]
    texts = [None, "", "short", " ".join(["a"] * 34), " ".join(["a"] * 35), " ".join(["a"] * 36), " ".join(["x", "y"] * 400), " ".join(str(i % 37) for i in range(500))]
    for k in range(60):
        parts = fresh(r.randrange(0, 90))
        for s in r.sample(shared, r.randrange(0, 3)):
            parts += s + fresh(r.choice([0, 1, 5, 60]))
        texts.append(" ".join(parts))
    long = fresh(4000)
    texts += [" ".join(long)] * 2 + [" ".join([*long[:2000], "edit", *long[2001:]])] + [" ".join(long[1000:1034]), "\n".join(long[3900:]), "\u3000".join(fresh(40)), " ".join(fresh(9000) + shared[4])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(12, texts[12]), (None, " ".join(long[50:120]))]
    want = plain([t for _, t in rows])
    docs = make(rows)
    out = substrings._with_ranges(docs, 35, 8).mapInArrow(substrings._kept(35, False), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string").collect()
    assert Counter(map(tuple, out)) == Counter((d, *w[:3]) for (d, _), w in zip(rows, want))
    left = Counter((x.doc_id, x.text) for x in substrings.remove_repeats(docs).collect())
    assert left == Counter((d, t if not w[1] else w[3]) for (d, t), w in zip(rows, want))
    assert substrings.remove_repeats(docs).columns == docs.columns and substrings.remove_repeats(make([])).count() == 0


def test_query(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    out = substrings.query(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id").loc[docs.doc_id]
    assert list(map(tuple, out.to_numpy().tolist())) == [w[:3] for w in plain(docs.text)]
