import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mediaprism.llm import packing, tokens

PATH = public_tokenizers.path(tokens.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(0)
    letters = " \n\t \u00a0\u3000\x1c\x85.,'sdtll abcXYZ019\u00e9\u00df\u6f22\u5b57\u0663\u00bd\u00b2_-\U0001f642\u0301\r"
    odd = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    return [*odd, "a<|endoftext|> b", "<|endoftext|>", "<|endoftext", " " * 5000 + "x", "a" * 5000, "", " ", " a", " ".join(f"word{i}" for i in range(4000))]


def test_pieces_are_exact(texts):
    own = tokens.Encoder(PATH, list)
    for t in texts:
        assert [i for p in own.parts(t) for i in p] == LIBRARY.encode(t, add_special_tokens=False).ids


def test_both_encoders_agree_on_pieces():
    """Pieces up to the length at which the library itself takes over, from several kinds of alphabets."""
    r, own = random.Random(4), tokens.Encoder(PATH, list)
    for letters in ("ab", "aAzZ'\u2019st", "0123456789", "\u6f22\u5b57\u304b", "\u0627\u0644\u0301", "\U0001f600\u200d\ufe0f", ".,!?-_#@", "a\u00e91 \n\t", "\u00a0\u2003x"):
        for n in (1, 2, 3, 7, 20, 60, 300, tokens.LONG - 1, tokens.LONG, tokens.LONG + 1):
            piece = "".join(r.choice(letters) for _ in range(n))
            assert [i for p in own.parts("x " + piece) for i in p] == LIBRARY.encode("x " + piece, add_special_tokens=False).ids


def test_the_table_changes_no_count(make):
    rows = [(i, f"some words {i} and more words") for i in range(300)]
    counts = lambda **kw: sorted(map(tuple, tokens.count_tokens(make(rows), **kw).collect()))
    assert counts(frequent=0) == counts(frequent=4) == counts(frequent=100) == counts()


def test_the_table_counts_whole_texts_of_all_documents(make):
    """The pieces that only ends of long texts and last documents hold are in the table, if they are frequent there."""
    rare = " ".join(f"w{i}" for i in range(120_000))
    rows = [(0, rare + " late" * 500), *((i, "plain text") for i in range(1, 400)), (400, "x" + " last" * 300)]
    found = tokens.frequent_pieces(make(rows).coalesce(1), PATH, 16)
    assert {"late", "last", "text"} <= found.keys() and len(found) <= 16
    assert found == {x: len(LIBRARY.encode(" " + x, add_special_tokens=False).ids) for x in found}


def test_counts(spark, make, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3]), (9999, None)]
    out = tokens.count_tokens(make(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r.doc_id] if r.doc_id is not None and r.doc_id < len(texts) else ""
        n = len(LIBRARY.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert tokens.count_tokens(make([])).count() == 0


def test_query(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    out = tokens.query(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id").loc[docs.doc_id]
    assert out.n_tokens.tolist() == [len(e.ids) for e in LIBRARY.encode_batch(docs.text.tolist(), add_special_tokens=False)]


def checked(out, texts, capacity=1024):
    """Pieces are exact and in order, sequences are full without gaps; returns the number of sequences."""
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, t in texts.items():
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return len(sequences)


def test_packing(spark, make):
    r = random.Random(1)
    texts = {i: " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 60, 300, 900]))) for i in range(300)} | {400: None, 401: "", 402: "x " * 6000}
    out = packing.pack(packing.token_pieces(make(list(texts.items())))).collect()
    n = checked(out, texts)
    # no packing has fewer sequences than words need, or than pieces over half the capacity
    least = max(-(-sum(x.length for x in out) // 1024), sum(x.length > 512 for x in out))
    assert n <= least * 1.02 + 1
    repeated = packing.pack(packing.token_pieces(make([(1, "a b"), (1, "a b"), (None, "a b")]))).collect()
    assert len(repeated) == 3 and len({x.offset for x in repeated}) == 3
    assert packing.pack(packing.token_pieces(make([]))).count() == 0


def test_plan():
    r = np.random.default_rng(0)
    for counts in ({}, {1024: 5}, {1: 3}, {512: 3}, {700: 10, 324: 4}, {600: 4, 300: 4, 124: 4}, {500: 2, 200: 2, 224: 2, 100: 2}, {int(k): int(v) for k, v in zip(*np.unique(r.integers(1, 1024, 5000), return_counts=True))}):
        left, n = dict(counts), 0
        for lengths, times in packing.plan(counts):
            assert sum(lengths) <= 1024 and times > 0
            n += times
            for x in lengths:
                left[x] -= times
        assert not any(left.values())
        total = sum(k * v for k, v in counts.items())
        assert n <= -(-total // 1024) * 1.01 + 2
    assert [p for p in packing.plan({600: 1, 300: 1, 124: 1, 424: 1})][0] == ([600, 424], 1)
