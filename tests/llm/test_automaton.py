import random

from mediaprism.llm.automaton import SuffixAutomaton, covered, remove_reference


def plain(words, reference, size):
    windows = {tuple(r[i : i + size]) for r in reference for i in range(len(r) - size + 1)}
    gone = [False] * len(words)
    for i in range(len(words) - size + 1):
        if tuple(words[i : i + size]) in windows:
            gone[i : i + size] = [True] * size
    return gone


def test_against_windows():
    r = random.Random(0)
    for _ in range(300):
        letters = [b"a", b"b", b"c"][: r.randrange(1, 4)]
        text = lambda n: [r.choice(letters) for _ in range(r.randrange(n))]
        reference = [text(25) for _ in range(r.randrange(4))]
        words, size = text(40), r.randrange(1, 6)
        assert covered(words, [SuffixAutomaton(reference)], size) == plain(words, reference, size)
        assert covered(words, [SuffixAutomaton([x]) for x in reference], size) == plain(words, reference, size)


def test_documents(spark, make):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = make([(1, f"a b {passage} c"), (2, None), (3, "short"), (1, f"a b {passage} c")])
    out = remove_reference(docs, [passage + " tail", None, "x y"], 35)
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, "a b c"), (1, "a b c"), (3, "short")] and out.columns == docs.columns
    assert remove_reference(docs, []).count() == 4 and remove_reference(make([]), [passage]).count() == 0
