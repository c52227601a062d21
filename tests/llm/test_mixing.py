from collections import Counter

import numpy as np
import pytest

from mediaprism.llm import cube


def plain_targets(sizes, most=3.0):
    """Targets by bisection: the level at which the capped shares add up to all sizes."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    low, high, total = 0.0, 4.0 * max([1, *sizes.values()]), sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * sizes[s], level * weight[s]) for s in names) < total else (low, level)
    return {s: min(most * sizes[s], high * weight[s]) for s in names}


def test_targets_equal_the_plain_ones():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 40):
        for spread in (1, 5, 9):
            sizes = {(None if i == 0 else f"s{i}"): int(10 ** r.uniform(0, spread)) for i in range(n)}
            assert cube.targets(sizes) == pytest.approx(plain_targets(sizes), rel=1e-9)


def test_many_sources_by_dataframes(spark, make):
    """Beyond the driver's bound: the same targets, in the order of code points, and the same mix."""
    r = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 40))), [None, "\uffff", "\U0001f600", "é", "Z", "a", "b", "zz"][min(7, int(r.exponential(2)))]) for i in range(600)]
    take = lambda n: {(x.doc_id, x.source): (x.source_size, round(x.target, 6), x.taken) for x in cube.mix(make(rows), max_sources=n).collect()}
    got = take(0)
    assert got == take(100) and len(got) == 600
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    assert all(v[0] == sizes[s] and v[1] == pytest.approx(want[s], abs=1e-4) for (_, s), v in got.items())
    assert cube.mix(make([]), max_sources=-1).count() == 0


def test_repeated_rows_are_one_unit(spark, make, monkeypatch):
    """A row that most of the table repeats: no block gets its copies, and words still come near the target."""
    rows = [(7, "a b c d e", "hot")] * 20_000 + [(100 + i, "x " * (1 + i % 9), "hot") for i in range(500)] + [(5000 + i, "y " * (1 + i % 50), "cold") for i in range(500)]
    units = cube._units(make(rows), 3.0, 100, cube.WEIGHTS, 10)
    assert units.count() == 1001 and units.agg({"m": "sum"}).first()[0] == len(rows)
    out = cube.mix(make(rows), block=100).collect()
    assert len(out) == len(rows) and all(0 <= x.copies <= 3 for x in out)
    for s in ("hot", "cold"):
        assert abs(sum(x.taken for x in out if x.source == s) - next(x.target for x in out if x.source == s)) <= 20
    kept = cube.repeat_documents(make(rows), block=100)
    assert kept.count() == sum(x.copies for x in out) and kept.filter("doc_id = 7").count() == sum(x.copies for x in out if x.doc_id == 7)
    monkeypatch.setattr(cube, "SPREAD", 1000)
    assert cube.repeat_documents(make(rows), block=100).filter("doc_id = 7").count() == sum(x.copies for x in out if x.doc_id == 7)


def test_targets():
    goal = cube.targets({"b": 100, "a": 100, None: 100, "c": 700})
    assert sum(goal.values()) == pytest.approx(1000) and goal["a"] == pytest.approx(1000 / 7)
    capped = cube.targets({"a": 1000, "b": 1, "c": 10})
    assert capped["b"] == 3 and capped["c"] == 30 and capped["a"] == 978
    assert cube.targets({}) == {} and cube.targets({"a": 0}) == {"a": 0.0}
    assert cube.targets({"\U0001f600": 1, "\uffff": 1}) == pytest.approx({"\uffff": 2 / 3, "\U0001f600": 4 / 3})


def test_flight_keeps_totals():
    r = np.random.default_rng(0)
    size = sorted(r.integers(1, 1000, 500).tolist(), reverse=True)
    p = cube.fly([0.37] * 500, size, r.random(500).tolist())
    assert sum(0 < x < 1 for x in p) <= 2 and all(0 <= x <= 1 for x in p)
    assert sum(p) == pytest.approx(0.37 * 500) and sum(a * b for a, b in zip(p, size)) == pytest.approx(0.37 * sum(size))


def test_inclusion_is_unbiased():
    r, hits = np.random.default_rng(1), np.zeros(30)
    size = [30 - i for i in range(30)]
    for _ in range(2000):
        hits += [x > 0.5 for x in cube.fly([0.3] * 30, size, r.random(30).tolist())]
    assert np.abs(hits / 2000 - 0.3).max() < 0.08


def test_repair():
    size = [5000, 300, 40, 7, 3, 1, 1]
    out = cube.repair([1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0], size, 311)
    assert abs(sum(a * b for a, b in zip(out, size)) - 311) <= 1 and set(out) <= {0.0, 1.0}
    assert cube.repair([1.0, 0.0], [5, 7], 5) == [1.0, 0.0] and cube.repair([], [], 0) == []


def test_mix(spark, make):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(r.integers(1, 60))), "abc"[min(2, i % 7)]) for i in range(6000)] + [(9001, None, None), (9002, "", "a"), (9003, "x y", None), (3, "again", "a"), (None, "z", "zz"), (3, "again", "a")]
    docs = make(rows)
    out = cube.mix(docs, block=500).collect()
    assert len(out) == len(rows) and Counter((x.doc_id, x["size"]) for x in out) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for x in out:
        assert x.taken == x.copies * x["size"] and 0 <= x.copies <= 3
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        goal[x.source] = x.target
        assert x.source_size == sum(len((t or "").split()) for _, t, s in rows if s == x.source)
    assert goal == pytest.approx(plain_targets(dict(sizes)))
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal if s in ("a", "b", "c"))
    key = lambda rows: sorted((str(x.doc_id), x.unit, x.taken) for x in rows)
    assert key(out) == key(cube.mix(docs.repartition(7), block=500).collect())
    deep = cube.mix(docs, block=20).collect()  # several levels
    assert len(deep) == len(rows) and all(abs(sum(x.taken for x in deep if x.source == s) - goal[s]) <= 60 for s in "abc")
    again = cube.repeat_documents(docs, block=500)
    assert again.columns == docs.columns
    assert sum(len((x.text or "").split()) for x in again.collect()) == sum(taken.values())
    assert cube.mix(make([])).count() == 0 and cube.repeat_documents(make([])).count() == 0
