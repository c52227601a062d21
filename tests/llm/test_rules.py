import duckdb
import pytest

from mediaprism.llm import quality, registry, urlrules

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def plain_repeats(words, size=8):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    seen = {w: windows.count(w) for w in set(windows)}
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(size)})


def test_quality(spark, make):
    good = " ".join(f"w{i}" for i in range(50))
    texts = [good, "a b " * 30, "x " * 7, "x " * 8, "x " * 9, None, "", "#$ é|<\n\n l \nl\n l ", good + " " + good, " ".join(f"v{i % 40}" for i in range(3000)), "\u3000a\u00a0b"]
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(0, good, "h"), (100, good, None)]
    out = {r.doc_id: r for r in quality.quality_rules(make(rows)).collect()}
    for i, t in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
        r = out[i]
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), plain_repeats(words), sum(map(len, words))), t
    assert out[7].n_symbols == 4 and out[7].n_dup_lines == 1 and out[0].kept is not None and quality.quality_rules(make(rows)).count() == len(rows)
    assert out[100].kept and quality.quality_rules(make([])).count() == 0


def test_hosts(spark, make):
    good, bad = " ".join(f"w{i}" for i in range(50)), "short"
    rows = [(i, bad if i % 10 else good, "spam") for i in range(300)] + [(1000 + i, bad if i % 10 == 0 else good, f"s{i % 5}") for i in range(500)] + [(5000, bad, None), (5001, good, None)]
    out = {r.doc_id: r.kept for r in quality.quality_rules(make(rows)).collect()}
    assert not any(out[i] for i in range(300)) and all(out[1000 + i] for i in range(500) if i % 10) and out[5001] and not out[5000]


@pytest.mark.parametrize("spam", [0, 1, 3])
def test_host_verdicts_decide_rows(spark, tmp_path, spam):
    """Against the oracle on a table in which some hosts go: rows that pass the base rules are not kept there."""
    good, bad = " ".join(f"w{i}" for i in range(50)), "short"
    rows = [(h * 1000 + i, bad if i % 10 == h % 10 else good, f"host{h}") for h in range(12) for i in range(60)]
    rows += [(50_000 + h * 1000 + i, bad if i % 4 else good, f"spam{h}") for h in range(spam) for i in range(80)] + [(90_000, bad, "tiny"), (90_001, good, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["op5_quality_rules"])
    got = registry.QUERIES["op5_quality_rules"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    dropped = {r.doc_id for r in got if not r.base_failed and not r.kept}
    assert dropped == {i for i, text, host in rows if text == good and host and host.startswith("spam")}


def test_no_host_goes_where_all_are_alike(spark, make):
    good, bad = " ".join(f"w{i}" for i in range(50)), "short"
    for n in (0, 9, 10):
        out = quality.quality_rules(make([(i, bad if i % 10 < n else good, f"s{i % 7}") for i in range(700)])).collect()
        assert all(r.kept != r.base_failed for r in out) and sum(r.base_failed for r in out) == 70 * n


def test_urls(spark):
    rows = [
        (1, "http://a.net/x", "<link rel=canonical href='http://b.example.org/en/1?x=1'>"), (2, "HTTPS://B.Example.ORG/en/1?x=1#f", None), (3, "http://c.net/z", '<META http-equiv="refresh" content="0; URL=http://a.net/x">'),
        (4, "http://d.net", '<link rel="canonical" href="/home"/>'), (5, None, None), (6, "foo", ""), (7, "http://d.net/home#t", None), (8, "http://www.q.org/a", ""), (8, "http://www.q.org/a", ""), (9, "x://E.COM:80?a://b", None), (10, "http://z.com/de/", None), (11, "http://notexample.org/es/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 AS host", "2 AS node", "3 AS rule")
    out = {r.page_id: r for r in urlrules.judge_urls(pages, urlrules.PRODUCTION_RULES).collect()}
    assert {k: r.verdict for k, r in out.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow"}
    assert (out[2].host, out[2].path, out[2].rule) == ("b.example.org", "/en/1", "example.org/en/1") and (out[9].host, out[9].path) == ("e.com:80", "") and (out[5].host, out[6].path) == ("", "") and out[11].rule == "org/"
    more = spark.createDataFrame([("http://www.q.org/a", "http://c.net/z")], "url string, target string")
    allowed = {r.page_id: r.verdict for r in urlrules.judge_urls(pages, urlrules.PRODUCTION_RULES, more).collect()}
    assert allowed[8] == "allow" and allowed[1] == allowed[2] == allowed[3] == "block"  # allow holds for the URL itself, and clears nobody else
    assert urlrules.judge_urls(pages.filter("page_id > 99"), urlrules.PRODUCTION_RULES).count() == 0 and urlrules.judge_urls(pages, urlrules.PRODUCTION_RULES).count() == len(rows)


def test_every_link_of_a_page_counts(spark):
    """A second canonical link, a second refresh, dot segments, queries alone and a base: each leads to a blocked page."""
    bad = "http://x.example.org/en/1"  # blocked by rule
    rows = [(0, bad, None)] + [
        (i, f"http://h{i}.net/a/b/c?q=1", html)
        for i, html in enumerate([
            f'<link rel="canonical" href="/ok"><link rel="canonical" href="{bad}">', f'<meta http-equiv="refresh" content="1; url=/ok"><meta http-equiv="refresh" content="1; url={bad}">',
            '<link rel="canonical" href="../x/./y/..?z">', '<link rel="canonical" href="?z">', '<base href="http://x.example.org/en/"><link rel="canonical" href="1">', '<base href="../../"><link rel="canonical" href="w">', '<link rel="canonical" href="http://h7.net/p/../q">', '<link rel="canonical" href="mailto:a@b">',
        ], 1)
    ] + [(20, "http://h3.net/a/x/?z", f'<link rel="canonical" href="{bad}">'), (21, "http://h4.net/a/b/c?z", f'<link rel="canonical" href="{bad}#top">'), (22, "http://h6.net/w", f'<link rel="canonical" href="{bad}">'), (23, "http://h7.net/q", f'<link rel="canonical" href="{bad}">')]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r.page_id: r.verdict for r in urlrules.judge_urls(pages, urlrules.PRODUCTION_RULES).collect()}
    assert [i for i in out if out[i] == "allow"] == [8] and len(out) == len(rows)


def test_clashing_names_of_redirects(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "")], "page_id int, url string, html string").selectExpr("*", "'x' AS target", "'y' AS to", "'z' AS rest")
    redirects = spark.createDataFrame([("http://a.net/", "http://example.org/es/", "q", "r")], "url string, target string, host string, to_node string")
    assert [r.verdict for r in urlrules.judge_urls(pages, urlrules.PRODUCTION_RULES, redirects).collect()] == ["block"]


def test_resolved_references(spark):
    base = "http://a/b/c/d;p?q"
    cases = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x", "#s": None, "": None, "mailto:x": None, "HTTPS://X/../y": "HTTPS://X/y"}
    df = spark.createDataFrame([(k, base) for k in cases], "r string, b string")
    assert {x.r: x.v for x in df.select("r", urlrules.resolve(df.r, df.b).alias("v")).collect()} == cases
