import itertools
import re

from pyspark.sql import functions as F

from mediaprism.functions.urls import Url, with_url
from mediaprism.operators import blocklists, dedupe, filters, sanitize, security
from mediaprism.operators.dedupe import DedupeOptions
from mediaprism.plans.pipeline import Extractor
from mediaprism.sources.html import html_items
from mediaprism.sources.texts import text_items, urls_in_text

URL = Url("url")
SCHEMA = "ord long, url string, width double, height double, status string, media_type string, file_size long"


def rows(spark, *items):
    full = [(i, u, *(more + (None,) * (2 - len(more))), "safe", "image", None) for i, (u, *more) in enumerate((x[0], *x[1:]) if isinstance(x, tuple) else (x,) for x in items) for more in [tuple(more)]]
    return with_url(spark.createDataFrame(full, SCHEMA), "url")


def ords(df):
    return sorted(r.ord for r in df.select("ord").collect())


def test_dedupe(spark):
    df = rows(spark, "https://E.com/a?b=1&a=2", "https://e.com/a?a=2&b=1", "https://e.com/a", "https://e.com/x/A.jpg", "https://f.com/a.jpg", ("https://e.com/a/", 10.0, 10.0))
    assert ords(dedupe.deduplicate(df, DedupeOptions("exact"))) == [0, 1, 2, 3, 4, 5]
    assert ords(dedupe.deduplicate(df, DedupeOptions("normalized"))) == [0, 2, 3, 4]
    assert ords(dedupe.deduplicate(df, DedupeOptions("normalized", keep_first=False))) == [1, 3, 4, 5]
    assert ords(dedupe.deduplicate(df, DedupeOptions("normalized", prefer_with_dimensions=True))) == [0, 3, 4, 5]
    assert ords(dedupe.deduplicate(df, DedupeOptions("filename"))) == [0, 3, 5]
    assert dedupe.count_duplicates(df).first().duplicates == 2
    once = dedupe.deduplicate(df, DedupeOptions("path"))
    assert ords(dedupe.deduplicate(once, DedupeOptions("path"))) == ords(once)
    assert ords(dedupe.deduplicate(df.filter("ord > 99"))) == []


def test_smart_key(spark):
    df = rows(spark, "https://e.com/p/q/cat_large.jpg", "https://e.com/p/q/cat-800x600.png", "https://e.com/p/q/cat@2x.webp", "https://e.com/p/z/cat.jpg")
    assert ords(dedupe.deduplicate(df, DedupeOptions("smart"))) == [0, 3]


def test_size_variants_follow_a_plain_loop(spark):
    names = ["a_small.jpg", "a_large.jpg", "a.jpg", "b-10x20.jpg", "b.jpg"]
    sizes = [(100.0, 100.0), (500.0, 505.0), (None, None), (200.0, 100.0), (300.0, 280.0)]
    items = [(f"https://e.com/{n}", *s) for n, s in itertools.product(names, sizes)]
    df = rows(spark, *items)

    def stripped(u):
        for p in (r"[-_](small|medium|large|thumb|preview|full|original)", r"[-_]\d+x\d+", r"[-_](s|m|l|xl|xxl)", r"@\d+x"):
            u = re.sub(p, "", u, count=1, flags=re.I)
        return u

    def variant(a, b):
        ra, rb = (x[1] / x[2] if x[1] and x[2] else None for x in (a, b))
        return stripped(a[0]) == stripped(b[0]) and (ra is None or rb is None or abs(ra - rb) / max(ra, rb) <= 0.1)

    seeds, want = [], []
    for i, x in enumerate(items):
        s = next((s for s in seeds if variant(items[s], x)), i)
        if s == i:
            seeds.append(i)
        want.append(s)
    got = [r.variant for r in dedupe.group_size_variants(df).orderBy("ord").collect()]
    assert got == want
    best = {r.ord for r in dedupe.keep_largest_variants(df).collect()}
    pixels = lambda i: (items[i][1] or 0) * (items[i][2] or 0)
    assert best == {max((i for i, w in enumerate(want) if w == s), key=lambda i: (pixels(i), -i)) for s in seeds}


def test_patterns_and_domains(spark):
    df = rows(spark, "https://a.com/photo.jpg", "https://a.com/photox.jpg", "https://sub.a.com/PHOTO9.jpg", "https://b.com/ads/x.gif")
    flag = lambda c: [r[0] for r in df.orderBy("ord").select(c).collect()]
    assert flag(filters.matches_pattern(URL.raw, "photo?.jpg")) == [False, True, True, False]
    assert flag(filters.matches_pattern(URL.raw, "photo?.jpg", True)) == [False, True, False, False]
    assert flag(filters.matches_domain(URL, "*.a.com")) == [True, True, True, False]
    assert flag(filters.matches_domain(URL, "a.com")) == [True, True, True, False]
    assert flag(filters.is_unwanted(URL)) == [False, False, False, True]
    b = filters.FilterBuilder(df).include("photo*").not_from_domains("sub.a.com")
    assert b.count() == 2 and b.any() and b.first().first().ord == 0 and ords(b.execute()) == [0, 1]
    assert flag(filters.matches_any(URL.raw, [])) == [False] * 4


def test_dimensions(spark):
    both = filters.combine_dimensions(filters.DimensionFilter(min_width=10, max_height=50), filters.DimensionFilter(min_width=20, max_height=40))
    assert both == filters.DimensionFilter(min_width=20, max_height=40)
    df = rows(spark, ("u:a", 10.0, 10.0), ("u:b", 100.0, 100.0), ("u:c", 500.0, 500.0), ("u:d", 2000.0, 1000.0), "u:e", ("u:f", 5.0, None))
    groups = [r[0] for r in df.orderBy("ord").select(filters.size_group(F.col("width"), F.col("height"))).collect()]
    assert groups == ["tiny", "small", "medium", "large", "unknown", "tiny"]
    assert [r.ord for r in filters.sort_by_size(df).collect()] == [3, 2, 1, 0, 4, 5]
    assert ords(df.filter(filters.check_dimensions(F.col("width"), F.col("height"), filters.preset_dimensions("any")))) == [0, 1, 2, 3]


def test_blocklists(spark):
    assert blocklists.parse_cidr("192.168.0.0/24") == (3232235520, 3232235775) and blocklists.parse_cidr("1.2.3") is None and blocklists.parse_cidr("0.0.0.0/0") == (0, 2**32 - 1)
    rules = blocklists.Blocklist(domains=("bad.com", "*.evil.org"), ranges=("192.168.0.0/24",)).allow("ok.bad.com")
    df = rows(spark, "http://192.168.0.100/x", "https://x.evil.org/", "https://sub.bad.com/", "https://ok.bad.com/", "https://fine.com/")
    hits = [r[0] for r in df.orderBy("ord").select(blocklists.check(URL, rules)["list"]).collect()]
    assert hits == ["ip-range", "wildcard", "domain-registered", None, None]
    assert rules.unblock("BAD.com").stats() == {"domains": 0, "wildcards": 1, "ip_ranges": 1, "url_patterns": 0}


def test_scanner(spark):
    df = rows(spark, "https://e.com/a.jpg", "javascript:alert(1)", "https://e.com/?utm_content=1", "https://аpple.com/", "http://localhost/x", "https://e.com/" + "%41" * 40, "nonsense", ("https://e.com/p.gif", 1.0, 1.0))
    out = {r.ord: r.security for r in security.Scanner().scan(df, URL, "width", "height").collect()}
    assert (out[0].status, out[0].risk_score) == ("safe", 0)
    assert out[1].status == "blocked" and out[2].status == "blocked" and out[2].threats[0].matched_pattern.startswith("on[a-z]")
    assert [t.type for t in out[3].threats] == ["homograph"] and out[3].threats[0].severity == "low"
    assert [t.type for t in out[4].threats] == ["private-ip", "blocked-ip"] and out[4].risk_score == 100
    assert [t.type for t in out[5].threats].count("obfuscated-url") == 2
    assert out[6].threats == [] and out[7].threats[0].matched_pattern == "1x1"
    literal = security.Scanner(literal=True).scan(df, URL).filter("ord = 0").first().security
    assert literal.status == "blocked" and literal.threats[0].type == "blocked-domain"
    assert security.Scanner.from_preset("strict") == security.Scanner.from_preset("paranoid")


def test_homograph_letters(spark):
    df = spark.createDataFrame([("gοοgle.com",), ("bücher.de",), ("plain.com",), ("ελ",)], "h string")
    found = [r[0] for r in df.select(security.homograph_threat(F.col("h"))).collect()]
    assert found[0].severity == "medium" and "'ο' for 'o'" in found[0].description and found[1].severity == "low" and found[2] is None and found[3] is None


def test_sanitizers(spark):
    df = spark.createDataFrame([(0, " https://e.com/a b?utm_source=x&id=1 "), (1, "java\nscript:x"), (2, "data:image/png;base64,abc"), (3, "https://e.com/<x>"), (4, None), (5, "javascript%3Aalert(1)")], "ord int, url string")
    assert [r.s for r in sanitize.with_sanitized_url(df, "url", "s").orderBy("ord").collect()] == ["https://e.com/a%20b?id=1", None, None, "https://e.com/%3Cx%3E", None, None]
    assert sanitize.with_sanitized_url(df, "url", "s", allow_data_urls=True).filter("ord = 2").first().s == "data:image/png;base64,abc"
    names = spark.createDataFrame([("___",), ("a<b>c",), ("é.txt",), ("x" * 300 + ".jpg",)], "n string")
    assert [r[0][:8] for r in names.select(sanitize.sanitize_filename(F.col("n"))).collect()] == ["file", "a_b_c", "é.txt", "x" * 8]
    html = spark.createDataFrame([("""<script>x</script><p onclick="a()">t</p><a href='javascript:b'>l</a><img src=http://e.com/a.png>""",)], "h string")
    assert html.select(sanitize.sanitize_html(F.col("h"))).first()[0] == "x<p>t</p><a href='#blocked'>l</a><img src=http://e.com/a.png>"
    assert [r.url for r in sanitize.safe_urls(html, "h").collect()] == ["http://e.com/a.png"]


def test_text_urls(spark):
    df = spark.createDataFrame([(1, "See https://example.com/photo.jpg, and https://example.com/video.mp4."), (2, None), (3, "no url")], "text_id int, text string")
    assert df.select(urls_in_text(F.col("text"))).first()[0] == ["https://example.com/photo.jpg", "https://example.com/video.mp4"]
    items = text_items(df).orderBy("ord").collect()
    assert [(r.media_type, r.hint) for r in items] == [("image", "primary"), ("video", "unknown")]


def test_html_items(spark):
    html = '<a href="/l"><img src="a.png" width="50%" alt="x"></a><img src="b.png"><svg viewBox="0 0 3 4"><path/></svg><video poster="p.jpg"></video><p data-src="/z.pdf" class="m">'
    df = spark.createDataFrame([(1, html, "https://e.com/d/"), (2, None, None), (3, "", "https://e.com")], "page_id int, html string, base string")
    items = {r.url[:30]: r for r in html_items(df, base_url="base", selectors=("p.m",)).collect()}
    assert items["https://e.com/d/a.png"].hint == "primary" and items["https://e.com/d/a.png"].width == 50.0 and items["https://e.com/d/a.png"].link_url == "https://e.com/l"
    assert items["https://e.com/d/b.png"].hint == "unknown" and items["https://e.com/d/p.jpg"].confidence == 0.9 and items["https://e.com/z.pdf"].media_type == "document"
    svg = items["data:image/svg+xml,%3Csvg%20vi"]
    assert (svg.width, svg.height, svg.format) == (3.0, 4.0, "svg")
    ignored = html_items(df, base_url="base", ignored=("img",)).collect()
    assert all(".png" not in r.url for r in ignored)


def test_pipeline(spark):
    df = spark.createDataFrame([(0, "https://e.com/a.jpg"), (1, "https://E.com/a.jpg"), (2, "x"), (3, "https://e.com/?q=<script>")], "ord long, url string")
    result = Extractor().from_urls(df)
    assert [r.url for r in result.items.collect()] == ["https://e.com/a.jpg"]
    single = Extractor().from_url(df).stats.first()
    assert single.invalid_urls == 1
    strict = Extractor.filtered("standard").from_url(df).items
    assert strict.count() == 0  # no dimensions
    both = Extractor(max_items=1).from_all([result, Extractor().from_url(df)])
    assert both.items.count() == 1 and Extractor().from_urls(df.filter("ord > 9")).items.count() == 0


def test_streaming(spark, tmp_path):
    from mediaprism.streaming.media import counts_by_type, first_seen

    spark.createDataFrame([("2024-01-01 00:00:01", "https://e.com/a.jpg"), ("2024-01-01 00:00:02", "https://E.com/a.jpg"), ("2024-01-01 00:07:00", "https://e.com/v.mp4")], "t string, url string").selectExpr("CAST(t AS TIMESTAMP) ts", "url").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, url string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("firsts", first_seen(stream()), "append"), ("kinds", counts_by_type(stream()), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("firsts").count() == 2
    assert {(r.media_type, r.n) for r in spark.table("kinds").collect()} == {("image", 2), ("video", 1)}


def test_dom_walk(spark):
    html = '<div style="display:none"><img src="h.png"></div><img src="a.png" class="thumbnail" style="opacity:0"><video src="v"><source src="w.webm"></video><img src="b.png" width="0" height="9"><img src="c.png" role="icon"><p data-url="https://e.com/z.pdf">'
    df = spark.createDataFrame([(1, html, "https://e.com/")], "page_id int, html string, base string")
    items = [(r.url, r.media_type, r.hint, r.source) for r in html_items(df, base_url="base", mode="dom", selectors=("p",)).orderBy("ord").collect()]
    assert items == [
        ("https://e.com/h.png", "image", "unknown", "dom-element"), ("https://e.com/v", "image", "unknown", "dom-element"), ("https://e.com/w.webm", "video", "secondary", "dom-element"),
        ("https://e.com/b.png", "image", "unknown", "dom-element"), ("https://e.com/c.png", "image", "ui-element", "dom-element"), ("https://e.com/z.pdf", "document", "unknown", "dom-element"),
    ]


def test_dispatch_and_files(spark, tmp_path):
    from mediaprism.plans.pipeline import binary_files, quick_scan, with_verdicts

    df = spark.createDataFrame([(0, "https://e.com/a.jpg"), (1, '<img src="https://e.com/b.png"><img src="https://e.com/c.png">'), (2, None)], "ord long, source string")
    out = Extractor().extract(df)
    assert sorted(r.url for r in out.items.collect()) == ["https://e.com/a.jpg", "https://e.com/b.png", "https://e.com/c.png"] and out.stats.first().items_extracted == 3
    urls = spark.createDataFrame([("https://e.com/a.jpg",), ("https://e.com/?x=<script>",)], "url string")
    assert [(r.is_blocked, r.is_safe) for r in with_verdicts(urls).collect()] == [(False, True), (True, False)] and quick_scan(urls).columns == ["url", "security"]
    (tmp_path / "x.bin").write_bytes(b"\x89PNG\r\n\x1a\n____")
    (tmp_path / "y.mp3").write_bytes(b"short")
    found = {r.filename: r.media_type for r in Extractor().from_files(binary_files(spark, str(tmp_path))).items.collect()}
    assert found == {"x.bin": "image", "y.mp3": "audio"}


def test_payload_flags(spark):
    from mediaprism.sources.texts import has_media, is_valid_media_url

    df = spark.createDataFrame([([("a", "image/png", 1)], {}), ([], {"text/plain": "x"}), (None, {"text/html": "x"}), (None, None)], "files array<struct<name:string,type:string,size:bigint>>, data map<string,string>")
    assert [r[0] for r in df.select(has_media(F.col("files"), F.col("data"))).collect()] == [True, False, True, False]
    urls = spark.createDataFrame([("https://example.com/page.html",), ("https://example.com/a.mp4",), ("x.mp4",), (None,)], "url string")
    assert [r.is_media for r in is_valid_media_url(urls).collect()] == [False, True, False, False]
    assert [r.is_media for r in is_valid_media_url(urls, media_types=("image",)).collect()] == [False] * 4
