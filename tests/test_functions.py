import pytest
from pyspark.sql import functions as F

from mediaprism.functions import detect as D
from mediaprism.functions import filenames as N
from mediaprism.functions import mime as M
from mediaprism.functions import urls as U
from mediaprism.functions import whatwg
from mediaprism.functions.urls import Url, with_url

URL = Url("url")


def values(spark, inputs, expression, parsed=True):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, url string")
    df = with_url(df, "url") if parsed else df
    return [r[0] for r in df.select("i", expression.alias("x")).orderBy("i").select("x").collect()]


def test_normalize(spark):
    cases = {
        "HTTPS://EXAMPLE.COM/Path": "https://example.com/Path",
        "https://example.com/path/": "https://example.com/path",
        "https://example.com/": "https://example.com/",
        "https://example.com:443/path": "https://example.com/path",
        "http://example.com:443/path": "http://example.com:443/path",
        "https://example.com:8443/path": "https://example.com:8443/path",
        "https://example.com?z=3&a=1&m=2": "https://example.com/?a=1&m=2&z=3",
        "https://example.com/?b=2&a=1&b=1": "https://example.com/?a=1&b=2&b=1",
        "https://example.com/?A=1&a=2&B=3": "https://example.com/?a=2&A=1&B=3",
        "https://user:pw@Example.com/a/../b/": "https://user:pw@example.com/b",
        "https://example.com/ü?q=a b#x": "https://example.com/%C3%BC?q=a+b#x",
        "not-a-url": "not-a-url",
        "data:image/png;base64,abc": "data:image/png;base64,abc",
    }
    assert values(spark, cases, U.normalize(URL)) == list(cases.values())


def test_normalize_is_idempotent(spark):
    urls = ["HTTPS://Ex.com:443/a/./b/?c=%20&b=ü&a", "http://0x7f.1/x/", "https://ex.com/%7e?x=1+2", "http://[::1]:80/a/"]
    once = values(spark, urls, U.normalize(URL))
    assert values(spark, once, U.normalize(URL)) == once


def test_parts(spark):
    urls = ["https://example.com:8080/path", "not-a-url", "https://sub.example.co.uk/path?x=1&&y=%20+", "http://192.168.1.1/", None, ""]
    assert values(spark, urls, U.domain(URL)) == ["example.com", "", "sub.example.co.uk", "192.168.1.1", "", ""]
    assert values(spark, urls, U.tld(URL)) == ["com", "", "co.uk", "1", "", ""]
    assert values(spark, urls, U.registered_domain(URL)) == ["example.com", "", "example.co.uk", "1.1", "", ""]
    assert values(spark, urls, U.count_query_params(URL)) == [0, 0, 2, 0, 0, 0]
    assert values(spark, urls, U.query_params(URL))[2] == {"x": "1", "y": "  "}
    assert values(spark, urls, U.dedupe_key(URL))[:2] == ["example.com/path", "not-a-url"]


def test_native_and_slow_parsing_agree(spark):
    urls = [
        f"{s}://{h}{p}{path}{q}{f}"
        for s in ("http", "HTTPS") for h in ("a.com", "Ex-1.co.uk", "10.0.0.1") for p in ("", ":80", ":443", ":99") for path in ("", "/", "/a%20b/c.JPG", "/a;b=@:c/") for q in ("", "?", "?a=1&b=%2F", "?x") for f in ("", "#", "#a/b?c")
    ]
    df = with_url(spark.createDataFrame([(u,) for u in urls], "url string"), "url", exact=False)
    rows = df.select("url", "url_parts").collect()
    assert sum(r.url_parts is not None for r in rows) > len(rows) * 0.7
    for r in rows:
        if r.url_parts is not None:
            assert r.url_parts.asDict() == {k: v for k, v in whatwg.parse(r.url).items() if k != "opaque"}, r.url


@pytest.mark.parametrize(
    ("url", "base", "href"),
    [
        ("../b?x#y", "http://h.com/a/c/d", "http://h.com/a/b?x#y"), ("//o.com/x", "https://h.com/", "https://o.com/x"), ("?q", "http://h.com/a?z", "http://h.com/a?q"), ("#f", "http://h.com/a?z", "http://h.com/a?z#f"),
        ("/abs/./x", "http://h.com/a/b", "http://h.com/abs/x"), ("mailto:a@b.c", None, "mailto:a@b.c"), ("http://EX.com\\a", None, "http://ex.com/a"), ("http://1.2.3", None, "http://1.2.0.3/"), ("http://256.1.1.1/", None, None),
        ("http://a b/", None, None), ("http://h:99999/", None, None), ("https:", None, None), (" http://h.com/\t", None, "http://h.com/"), ("file:///a/../b", None, "file:///b"),
    ],
)
def test_whatwg(url, base, href):
    found = whatwg.parse(url, base)
    assert (found and found["href"]) == href


def test_addresses_and_encoding(spark):
    hosts = ["10.0.0.1", "172.16.0.1", "192.168.1.1", "127.0.0.1", "8.8.8.8", "1.2.3", "1a.2.3.4", "256.1.1.1", None]
    assert values(spark, hosts, U.is_private_ip(F.col("url")), False) == [True] * 4 + [False] * 5
    assert values(spark, hosts, U.is_ipv4(F.col("url")), False) == [True] * 5 + [False, True, False, False]
    texts = ["%E0%A4%A", "%%invalid", "a+b%20c", "%E0%A4", "%EF%BF%BD", "plain", None]
    assert values(spark, texts, U.decode_component(F.col("url")), False) == ["%E0%A4%A", "%%invalid", "a+b c", "%E0%A4", "�", "plain", None]
    assert values(spark, ["%2F%C3%BC%3f", "%zz", "%C3%2F"], U.decode_uri(F.col("url")), False) == ["%2Fü%3f", "%zz", "%C3%2F"]
    assert values(spark, ["%41%42", "abc%20abcdefgh", ""], U.is_excessively_encoded(F.col("url")), False) == [True, False, False]


def test_embedded(spark):
    inner = "https://redirect.com/?url=https%3A%2F%2Fexample.com%2Fimage.jpg"
    from urllib.parse import quote

    urls = [inner, f"https://w.com/?target={quote(inner, safe='')}", "https://w.com/?url=no&src=https%253A%252F%252Fe.com", "https://w.com/?x=https://e.com"]
    assert values(spark, urls, U.embedded_url(URL)) == ["https://example.com/image.jpg", inner, "https://e.com", None]
    df = with_url(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"), "url")
    assert [r.redirects for r in U.with_redirects(df, URL).orderBy("i").collect()] == [1, 2, 1, 0]


def test_file_urls_without_a_host():
    parts = lambda u: (whatwg.parse(u)["host"], whatwg.parse(u)["path"], whatwg.parse(u)["href"])
    assert parts("file:10/0/a b.JPG") == ("", "/10/0/a%20b.JPG", "file:///10/0/a%20b.JPG") and parts("file:/x/../y") == ("", "/y", "file:///y")
    assert parts("file:///x") == ("", "/x", "file:///x") and parts("file://h/x") == ("h", "/x", "file://h/x")


def test_filenames(spark):
    urls = ["https://example.com/my%20photo.jpg", "https://example.com/img?format=webp", "https://example.com/file.toolongextension", "https://example.com/", "https://e.com/a.tar.GZ", "data:image/svg+xml,x", "https://e.com/.hidden"]
    assert values(spark, urls, N.filename(URL)) == ["my photo", "img", "file", "file", "a.tar", "file", "hidden"]
    assert values(spark, urls, N.extension(URL)) == ["jpg", "webp", "", "", "gz", "svg", ""]
    names = ["../../../etc/passwd", "CON", "PRN.txt", "  a  ", "", None, "a__--b", "x" * 300]
    assert values(spark, names, N.sanitize_filename(F.col("url")), False) == ["_.._.._etc_passwd", "_CON", "_PRN.txt", "a", "file", "file", "a_b", "x" * 200]


def test_unique_names(spark):
    rows = [(1, "a", "jpg"), (2, "A", "JPG"), (3, "a_1", "jpg"), (4, "a", "jpg"), (5, "b", None)]
    out = N.make_unique(spark.createDataFrame(rows, "ord int, name string, ext string"), "name", "ext").orderBy("ord").collect()
    names = [r.unique_name for r in out]
    assert len({n.lower() for n in names}) == 5 and names[0] == "a.jpg" and names[4] == "b"


def test_unique_names_of_one_base(spark):
    """20,000 equal names, beside others that have numbers already."""
    rows = [(i, "file", "x") for i in range(20_000)] + [(20_001, "file_1", "x"), (20_002, "FILE_1", "X"), (20_003, "file_7.x", ""), (20_004, "other", "x"), (20_005, "other_9", "x"), (20_006, "other", "x"), (20_007, "file_007", "x")]
    out = N.make_unique(spark.createDataFrame(rows, "ord int, name string, ext string").repartition(7), "name", "ext").orderBy("ord").collect()
    names = [r.unique_name for r in out]
    assert len({n.lower() for n in names}) == len(rows) == len(names)
    assert names[0] == "file.x" and names[1:20_000] == [f"file_{7 + i}.x" for i in range(1, 20_000)]
    assert names[20_000:] == ["file_1.x", "FILE_1_1.x", "file_7.x", "other.x", "other_9.x", "other_1.x", "file_007.x"]
    same = N.make_unique(spark.createDataFrame([(1, "a", "b")] * 50 + [(None, "a", "b")], "ord int, name string, ext string"), "name", "ext")
    assert len({r.unique_name for r in same.collect()}) == 51 and N.make_unique(same.drop("unique_name").filter("ord > 5"), "name", "ext").count() == 0


def test_mime(spark):
    assert values(spark, ["application/pdf", "text/plain", " IMAGE/x ", "application/msword", None], M.media_type_of_mime(F.col("url")), False) == ["document", "unknown", "image", "document", "unknown"]
    assert M.supported_extensions("audio")[-1] == "opus" and len(M.supported_extensions("image")) == 15 and M.supported_extensions("x") == []


def test_detection(spark):
    urls = [
        "https://www.youtube.com/watch?v=1", "https://youtu.be/abc", "https://x.com/photos/1?w=1&h=2", "https://x.com/a/podcast/b.m4a", "https://docs.google.com/document/d/1", "https://x.com/stream/1", "blob:https://x/1", "data:audio/mpeg;base64,x",
        "https://a.cloudfront.net/x/y.m3u8?z", "https://x.com/downloads/report", "https://x.com/page.html", "https://open.spotify.com/track/1", "/relative/a.jpg",
    ]
    df = D.with_detection(with_url(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"), "url"), URL)
    found = [(r.detection.type, r.detection.confidence) for r in df.orderBy("i").collect()]
    assert found == [
        ("video", 0.9), ("video", 0.9), ("image", 0.9), ("audio", 1.0), ("document", 0.9), ("audio", 0.7), ("image", 0.5), ("audio", 1.0), ("video", 0.95), ("document", 0.85), ("unknown", 1.0), ("audio", 0.9), ("unknown", 1.0)
    ]
