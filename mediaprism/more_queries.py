"""More registered queries: extraction from payloads, files and mixed sources, steps of the builder, edits of lists and
scanners, members of groups, and streams.  Importing this module registers them beside those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import api
from .functions import detect as D
from .functions import filenames as N
from .functions import mime as M
from .functions import urls as U
from .functions.urls import Url, with_url
from .operators import blocklists, dedupe, filters, security
from .plans.pipeline import Extractor
from .queries import _FILES_SQL, _KEY, _SMART_KEY, CONFIDENCE_SQL, REGISTERED_SQL, TYPE_SQL, URL, WITH_MEDIA, media, query, table
from .sources import texts as X
from .streaming.media import counts_by_type, first_seen

_SIZES = "CASE WHEN width IS NULL THEN 'unknown' WHEN coalesce(width * height, 0) < 1024 THEN 'tiny' WHEN width * height < 60000 THEN 'small' WHEN width * height < 921600 THEN 'medium' ELSE 'large' END"


def _typed(spark, sf_dir):
    """Media rows with type and status, as the filters take them."""
    m = D.with_detection(media(spark, sf_dir), URL)
    return m.withColumns({"media_type": F.col("detection.type"), "status": F.when(F.col("k") == 12, "quarantined").when(F.col("k") == 5, "unchecked").otherwise("safe")}).drop("detection")


# ---- sources -------------------------------------------------------------------------------------------------------


def _payloads(spark, sf_dir):
    data = """map('text/html', '<img src="https://e.com/h.png">', 'text/uri-list', concat('# list\\r\\nhttps://e.com/v.mp4\\nhttps://w.com/o?url=', 'https%3A%2F%2Fe.com%2Fd.pdf'), 'text/plain', 'hear https://e.com/s.mp3!! and https://e.com/h.png')"""
    files = "array(named_struct('name', 'a.b.JPG', 'type', 'image/jpeg', 'size', 10L), named_struct('name', 'x.bin', 'type', 'application/x', 'size', 1L))"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS payload_id", f"{files} AS files", f"{data} AS data")


@query("""SELECT p_partkey AS payload_id, i AS ord, source, media_type, status, file_size FROM part, (VALUES (1, 'drop', 'image', 'safe', 10), (2, 'html-element', 'image', 'safe', NULL), (3, 'uri-list', 'video', 'safe', NULL),
  (4, 'uri-list', 'image', 'safe', NULL), (5, 'embedded', 'document', 'safe', NULL), (6, 'text-url', 'audio', 'safe', NULL)) AS t(i, source, media_type, status, file_size)""")
def dropped_media(spark, sf_dir):
    """Drop payloads through the whole pipeline: files, HTML, URI list and text, scanned."""
    return Extractor().from_payloads(_payloads(spark, sf_dir)).items.select("payload_id", "ord", "source", "media_type", "status", "file_size")


@query("SELECT source, count(*) * n AS n FROM part, (VALUES ('paste', 1), ('html-element', 1), ('uri-list', 2), ('embedded', 1), ('text-url', 1)) AS t(source, n) GROUP BY source, t.n")
def pasted_media(spark, sf_dir):
    return api.extract_from_payloads(_payloads(spark, sf_dir), source="paste").items.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_LISTING = ["p_partkey AS ord", f"{_FILES_SQL} AS name", "CASE p_partkey % 4 WHEN 2 THEN 'audio/ogg' ELSE '' END AS type", "CAST(p_size % 3 AS BIGINT) AS size"]


@query(f"""SELECT p_partkey AS ord, {_FILES_SQL} AS filename, CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'document' END AS media_type,
  CASE p_partkey % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'audio/ogg' ELSE 'application/pdf' END AS mime_type, nullif(CAST(p_size % 3 AS BIGINT), 0) AS file_size, 'safe' AS status FROM part""")
def listed_files(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr(*_LISTING)
    return api.extract_from_files(files).items.select("ord", "filename", "media_type", "mime_type", "file_size", "status")


_DISPATCH_SQL = """SELECT p_partkey AS row, place, media_type, source FROM (SELECT p_partkey, p_partkey % 4 AS k FROM part) JOIN (VALUES (0, 0, 'image', 'text-url'), (1, 0, 'image', 'html-element'), (1, 1, 'video', 'html-element'),
  (2, 1, 'file', 'drop'), (2, 2, 'video', 'uri-list'), (3, 0, 'image', 'file'), (3, 1, 'document', 'file')) AS t(j, place, media_type, source) ON k = j"""


@query(_DISPATCH_SQL.replace("'file', 'drop'", "'image', 'drop'"))
def dispatched_media(spark, sf_dir):
    """A table of mixed sources: URLs, HTML, payloads and file lists, each read as what it is."""
    source = "CASE p_partkey % 4 WHEN 0 THEN concat('https://e.com/a', p_partkey, '.jpg') WHEN 1 THEN concat('<img src=\"https://e.com/b', p_partkey, '.png\"><video src=\"https://e.com/c.mp4\"></video>') END AS source"
    files = "CASE WHEN p_partkey % 4 IN (2, 3) THEN array(named_struct('name', 'p.png', 'type', 'image/png', 'size', 5L), named_struct('name', IF(p_partkey % 4 = 2, 'x.bin', 'q.pdf'), 'type', 'application/x', 'size', 6L)) END AS files"
    data = "CASE WHEN p_partkey % 4 = 2 THEN map('text/uri-list', concat('https://e.com/v', p_partkey, '.mp4')) END AS data"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", source, files, data)
    items = Extractor().extract(rows).items
    return items.select("ord.row", F.col("ord.place").cast("int").alias("place"), "media_type", "source")


_SINGLE = f"SELECT ord, k, CASE WHEN {CONFIDENCE_SQL} < 0.5 THEN 'unknown' ELSE {TYPE_SQL} END AS media_type, CASE WHEN k = 10 THEN 'quarantined' ELSE 'safe' END AS status FROM m WHERE k NOT IN (9, 19) AND k NOT IN (11, 15, 16)"


def _both(spark, sf_dir):
    m = media(spark, sf_dir, parsed=False)
    return Extractor().from_all([Extractor().from_url(m.filter("k IN (0, 1, 4)")), Extractor().from_url(m)])


@query(WITH_MEDIA + f", s AS ({_SINGLE}) SELECT ord, CASE WHEN k IN (0, 1, 4) THEN 0 ELSE 1 END AS source FROM s")
def combined_media(spark, sf_dir):
    """Two results put together: an item of both comes from the first."""
    return _both(spark, sf_dir).items.select(F.col("ord.place").alias("ord"), F.col("ord.source").alias("source"))


@query(WITH_MEDIA + f""", s AS ({_SINGLE}), a AS (SELECT count(*) FILTER (k NOT IN (9, 19)) AS n, count(*) FILTER (k IN (0, 1, 4)) AS twice, count(*) FILTER (k IN (11, 15, 16)) AS b, count(*) FILTER (k = 10) AS q FROM m)
  SELECT n + twice AS urls_processed, b AS blocked_urls, q AS quarantined_urls, 0 AS invalid_urls, (SELECT count(*) FROM s) AS items_extracted, 0 AS items_filtered FROM a""")
def combined_stats(spark, sf_dir):
    return _both(spark, sf_dir).stats


@query(WITH_MEDIA + """ SELECT ord AS text_id, CASE WHEN i = 0 THEN url ELSE 'http://example.org/b.mp4' END AS url, CASE WHEN i = 0 AND k = 6 THEN 'audio' WHEN i = 0 AND k <> 4 THEN 'image' ELSE 'video' END AS media_type,
  CASE WHEN i = 0 OR k = 9 THEN 'primary' ELSE 'unknown' END AS hint FROM m, (SELECT unnest([0, 1]) AS i) WHERE k IN (0, 4, 6, 9) AND NOT (i = 0 AND k = 9)""")
def text_media(spark, sf_dir):
    """Media in free text, first seen within each text."""
    text = F.concat(F.lit("See "), "url", F.lit(", and (http://example.org/b.mp4).! Again http://EXAMPLE.org/b.mp4"))
    rows = media(spark, sf_dir, parsed=False).filter("k IN (0, 4, 6, 9)").select(F.col("ord").alias("text_id"), text.alias("text"))
    return X.text_items(rows).select("text_id", "url", "media_type", "hint")


@query(WITH_MEDIA + " SELECT ord, k NOT IN (9, 19) AS is_media, k IN (4, 5, 18) AS is_video FROM m")
def media_urls_checked(spark, sf_dir):
    m = X.is_valid_media_url(media(spark, sf_dir, parsed=False)).select("ord", "url", "is_media")
    return X.is_valid_media_url(m, media_types=("video",), out="is_video").select("ord", "is_media", "is_video")


# ---- configured extractors and short cuts --------------------------------------------------------------------------


@query(WITH_MEDIA + f", s AS ({_SINGLE}) SELECT ord, media_type FROM s WHERE media_type IN ('video', 'unknown')")
def configured_media(spark, sf_dir):
    """An extractor changed to take videos only; items of unknown type stay."""
    return Extractor().configure(media_types=("video",)).from_url(media(spark, sf_dir, parsed=False)).items.select("ord", "media_type")


@query(WITH_MEDIA + " SELECT ord, CASE WHEN k = 12 THEN 'quarantined' ELSE 'safe' END AS status, CASE WHEN k = 12 THEN 25 ELSE 0 END AS risk_score FROM m WHERE k NOT IN (9, 10, 11, 15, 16, 19)")
def secure_media(spark, sf_dir):
    """The strict preset blocks every threat but the mildest."""
    return Extractor.secure("paranoid").from_url(media(spark, sf_dir, parsed=False)).items.select("ord", "status", "risk_score")


@query(WITH_MEDIA + f""", i AS (SELECT ord, k, 1 AS sub FROM m WHERE k NOT IN (9, 19) UNION ALL SELECT ord, 0, 0 FROM m WHERE k = 13), f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY CASE WHEN k = 11 THEN 'a' || (ord % 250) ELSE ord || '-' || sub END ORDER BY ord, sub) = 1)
  SELECT ord, count(*) AS n FROM f WHERE k NOT IN (11, 15, 16) GROUP BY ord""")
def quick_urls(spark, sf_dir):
    return api.extract_from_urls(media(spark, sf_dir, parsed=False)).items.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))


_ROWS = "concat('<p><a href=\"https://e.com/d', CAST(p_partkey AS STRING), '.pdf\">d</a><img src=\"/i', CAST(p_partkey AS STRING), '.png\"></p><video src=\"v.mp4\"></video>')"


@query("SELECT p_partkey AS page_id, media_type, hint, url || CASE WHEN own THEN p_partkey || ext ELSE ext END AS url FROM part, (VALUES ('image', 'primary', 'https://x.org/i', true, '.png'), ('video', 'primary', 'https://x.org/a/v', false, '.mp4'), ('document', 'unknown', 'https://e.com/d', true, '.pdf')) AS t(media_type, hint, url, own, ext)")
def quick_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_ROWS} AS html", "'https://x.org/a/' AS base")
    return api.extract_from_html(rows, base_url="base").items.select("page_id", "media_type", "hint", "url")


@query("SELECT p_partkey AS page_id, media_type, i AS pos, url || CASE WHEN own THEN p_partkey || ext ELSE ext END AS url FROM part, (VALUES (1, 'image', 'https://x.org/i', true, '.png'), (2, 'video', 'https://x.org/a/v', false, '.mp4')) AS t(i, media_type, url, own, ext)")
def quick_elements(spark, sf_dir):
    """In document order; links are no elements of the walk."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_ROWS} AS html", "'https://x.org/a/' AS base")
    items = api.extract_from_elements(rows, base_url="base").items
    return items.select("page_id", "media_type", F.when(F.col("media_type") == "image", 1).otherwise(2).alias("pos"), "url")


# ---- single functions ----------------------------------------------------------------------------------------------


@query(WITH_MEDIA + f""" SELECT ord, k = 11 AS ipv4, {TYPE_SQL} <> 'unknown' AND {CONFIDENCE_SQL} >= 0.5 AS supported, k IN (0, 1, 2, 3, 13) AND (CASE WHEN k IN (1, 2) THEN CAST(floor(ord / 20.0) AS BIGINT) ELSE ord END)::VARCHAR LIKE '1%' AS globbed,
  k IN (0, 1, 2, 3, 4, 6, 7, 10, 11, 14, 17, 18) AS named, CASE k WHEN 4 THEN 'mp4' WHEN 6 THEN 'mp3' WHEN 7 THEN 'pdf' ELSE '' END AS extension FROM m""")
def value_checks(spark, sf_dir):
    """Addresses, supported types, wildcard patterns, and name and extension at once."""
    m = D.with_detection(media(spark, sf_dir), URL).withColumn("f", N.filename_and_extension(URL))
    ext = F.col("f.extension")
    glob = filters.matches_pattern(URL.raw, "*cdn.example.com*photos*p1*")
    return m.select("ord", U.is_ipv4(U.domain(URL)).alias("ipv4"), D.is_supported(F.col("detection")).alias("supported"), glob.alias("globbed"), ((ext != "") & (F.col("f.filename") != "file") & (ext != "html")).alias("named"), F.when(ext.isin("mp4", "mp3", "pdf"), ext).otherwise("").alias("extension"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'document' ELSE 'unknown' END AS media_type, p_partkey % 5 < 3 AS supported FROM part""")
def data_url_types(spark, sf_dir):
    url = F.expr("element_at(array('data:image/png;base64,x', 'data:VIDEO/mp4,x', 'data:application/pdf;x', 'data:font/woff,x', 'data:,x'), cast(1 + p_partkey % 5 as int))")
    part = table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))
    return part.select("p_partkey", M.media_type_of_data_url(F.col("url")).alias("media_type"), F.coalesce(M.is_supported_mime(M.mime_of_data_url(F.col("url"))), F.lit(False)).alias("supported"))


@query(WITH_MEDIA + " SELECT ord, CASE WHEN k IN (4, 5, 18) THEN 'video' WHEN k = 6 THEN 'audio' ELSE 'document' END AS kind FROM m WHERE k IN (4, 5, 6, 7, 18)")
def rows_by_type(spark, sf_dir):
    m = media(spark, sf_dir)
    one = lambda kind: D.filter_by_type(m, URL, kind).select("ord", F.lit(kind).alias("kind"))
    return one("video").unionByName(one("audio")).unionByName(one("document"))


@query(WITH_MEDIA + " SELECT ord FROM m WHERE width >= 300 AND height >= 200 AND width <= 1500 AND width / height <= 1.2")
def combined_dimensions(spark, sf_dir):
    """Bounds of several filters at once: the largest minima, the smallest maxima."""
    rule = filters.combine_dimensions(filters.preset_dimensions("no_tiny"), filters.preset_dimensions("medium_plus"), filters.DimensionFilter(max_width=1500, max_aspect_ratio=2.0), filters.DimensionFilter(max_width=1800, max_aspect_ratio=1.2))
    return media(spark, sf_dir, parsed=False).filter(filters.check_dimensions(F.col("width"), F.col("height"), rule)).select("ord")


# ---- presets and the builder ---------------------------------------------------------------------------------------

_POINTS = "CASE WHEN file_size > 0 THEN 5 ELSE 0 END + CASE WHEN k = 12 THEN 5 WHEN k = 5 THEN 0 ELSE 20 END"
_PIXELS = "CASE WHEN width * height IS NOT NULL THEN 10 + least(20, floor(width * height / 100000)) ELSE 0 END"
_BEST = "QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {points} DESC, ord) = 1"


def _preset_sql(name: str, condition: str, key: str = _KEY, points: str = _POINTS) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS step, ord FROM m WHERE {condition} {_BEST.format(key=key, points=points)})"


_PHOTO = "width >= 200 AND height >= 150 AND width / height >= 0.5 AND width / height <= 3.0"


@query(WITH_MEDIA + " " + " UNION ALL ".join([
    _preset_sql("basic", "width >= 32 AND height >= 32 AND k NOT IN (10, 17)"),
    _preset_sql("standard", "width >= 100 AND height >= 100 AND k NOT IN (10, 12, 17)"),
    _preset_sql("photos", f"{_PHOTO} AND k NOT IN (10, 17) AND {TYPE_SQL} = 'image'", _SMART_KEY, f"{_POINTS} + {_PIXELS}"),
    _preset_sql("videos", f"{TYPE_SQL} = 'video'"), _preset_sql("documents", f"{TYPE_SQL} = 'document'"), "SELECT 'none', ord FROM m",
]))
def preset_rows(spark, sf_dir):
    """Filter presets, each over all rows."""
    m = _typed(spark, sf_dir)
    out = None
    for name in ("basic", "standard", "photos", "videos", "documents", "none"):
        rows = filters.apply_preset(m, name).select(F.lit(name).alias("step"), "ord")
        out = rows if out is None else out.unionByName(rows)
    return out


_STEPS = {
    "images_only": (lambda b: b.images_only(), f"{TYPE_SQL} = 'image'"),
    "videos_only": (lambda b: b.videos_only(), f"{TYPE_SQL} = 'video'"),
    "dimension_preset": (lambda b: b.dimension_preset("landscape"), "width / height >= 1.3"),
    "max_size": (lambda b: b.max_size(1000, 800), "width <= 1000 AND height <= 800"),
    "from_domains": (lambda b: b.from_domains("example.com", "youtube.com"), f"{REGISTERED_SQL} IN ('example.com', 'youtube.com')"),
    "not_from_domains": (lambda b: b.not_from_domains("example.com"), f"{REGISTERED_SQL} <> 'example.com'"),
    "include": (lambda b: b.include("*photos*").exclude("*_small*"), "k IN (0, 2, 3, 13)"),
    "security_status": (lambda b: b.security_status("quarantined", "unchecked"), "k IN (5, 12)"),
    "safe_only": (lambda b: b.safe_only(), "k NOT IN (5, 12)"),
    "file_size": (lambda b: b.file_size(5000, 30_000), "file_size IS NULL OR (file_size >= 5000 AND file_size <= 30000)"),
    "filter": (lambda b: b.filter(F.col("ord") % 3 == 0).filter(F.col("k") < 10), "ord % 3 = 0 AND k < 10"),
    "all": (lambda b: b.images_only().min_size(200, 150).safe_only().remove_unwanted(), f"{TYPE_SQL} = 'image' AND width >= 200 AND height >= 150 AND k NOT IN (10, 12, 17)"),
}


@query(WITH_MEDIA + " " + " UNION ALL ".join(f"SELECT '{name}' AS step, ord FROM m WHERE {sql}" for name, (_, sql) in _STEPS.items()) + " UNION ALL " + _preset_sql("smart_dedupe", "true", _SMART_KEY, f"{_POINTS} + {_PIXELS}") + " UNION ALL SELECT 'first', min(ord) FROM m WHERE k = 4")
def builder_steps(spark, sf_dir):
    """Every step of the builder."""
    start = filters.FilterBuilder(_typed(spark, sf_dir))
    made = {name: step(start).execute() for name, (step, _) in _STEPS.items()}
    made |= {"smart_dedupe": start.smart_dedupe().execute(), "first": start.include("*video.example.net*").first()}
    out = None
    for name, rows in made.items():
        rows = rows.select(F.lit(name).alias("step"), "ord")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(WITH_MEDIA + " SELECT count(*) FILTER (k IN (4, 5, 18)) AS n, bool_or(k = 4) AS some, false AS none FROM m")
def builder_answers(spark, sf_dir):
    """What the builder answers at once: a number, and whether there is any row."""
    b = filters.FilterBuilder(_typed(spark, sf_dir)).videos_only()
    return spark.createDataFrame([(b.count(), b.any(), b.include("*nowhere*").any())], "n bigint, some boolean, none boolean")


# ---- groups --------------------------------------------------------------------------------------------------------


@query(WITH_MEDIA + f", d AS (SELECT ord, {_KEY} AS key FROM m) SELECT ord, n FROM (SELECT ord, count(*) OVER (PARTITION BY key) AS n FROM d) WHERE n > 1")
def duplicate_members(spark, sf_dir):
    """The rows behind duplicates_found."""
    return dedupe.duplicate_rows(media(spark, sf_dir)).select("ord", F.col("n_rows").alias("n"))


@query(WITH_MEDIA + f" SELECT ord, coalesce({REGISTERED_SQL}, 'unknown') AS domain, {_SIZES} AS size_group, CASE WHEN {CONFIDENCE_SQL} >= 0.5 THEN {TYPE_SQL} ELSE 'unknown' END AS media_type FROM m")
def group_members(spark, sf_dir):
    """Every row with the group that it has by domain, size and type."""
    m = D.with_detection(media(spark, sf_dir), URL)
    return m.select("ord", filters.domain_group(URL).alias("domain"), filters.size_group(F.col("width"), F.col("height")).alias("size_group"), D.media_type(F.col("detection")).alias("media_type"))


@query(WITH_MEDIA + """ SELECT a.ord AS small, b.ord AS large, coalesce(abs(a.width / a.height - b.width / b.height) / greatest(a.width / a.height, b.width / b.height) <= 0.1, true) AS same FROM m a JOIN m b ON a.ord + 1 = b.ord WHERE a.k = 1
  UNION ALL SELECT a.ord, b.ord, false FROM m a JOIN m b ON a.ord + 2 = b.ord WHERE a.k = 2""")
def size_variant_pairs(spark, sf_dir):
    """Small and large form of one photo, and pairs that are none."""
    m = media(spark, sf_dir, parsed=False).select("ord", "k", "width", "height", dedupe.stripped_url(F.col("url")).alias("s"))
    side = lambda x: m.select(*(F.col(c).alias(f"{c}{x}") for c in m.columns))
    step = F.when(F.col("k1") == 1, 1).when(F.col("k1") == 2, 2)
    pairs = with_url(with_url(side(1).filter("k1 IN (1, 2)").join(side(2), F.col("ord1") + step == F.col("ord2")), "s1"), "s2")
    same = dedupe.is_size_variant(Url("s1"), Url("s2"), F.col("width1"), F.col("height1"), F.col("width2"), F.col("height2"))
    return pairs.select(F.col("ord1").alias("small"), F.col("ord2").alias("large"), same.alias("same"))


# ---- lists and scanners --------------------------------------------------------------------------------------------


@query(WITH_MEDIA + """ SELECT ord, k IN (4, 12) OR (k = 11 AND ord % 250 < 128) AS blocked, k IN (0, 1, 2, 3, 7) AS allowed, 2 AS domains, 1 AS ip_ranges FROM m""")
def edited_blocklist(spark, sf_dir):
    """Names and patterns put on the lists and taken off again."""
    rules = blocklists.Blocklist(domains=("example.org", "bit.ly"), ranges=("192.168.1.0/25",), patterns=("/photos/", "podcast/none"))
    rules = rules.block("video.example.net").unblock("EXAMPLE.ORG").allow("docs.example.org").allow_patterns(r"cdn\.example\.com/photos")
    m = media(spark, sf_dir).withColumn("hit", blocklists.check(URL, rules))
    stats = rules.stats()
    return m.select("ord", "hit.blocked", blocklists.is_allowed(URL, rules).alias("allowed"), F.lit(stats["domains"]).alias("domains"), F.lit(stats["ip_ranges"]).alias("ip_ranges"))


@query(WITH_MEDIA + """ SELECT ord, CASE WHEN k IN (4, 11, 12, 15, 16) THEN 'blocked' ELSE 'safe' END AS status, CASE k WHEN 4 THEN 'blocked-domain' WHEN 10 THEN 'suspicious-tld' WHEN 11 THEN 'private-ip,' || CASE WHEN ord % 250 < 128 THEN 'blocked-domain' ELSE 'blocked-ip' END
  WHEN 12 THEN 'blocked-domain' WHEN 15 THEN 'script-injection' WHEN 16 THEN 'blocked-domain' ELSE '' END AS threats FROM m""")
def scanner_options(spark, sf_dir):
    """A scanner with own lists and one detection switched off."""
    scanner = security.Scanner().block_domains("bit.ly", "video.example.net").block_ips("192.168.1.0/25").block_patterns("password=").with_options(detection={"tracking_pixels": False})
    s = scanner.scan(media(spark, sf_dir), URL)
    return s.select("ord", "security.status", F.array_join(F.transform("security.threats", lambda t: t["type"]), ",").alias("threats"))


_STATUS = "CASE WHEN k IN (11, 15, 16) THEN 'blocked' WHEN k = 10 THEN 'quarantined' ELSE 'safe' END"


@query(WITH_MEDIA + f" SELECT DISTINCT url, {_STATUS} AS status FROM m")
def scanned_distinct(spark, sf_dir):
    return security.Scanner().scan_distinct(media(spark, sf_dir, parsed=False)).select("url", "security.status")


@query(WITH_MEDIA + f" SELECT ord, {_STATUS} AS status FROM m")
def quick_scanned(spark, sf_dir):
    return api.quick_scan(media(spark, sf_dir, parsed=False)).select("ord", "security.status")


@query(WITH_MEDIA + """ SELECT ord, CASE WHEN k = 3 THEN replace(url, 'CDN', 'cdn') WHEN k = 14 THEN replace(url, 'utm_source=feed&', '') WHEN k = 19 THEN 'https://example.com/dup/' ELSE url END AS stripped, CASE WHEN k = 0 THEN NULL ELSE url END AS kept FROM m""")
def scanner_sanitized(spark, sf_dir):
    """Cleaned URLs, with and without tracking parameters; a URL that is a script is none."""
    m = media(spark, sf_dir, parsed=False)
    m = security.Scanner().sanitize_url(m, "url", "stripped").withColumn("raw", F.when(F.col("k") == 0, F.lit("java\nscript:x")).otherwise(F.col("url")))
    return security.Scanner(strip_tracking=False).sanitize_url(m, "raw", "kept").select("ord", "stripped", "kept")


# ---- streams -------------------------------------------------------------------------------------------------------

_EVENT_URL = "CASE event_type WHEN 'view' THEN concat('https://E.com/', CAST(user_id AS STRING), '.jpg') WHEN 'click' THEN concat('https://e.com/', CAST(user_id AS STRING), '.mp4') ELSE 'https://e.com/page' END"


def _drained(spark, sf_dir, make, mode: str):
    """What a stream of ``events`` gives once all that is there has been read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"stream_{uuid.uuid4().hex}"
    made = make(stream.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", f"{_EVENT_URL} AS url"))
    run = made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'video' ELSE 'unknown' END AS media_type, count(*) AS n FROM events GROUP BY ALL""")
def streamed_counts(spark, sf_dir):
    """Media types of a stream of events in windows of five minutes of event time."""
    rows = _drained(spark, sf_dir, counts_by_type, "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "media_type", "n")


@query("SELECT DISTINCT CASE event_type WHEN 'view' THEN 'https://e.com/' || user_id || '.jpg' WHEN 'click' THEN 'https://e.com/' || user_id || '.mp4' ELSE 'https://e.com/page' END AS dedupe_key FROM events")
def streamed_first_seen(spark, sf_dir):
    """Each normal form once: a watermark longer than the stream keeps all state."""
    return _drained(spark, sf_dir, lambda s: first_seen(s, delay="3650 days"), "append").select("dedupe_key")
