"""Registered queries over the driver's tables, and DuckDB SQL for each that SQL can express.

``pages`` gives real-looking URLs and markup.  Media URLs with every kind of evidence come from ``part`` by a fixed text
(``MEDIA_SQL``) that both engines run; many of the oracles state what a row must give by its number alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .api import detect_distinct, with_resolved
from .cluster import ship, spread
from .functions import detect as D
from .functions import filenames as N
from .functions import mime as M
from .functions import urls as U
from .functions.urls import Url, with_url
from .operators import blocklists, dedupe, filters, sanitize, security
from .plans.pipeline import Extractor, with_verdicts
from .sources import html as H
from .sources import texts as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

URL_SQL = """CASE p_partkey % 20
    WHEN 0 THEN concat('https://cdn.example.com/photos/p', CAST(p_partkey AS STRING), '.jpg')
    WHEN 1 THEN concat('https://cdn.example.com/photos/p', CAST(floor(p_partkey / 20.0) AS BIGINT), '_small.jpg')
    WHEN 2 THEN concat('https://cdn.example.com/photos/p', CAST(floor(p_partkey / 20.0) AS BIGINT), '_large.jpg')
    WHEN 3 THEN concat('https://CDN.example.com/photos/p', CAST(p_partkey AS STRING), '.PNG?b=2&a=1')
    WHEN 4 THEN concat('https://video.example.net/v/', CAST(p_partkey AS STRING), '.mp4')
    WHEN 5 THEN concat('https://www.youtube.com/watch?v=id', CAST(p_partkey AS STRING))
    WHEN 6 THEN concat('https://audio.example.org/podcast/ep', CAST(p_partkey AS STRING), '.mp3')
    WHEN 7 THEN concat('https://docs.example.org/files/doc', CAST(p_partkey AS STRING), '.pdf')
    WHEN 8 THEN concat('https://img.example.com/resize?w=100&h=80&id=', CAST(p_partkey AS STRING))
    WHEN 9 THEN concat('https://example.com/page', CAST(p_partkey AS STRING), '.html')
    WHEN 10 THEN concat('https://t', CAST(p_partkey AS STRING), '.example.tk/pixel.gif')
    WHEN 11 THEN concat('http://192.168.1.', CAST(p_partkey % 250 AS STRING), '/cam.jpg')
    WHEN 12 THEN concat('https://bit.ly/x', CAST(p_partkey AS STRING))
    WHEN 13 THEN concat('https://wrap.example.com/out?url=https%3A%2F%2Fcdn.example.com%2Fphotos%2Fp', CAST(p_partkey AS STRING), '.jpg')
    WHEN 14 THEN concat('https://example.com/a.jpg?utm_source=feed&id=', CAST(p_partkey AS STRING))
    WHEN 15 THEN concat('https://example.com/x?q=%3Cscript%3E', CAST(p_partkey AS STRING))
    WHEN 16 THEN concat('https://exfil.example.com/c?password=p', CAST(p_partkey AS STRING), '&token=t')
    WHEN 17 THEN concat('https://ads.example.com/ads/banner', CAST(p_partkey AS STRING), '.gif')
    WHEN 18 THEN concat('https://live.example.com/hls/', CAST(p_partkey AS STRING), '.m3u8')
    ELSE 'https://example.com:443/dup/' END"""
WIDTH_SQL = "CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_size * 41 + p_partkey) % 2000 + 1 END AS DOUBLE)"
HEIGHT_SQL = "CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_size * 29 + p_partkey) % 1500 + 1 END AS DOUBLE)"
SIZE_SQL = "CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 1000 END AS BIGINT)"
MEDIA_SQL = f"SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(p_partkey % 20 AS INT) AS k, {URL_SQL} AS url, {WIDTH_SQL} AS width, {HEIGHT_SQL} AS height, {SIZE_SQL} AS file_size FROM part"
WITH_MEDIA = f"WITH m AS ({MEDIA_SQL})"
URL = Url("url")
#: The host of a media row, by its number.
HOST_SQL = """CASE k WHEN 4 THEN 'video.example.net' WHEN 5 THEN 'www.youtube.com' WHEN 6 THEN 'audio.example.org' WHEN 7 THEN 'docs.example.org' WHEN 8 THEN 'img.example.com'
  WHEN 10 THEN concat('t', CAST(ord AS STRING), '.example.tk') WHEN 11 THEN concat('192.168.1.', CAST(ord % 250 AS STRING)) WHEN 12 THEN 'bit.ly' WHEN 13 THEN 'wrap.example.com'
  WHEN 16 THEN 'exfil.example.com' WHEN 17 THEN 'ads.example.com' WHEN 18 THEN 'live.example.com' WHEN 9 THEN 'example.com' WHEN 14 THEN 'example.com' WHEN 15 THEN 'example.com' WHEN 19 THEN 'example.com'
  ELSE 'cdn.example.com' END"""
REGISTERED_SQL = """CASE k WHEN 4 THEN 'example.net' WHEN 5 THEN 'youtube.com' WHEN 6 THEN 'example.org' WHEN 7 THEN 'example.org' WHEN 10 THEN 'example.tk'
  WHEN 11 THEN concat('1.', CAST(ord % 250 AS STRING)) WHEN 12 THEN 'bit.ly' ELSE 'example.com' END"""
TYPE_SQL = "CASE WHEN k IN (4, 5, 18) THEN 'video' WHEN k = 6 THEN 'audio' WHEN k = 7 THEN 'document' WHEN k IN (9, 19) THEN 'unknown' ELSE 'image' END"
CONFIDENCE_SQL = "CASE WHEN k IN (12, 13, 15, 16) THEN 0.3 WHEN k = 8 THEN 0.6 WHEN k = 5 THEN 0.9 WHEN k = 18 THEN 0.95 ELSE 1.0 END"


def query(sql: str | None = None):
    """Registers a function under its own name, with its oracle."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_url(spread(table(spark, sf_dir, "pages").select("page_id", "url")), "url")


def media(spark: SparkSession, sf_dir: str, parsed: bool = True) -> DataFrame:
    part = spread(table(spark, sf_dir, "part"))
    rows = part.selectExpr("CAST(p_partkey AS BIGINT) AS ord", "CAST(p_partkey % 20 AS INT) AS k", f"{URL_SQL} AS url", f"{WIDTH_SQL} AS width", f"{HEIGHT_SQL} AS height", f"{SIZE_SQL} AS file_size")
    return with_url(rows, "url") if parsed else rows


PAGE_PARTS = r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS hash, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages)"""


# ---- URLs ----------------------------------------------------------------------------------------------------------


@query(r"""SELECT regexp_extract(url, '://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)(?:[/?#]|$)', 1) AS domain,
  CASE WHEN regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '/([^/]*)$', 1) NOT IN ('') AND NOT contains(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '/([^/]*)$', 1), '.') THEN 'image' ELSE 'unknown' END AS media_type,
  count(*) AS n FROM pages GROUP BY ALL""")
def media_by_domain(spark, sf_dir):
    """The flagship: pages by registered domain and detected type."""
    found = D.with_detection(pages(spark, sf_dir), URL).select(U.registered_domain(URL).alias("domain"), F.col("detection.type").alias("media_type"))
    return found.groupBy("domain", "media_type").agg(F.count(F.lit(1)).alias("n"))


@query(PAGE_PARTS + """ SELECT page_id, host AS domain, split_part(host, '.', -1) AS tld, split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS registered_domain, path, query,
  CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS n_params FROM a""")
def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.domain(URL).alias("domain"), U.tld(URL).alias("tld"), U.registered_domain(URL).alias("registered_domain"), U.path(URL).alias("path"), U.query_string(URL).alias("query"), U.count_query_params(URL).alias("n_params"))


@query(PAGE_PARTS + """ SELECT page_id, scheme || '://' || host || CASE WHEN path <> '/' AND path LIKE '%/' THEN path[:-2] ELSE path END
  || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END || hash AS normalized, host || path AS dedupe_key FROM a""")
def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize(URL).alias("normalized"), U.dedupe_key(URL).alias("dedupe_key"))


@query(WITH_MEDIA + f""" SELECT ord, {HOST_SQL} AS domain, {REGISTERED_SQL} AS registered_domain, k <> 11 AS https, k = 11 AS http, true AS absolute, false AS data, false AS script, k = 12 AS shortener, k = 11 AS private,
  CASE WHEN k = 11 THEN 192 * 16777216::BIGINT + 168 * 65536 + 256 + ord % 250 END AS address FROM m""")
def url_predicates(spark, sf_dir):
    m, u = media(spark, sf_dir), URL
    return m.select("ord", U.domain(u).alias("domain"), U.registered_domain(u).alias("registered_domain"), U.is_https(u.raw).alias("https"), U.is_http(u.raw).alias("http"), U.is_absolute(u.raw).alias("absolute"), U.is_data_url(u.raw).alias("data"), U.is_javascript_url(u.raw).alias("script"), U.is_shortener(u).alias("shortener"), U.is_private_url(u).alias("private"), U.ipv4_to_int(U.domain(u)).alias("address"))


@query(WITH_MEDIA + """ SELECT ord, len(regexp_extract_all(url, '%[0-9A-Fa-f]{2}')) AS n_encoded, 3.0 * len(regexp_extract_all(url, '%[0-9A-Fa-f]{2}')) / length(url) > 0.3 AS heavy, url_decode(url) AS decoded, url AS decoded_uri FROM m WHERE k NOT IN (13, 15)
  UNION ALL SELECT ord, len(regexp_extract_all(url, '%[0-9A-Fa-f]{2}')), 3.0 * len(regexp_extract_all(url, '%[0-9A-Fa-f]{2}')) / length(url) > 0.3, url_decode(url), replace(replace(url, '%3C', '<'), '%3E', '>') FROM m WHERE k IN (13, 15)""")
def url_encoding(spark, sf_dir):
    m = media(spark, sf_dir, parsed=False)
    u = F.col("url")
    return m.select("ord", U.count_encoded(u).alias("n_encoded"), U.is_excessively_encoded(u).alias("heavy"), U.decode_component(u).alias("decoded"), U.decode_uri(u).alias("decoded_uri"))


@query(WITH_MEDIA + " SELECT ord, CASE WHEN k = 13 THEN concat('https://cdn.example.com/photos/p', CAST(ord AS STRING), '.jpg') END AS embedded, CAST(k = 13 AS INT) AS redirects FROM m")
def url_embedded(spark, sf_dir):
    return U.with_redirects(media(spark, sf_dir), URL).select("ord", U.embedded_url(URL).alias("embedded"), "redirects")


@query(PAGE_PARTS + r""", p AS (SELECT page_id, unnest(string_split(query, '&')) AS kv FROM a WHERE query <> '') SELECT page_id, split_part(kv, '=', 1) AS name, split_part(kv, '=', 2) AS value FROM p""")
def url_params(spark, sf_dir):
    """Query parameters as rows, from the map of parameters."""
    return pages(spark, sf_dir).select("page_id", F.explode(U.query_params(URL)).alias("name", "value"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '\?utm_source=feed', ''), '&ref=x', '') AS stripped FROM pages""")
def tracking_stripped(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", sanitize.strip_tracking(URL).alias("stripped"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(['a/b.jpg', '/c?x#y', '../d', '//Other.example.com/e', 'https://E.com/F', '#g', '']) AS ref FROM pages), p AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS root,
  regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path, regexp_extract(url, '(\?[^#]*)', 1) AS query FROM l)
  SELECT page_id, ref, CASE ref WHEN 'a/b.jpg' THEN root || regexp_extract(path, '^(.*/)', 1) || ref WHEN '/c?x#y' THEN root || ref WHEN '../d' THEN root || regexp_replace(regexp_extract(path, '^(.*/)', 1), '[^/]+/$', '') || 'd'
    WHEN '//Other.example.com/e' THEN scheme || '://other.example.com/e' WHEN 'https://E.com/F' THEN ref WHEN '#g' THEN root || path || query || ref END AS resolved FROM p""")
def resolved_urls(spark, sf_dir):
    """References of every kind against each page's URL."""
    refs = F.array(*map(F.lit, ("a/b.jpg", "/c?x#y", "../d", "//Other.example.com/e", "https://E.com/F", "#g", "")))
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("ref", F.explode(refs))
    return with_resolved(rows, "ref", "url").select("page_id", "ref", "resolved")


@query(WITH_MEDIA + f" SELECT DISTINCT url, {TYPE_SQL} AS media_type, CAST({CONFIDENCE_SQL} AS DOUBLE) AS confidence FROM m")
def detect_distinct_urls(spark, sf_dir):
    return detect_distinct(media(spark, sf_dir, parsed=False)).select("url", F.col("detection.type").alias("media_type"), F.col("detection.confidence").alias("confidence"))


# ---- file names and MIME types -------------------------------------------------------------------------------------

_STEM = "regexp_extract(split_part(url, '?', 1), '/([^/]*?)(?:[.][^./]*)?$', 1)"
_EXT = "lower(regexp_extract(regexp_extract(split_part(url, '?', 1), '/([^/]*)$', 1), '[.]([A-Za-z0-9]+)$', 1))"


@query(WITH_MEDIA + f" SELECT ord, CASE WHEN k = 19 THEN 'dup' ELSE {_STEM} END AS filename, {_EXT} AS extension, CASE WHEN k = 19 THEN 'dup' ELSE {_STEM} || CASE WHEN {_EXT} = '' THEN '' ELSE '.' || {_EXT} END END AS generated FROM m")
def filename_parts(spark, sf_dir):
    return media(spark, sf_dir).select("ord", N.filename(URL).alias("filename"), N.extension(URL).alias("extension"), N.generate_filename(URL).alias("generated"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '_con.txt' WHEN 1 THEN '_.._' || p_name || '_' WHEN 2 THEN 'a_' || p_name ELSE 'file' END AS base,
  CASE p_partkey % 4 WHEN 0 THEN 'con.txt' WHEN 1 THEN '.._' || p_name WHEN 2 THEN 'a_' || p_name ELSE 'file' END AS strict, p_partkey % 4 <> 0 AS traversal FROM part""")
def filename_sanitized(spark, sf_dir):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'con.txt' WHEN 1 THEN concat('../../', p_name, '?') WHEN 2 THEN concat(' a--__', p_name, '..') ELSE '...' END")
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return part.select("p_partkey", N.sanitize_filename(F.col("name")).alias("base"), sanitize.sanitize_filename(F.col("name")).alias("strict"), N.has_path_traversal(F.col("name")).alias("traversal"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'img8_3' ELSE 'img' || (p_partkey % 50) END AS b FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p_partkey) - 1 AS n, count(*) OVER (PARTITION BY b) AS c FROM n)
  SELECT p_partkey, b || CASE WHEN n = 0 THEN '' ELSE '_' || (n + CASE WHEN b = 'img8' AND c > 3 THEN 3 ELSE 0 END) END || '.jpg' AS unique_name FROM r""")
def filename_unique(spark, sf_dir):
    """Fifty names shared by all rows; one of them is what numbering another would give."""
    name = F.when(F.col("p_partkey") % 50 == 7, "img8_3").otherwise(F.concat(F.lit("img"), F.col("p_partkey") % 50))
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.lit("JPG").alias("ext"))
    return N.make_unique(part, "name", "ext", order="p_partkey").select("p_partkey", "unique_name")


_EXT_LIST = "['jpg', 'JPEG', '.png', 'mp4', 'oga', 'pdf', 'docx', 'txt', 'zzz', '']"


@query(f"""WITH e AS (SELECT p_partkey, {_EXT_LIST}[1 + p_partkey % 10] AS ext FROM part) SELECT p_partkey,
  CASE ext WHEN 'jpg' THEN 'image/jpeg' WHEN 'JPEG' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN 'mp4' THEN 'video/mp4' WHEN 'oga' THEN 'audio/ogg' WHEN 'pdf' THEN 'application/pdf'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'txt' THEN 'text/plain' END AS mime,
  CASE WHEN ext IN ('jpg', 'JPEG', '.png') THEN 'image' WHEN ext = 'mp4' THEN 'video' WHEN ext = 'oga' THEN 'audio' WHEN ext IN ('pdf', 'docx') THEN 'document' ELSE 'unknown' END AS media_type,
  CASE WHEN ext IN ('jpg', 'JPEG') THEN 'jpg' ELSE replace(ext, '.', '') END AS normal, ext IN ('jpg', 'JPEG', '.png') AS image, ext = 'mp4' AS video, false AS audio, ext IN ('pdf', 'docx', 'txt') AS document,
  CASE ext WHEN 'jpg' THEN 'jpg' WHEN 'JPEG' THEN 'jpg' WHEN '.png' THEN 'png' WHEN 'mp4' THEN 'mp4' WHEN 'oga' THEN 'ogg' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'txt' END AS back FROM e""")
def mime_types(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr("element_at(array('jpg', 'JPEG', '.png', 'mp4', 'oga', 'pdf', 'docx', 'txt', 'zzz', ''), cast(1 + p_partkey % 10 as int))").alias("ext"))
    e = F.col("ext")
    return part.select("p_partkey", M.mime_of_extension(e).alias("mime"), M.media_type_of_extension(e).alias("media_type"), N.normalize_extension(e).alias("normal"), N.is_image_extension(e).alias("image"), N.is_video_extension(e).alias("video"), N.is_audio_extension(e).alias("audio"), N.is_document_extension(e).alias("document"), M.extension_of_mime(M.mime_of_extension(e)).alias("back"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'audio/mpeg' END AS mime,
  CASE p_partkey % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 4 THEN 'document' WHEN 5 THEN 'audio' ELSE 'unknown' END AS media_type FROM part""")
def mime_bytes(spark, sf_dir):
    """Types of files by their first bytes: JPEG, PNG, WEBP, another RIFF, PDF, MP3, and a file that is too short."""
    data = F.expr("unhex(element_at(array('FFD8FFE000104A46', '89504E470D0A1A0A0000', '524946460000000057454250', '524946460000000057415645', '255044462D312E37', '4944330400000000', 'FFD8FF'), cast(1 + p_partkey % 7 as int)))")
    part = table(spark, sf_dir, "part").select("p_partkey", data.alias("data"))
    return part.select("p_partkey", M.mime_of_bytes(F.col("data")).alias("mime"), M.media_type_of_bytes(F.col("data")).alias("media_type"))


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 2) AS safe, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' WHEN 2 THEN 'video/mp4' END AS mime_type, CASE p_partkey % 4 WHEN 1 THEN 'utf-8' END AS charset FROM part""")
def content_types(spark, sf_dir):
    text = F.expr("element_at(array('Image/PNG', 'text/html; charset=latin1; charset=\"utf-8\"', 'video/mp4;codecs=x', ''), cast(1 + p_partkey % 4 as int))")
    part = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return part.select("p_partkey", M.content_type(F.col("text")).alias("c")).select("p_partkey", "c.*")


# ---- detection -----------------------------------------------------------------------------------------------------


@query(WITH_MEDIA + f" SELECT ord, {TYPE_SQL} AS media_type, CAST({CONFIDENCE_SQL} AS DOUBLE) AS confidence, CASE WHEN {CONFIDENCE_SQL} >= 0.5 THEN {TYPE_SQL} ELSE 'unknown' END AS threshold_type FROM m")
def detect_types(spark, sf_dir):
    m = D.with_detection(media(spark, sf_dir), URL)
    return m.select("ord", F.col("detection.type").alias("media_type"), F.col("detection.confidence").alias("confidence"), D.media_type(F.col("detection")).alias("threshold_type"))


@query(WITH_MEDIA + """ SELECT ord, k IN (0, 1, 2, 3, 10, 11, 14, 17) AS image_ext, k IN (0, 1, 2, 3) AS image_pattern, k = 8 AS image_params, k = 4 AS video_ext, k = 18 AS manifest, k = 5 AS video_platform,
  k = 6 AS audio_ext, false AS audio_platform, k = 7 AS document_ext, k = 7 AS document_path, k = 7 AS pdf, k IN (0, 1, 2, 3, 8, 10, 11, 14, 17) AS is_image, CASE WHEN k = 5 THEN concat('id', CAST(ord AS STRING)) END AS video_id FROM m""")
def detect_evidence(spark, sf_dir):
    u = URL
    return media(spark, sf_dir).select(
        "ord", D.has_image_extension(u).alias("image_ext"), D.matches_image_pattern(u).alias("image_pattern"), D.has_image_params(u).alias("image_params"), D.has_video_extension(u).alias("video_ext"),
        D.is_streaming_manifest(u).alias("manifest"), D.is_video_platform(u).alias("video_platform"), D.has_audio_extension(u).alias("audio_ext"), D.is_audio_platform(u).alias("audio_platform"),
        D.has_document_extension(u).alias("document_ext"), D.has_document_path(u).alias("document_path"), D.is_pdf(u).alias("pdf"), D.is_media_type(u, "image").alias("is_image"), D.video_id(u).alias("video_id"),
    )


@query(WITH_MEDIA + f""", t AS (SELECT CASE WHEN {CONFIDENCE_SQL} >= 0.5 THEN {TYPE_SQL} ELSE 'unknown' END AS media_type FROM m), kinds AS (SELECT unnest(['image', 'video', 'audio', 'document', 'unknown']) AS media_type)
  SELECT media_type, (SELECT count(*) FROM t WHERE t.media_type = kinds.media_type) AS n FROM kinds""")
def media_type_counts(spark, sf_dir):
    return D.group_by_type(D.with_detection(media(spark, sf_dir), URL))


@query(WITH_MEDIA + " SELECT ord, coalesce(width <= 1 AND height <= 1, false) AS pixel, coalesce(width <= 32 AND height <= 32, false) AS small, false AS ui_url FROM m")
def ui_elements(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    return media(spark, sf_dir).select("ord", D.is_tracking_pixel_size(w, h).alias("pixel"), D.is_ui_element_size(w, h).alias("small"), D.is_ui_element_url(URL).alias("ui_url"))


# ---- filters -------------------------------------------------------------------------------------------------------


@query(WITH_MEDIA + " SELECT ord, k IN (10, 17) AS unwanted, k NOT IN (1, 10, 17) AS quality, k IN (0, 1, 2, 3) AS photos, k IN (4, 6) AS globbed FROM m")
def pattern_flags(spark, sf_dir):
    m = media(spark, sf_dir)
    return m.select("ord", filters.is_unwanted(URL).alias("unwanted"), filters.has_quality(URL).alias("quality"), filters.check_patterns(URL, filters.PatternFilter(path_patterns=("/photos/*",))).alias("photos"), filters.matches_any(URL.raw, ["*.mp?"]).alias("globbed"))


@query(WITH_MEDIA + f" SELECT ord FROM m WHERE ({REGISTERED_SQL} = 'example.com' AND k NOT IN (17)) OR k = 5")
def domain_filter(spark, sf_dir):
    rule = filters.PatternFilter(allowed_domains=("example.com", "*.youtube.com"), blocked_domains=("ads.example.com",))
    return media(spark, sf_dir).filter(filters.check_patterns(URL, rule)).select("ord")


@query(WITH_MEDIA + f" SELECT coalesce({REGISTERED_SQL}, 'unknown') AS domain, count(*) AS n FROM m GROUP BY 1")
def domain_groups(spark, sf_dir):
    return filters.group_by_domain(media(spark, sf_dir), URL)


@query(WITH_MEDIA + """ SELECT ord, coalesce(width >= 32 AND height >= 32, false) AS no_tiny, coalesce(width >= 300 AND height >= 200, false) AS medium_plus, coalesce(width / height >= 1.3, false) AS landscape,
  coalesce(width >= 200 AND height >= 150 AND width / height >= 0.5 AND width / height <= 3.0, false) AS photo, file_size IS NULL OR (file_size >= 5000 AND file_size <= 30000) AS size_ok,
  round(width / height, 6) AS ratio, CASE WHEN width IS NULL THEN 'unknown' WHEN coalesce(width * height, 0) < 1024 THEN 'tiny' WHEN width * height < 60000 THEN 'small' WHEN width * height < 921600 THEN 'medium' ELSE 'large' END AS size_group FROM m""")
def dimension_flags(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    check = lambda name: filters.check_dimensions(w, h, filters.preset_dimensions(name)).alias(name)
    return media(spark, sf_dir, parsed=False).select("ord", check("no_tiny"), check("medium_plus"), check("landscape"), check("photo"), filters.check_file_size(F.col("file_size"), 5000, 30_000).alias("size_ok"), F.round(filters.aspect_ratio(w, h), 6).alias("ratio"), filters.size_group(w, h).alias("size_group"))


@query(WITH_MEDIA + " SELECT ord, width, height FROM m ORDER BY coalesce(width * height, 0) DESC, ord LIMIT 1")
def largest_media(spark, sf_dir):
    return filters.largest(media(spark, sf_dir, parsed=False)).select("ord", "width", "height")


@query(WITH_MEDIA + " SELECT ord, width * height AS pixels FROM m ORDER BY coalesce(width * height, 0) DESC, ord")
def sorted_by_size(spark, sf_dir):
    return filters.sort_by_size(media(spark, sf_dir, parsed=False)).select("ord", (F.col("width") * F.col("height")).alias("pixels"))


@query(WITH_MEDIA + " SELECT ord, round(width / height, 6) AS ratio FROM m ORDER BY coalesce(width / height, 0), ord")
def sorted_by_ratio(spark, sf_dir):
    return filters.sort_by_aspect_ratio(media(spark, sf_dir, parsed=False), descending=False).select("ord", F.round(F.try_divide("width", "height"), 6).alias("ratio"))


@query(WITH_MEDIA + f""", f AS (SELECT *, {TYPE_SQL} AS t, CASE WHEN k = 19 THEN 'dup' WHEN k = 11 THEN 'a' || (ord % 250) ELSE 'o' || ord END AS key,
    CASE WHEN file_size > 0 THEN 5 ELSE 0 END AS score FROM m WHERE k NOT IN (10, 17) AND width >= 100 AND height >= 100)
  SELECT ord FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) = 1""")
def filter_builder(spark, sf_dir):
    """Unwanted and small media removed, then deduplicated; the best row of each normal form stays."""
    m = D.with_detection(media(spark, sf_dir), URL).withColumn("media_type", F.col("detection.type")).drop("detection")
    return filters.FilterBuilder(m).min_size(100, 100).remove_unwanted().dedupe().execute().select("ord")


# ---- duplicates ----------------------------------------------------------------------------------------------------

_KEY = "CASE WHEN k = 19 THEN 'dup' WHEN k = 11 THEN 'a' || (ord % 250) ELSE 'o' || ord END"


def _dedupe(strategy: str, **options):
    def run(spark, sf_dir):
        return dedupe.deduplicate(media(spark, sf_dir), dedupe.DedupeOptions(strategy, **options)).select("ord")

    return run


def _dedupe_sql(key: str, score: str = "CASE WHEN file_size > 0 THEN 5 ELSE 0 END", order: str = "ord") -> str:
    return WITH_MEDIA + f" SELECT ord FROM m QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {order}) = 1"


_PATH_KEY = "CASE WHEN k = 19 THEN 'dup' WHEN k = 11 THEN 'a' || (ord % 250) WHEN k IN (5, 8, 13, 14, 15, 16) THEN 'q' || k ELSE 'o' || ord END"
_NAME_KEY = "CASE WHEN k = 19 THEN '' WHEN k = 10 THEN 'pixel.gif' WHEN k = 11 THEN 'cam.jpg' WHEN k = 5 THEN 'watch' WHEN k = 8 THEN 'resize' WHEN k = 13 THEN 'out' WHEN k = 14 THEN 'a.jpg' WHEN k = 15 THEN 'x' WHEN k = 16 THEN 'c' ELSE lower(regexp_extract(split_part(url, '?', 1), '/([^/]*)$', 1)) END"
#: photos of groups share a base name with the plain photo of that number, in the same folder
_SMART_KEY = "CASE WHEN k IN (0, 3) THEN 'p' || ord WHEN k IN (1, 2) THEN 'p' || CAST(floor(ord / 20.0) AS BIGINT) WHEN k = 19 THEN 'dup' WHEN k = 11 THEN 'a' || (ord % 250) WHEN k IN (5, 8, 13, 14, 15, 16) THEN 'q' || k ELSE 'o' || ord END"
for _name, _f, _sql in (
    ("dedupe_exact", _dedupe("exact"), _dedupe_sql("url")),
    ("dedupe_normalized", _dedupe("normalized"), _dedupe_sql(_KEY)),
    ("dedupe_last", _dedupe("normalized", keep_first=False), _dedupe_sql(_KEY, order="ord DESC")),
    ("dedupe_path", _dedupe("path"), _dedupe_sql(_PATH_KEY)),
    ("dedupe_filename", _dedupe("filename"), _dedupe_sql(_NAME_KEY)),
    ("dedupe_smart", _dedupe("smart", prefer_with_dimensions=True), _dedupe_sql(_SMART_KEY, "CASE WHEN file_size > 0 THEN 5 ELSE 0 END + CASE WHEN width * height IS NOT NULL THEN 10 + least(20, floor(width * height / 100000)) ELSE 0 END")),
):
    _f.__name__ = _name
    query(_sql)(_f)


@query(WITH_MEDIA + f" SELECT count(*) AS n, min(ord) AS first FROM m GROUP BY {_KEY} HAVING count(*) > 1")
def duplicates_found(spark, sf_dir):
    return dedupe.find_duplicates(media(spark, sf_dir)).select("n", "first")


@query(WITH_MEDIA + f" SELECT count(*) - count(DISTINCT {_KEY}) AS duplicates FROM m")
def duplicates_counted(spark, sf_dir):
    return dedupe.count_duplicates(media(spark, sf_dir))


#: Greedy by order: a row joins the first seed of its key whose ratio is within 10 %, or unknown; else it is a seed.
_VARIANTS_SQL = f"""WITH RECURSIVE m AS ({MEDIA_SQL}), e AS (
    SELECT ord, width, height, coalesce(width / height, -1) AS r, CASE WHEN k = 0 THEN 'p' || ord WHEN k IN (1, 2) THEN 'p' || CAST(floor(ord / 20.0) AS BIGINT) WHEN k = 11 THEN 'a' || (ord % 250) WHEN k = 19 THEN 'dup' ELSE 'o' || ord END AS key FROM m),
  n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM e),
  g AS (SELECT key, i, ord, width, height, [{{'r': r, 'o': ord}}] AS seeds, ord AS variant FROM n WHERE i = 1 UNION ALL
    SELECT key, i, ord, width, height, CASE WHEN f IS NULL THEN list_append(seeds, {{'r': r, 'o': ord}}) ELSE seeds END, coalesce(f, ord)
    FROM (SELECT n.*, g.seeds, list_filter(g.seeds, lambda s: s.r < 0 OR n.r < 0 OR abs(s.r - n.r) / greatest(s.r, n.r) <= 0.1)[1].o AS f FROM g JOIN n ON n.key = g.key AND n.i = g.i + 1))"""


@query(_VARIANTS_SQL + " SELECT ord, variant FROM g")
def size_variants(spark, sf_dir):
    """Groups of size variants."""
    return dedupe.group_size_variants(media(spark, sf_dir)).select("ord", "variant")


@query(_VARIANTS_SQL + " SELECT ord, width, height FROM g QUALIFY row_number() OVER (PARTITION BY variant ORDER BY coalesce(width, 0) * coalesce(height, 0) DESC, ord) = 1")
def largest_variants(spark, sf_dir):
    return dedupe.keep_largest_variants(media(spark, sf_dir)).select("ord", "width", "height")


# ---- security ------------------------------------------------------------------------------------------------------

RULES = blocklists.Blocklist(domains=("bit.ly", "example.org", "*.example.tk"), ranges=("192.168.1.0/25",), patterns=(r"password=",), allowed=("docs.example.org",))


@query(WITH_MEDIA + f""" SELECT ord, k IN (6, 10, 12, 16) OR (k = 11 AND ord % 250 < 128) AS blocked, CASE WHEN k = 12 THEN 'domain-exact' WHEN k = 6 THEN 'domain-registered' WHEN k = 10 THEN 'wildcard' WHEN k = 11 AND ord % 250 < 128 THEN 'ip-range' WHEN k = 16 THEN 'url-pattern' END AS list,
  CASE WHEN k = 12 THEN 'bit.ly' WHEN k = 6 THEN 'example.org' WHEN k = 10 THEN '*.example.tk' WHEN k = 11 AND ord % 250 < 128 THEN '192.168.1.0/25' WHEN k = 16 THEN 'password=' END AS pattern, k = 10 AS bad_tld FROM m""")
def blocklist_check(spark, sf_dir):
    m = media(spark, sf_dir).withColumn("hit", blocklists.check(URL, RULES))
    return m.select("ord", "hit.*", blocklists.is_suspicious_tld(URL).alias("bad_tld"))


@query(WITH_MEDIA + f" SELECT ord, CASE WHEN k = 12 THEN 'bit.ly' WHEN k IN (6, 7) THEN 'example.org' WHEN k = 5 THEN 'www.youtube.com' END AS listed FROM m")
def blocklist_join(spark, sf_dir):
    """A list of names as a table, joined by host and by registered domain."""
    names = spark.createDataFrame([("bit.ly",), ("EXAMPLE.org",), ("www.youtube.com",), ("absent.example",)], "domain string")
    return blocklists.check_table(media(spark, sf_dir), URL, names).select("ord", "listed")


@query(WITH_MEDIA + """ SELECT ord, true AS is_valid, CASE WHEN k = 11 THEN 'private-ip' ELSE '' END AS threats, CASE WHEN k = 3 THEN replace(url, 'CDN', 'cdn') WHEN k = 19 THEN 'https://example.com/dup/' ELSE url END AS normalized_url FROM m""")
def url_validation(spark, sf_dir):
    m = security.with_validation(media(spark, sf_dir), URL, security.Scanner().validation)
    return m.select("ord", "validation.is_valid", F.array_join(F.transform("validation.threats", lambda t: t["type"]), ",").alias("threats"), "validation.normalized_url")


@query(WITH_MEDIA + """ SELECT ord, CASE WHEN k = 11 THEN 'url-protocol,url-length,query-params,redirect-chain' ELSE 'url-protocol,url-length,private-ip,localhost,query-params,redirect-chain' END AS passed, CASE WHEN k = 11 THEN 'private-ip' ELSE '' END AS failed FROM m""")
def validation_checks(spark, sf_dir):
    m = U.with_redirects(media(spark, sf_dir), URL).withColumn("c", security.validation_checks(URL, security.Validation(), F.col("redirects")))
    return m.select("ord", F.array_join("c.passed", ",").alias("passed"), F.array_join("c.failed", ",").alias("failed"))


@query(WITH_MEDIA + """ SELECT ord, CASE WHEN k = 10 THEN 'suspicious-tld:low,tracking-pixel:low' WHEN k = 12 THEN 'suspicious-redirect:low' WHEN k = 15 THEN 'script-injection:critical' WHEN k = 16 THEN 'data-exfil:medium' ELSE '' END AS threats FROM m""")
def threat_types(spark, sf_dir):
    found = security.detected_threats(URL)
    return media(spark, sf_dir).withColumn("t", found).select("ord", F.array_join(F.transform("t", lambda t: F.concat(t["type"], F.lit(":"), t["severity"])), ",").alias("threats"))


def _scan(preset: str):
    def run(spark, sf_dir):
        s = security.Scanner.from_preset(preset).scan(media(spark, sf_dir), URL)
        return s.select("ord", "security.status", "security.risk_score", F.size("security.threats").alias("n_threats"))

    return run


for _name, _preset, _sql in (
    ("scan_balanced", "balanced", "CASE WHEN k IN (11, 15, 16) THEN 'blocked' WHEN k = 10 THEN 'quarantined' ELSE 'safe' END AS status, CASE k WHEN 10 THEN 50 WHEN 11 THEN 100 WHEN 12 THEN 25 WHEN 15 THEN 100 WHEN 16 THEN 60 ELSE 0 END AS risk_score, CASE WHEN k IN (10, 11) THEN 2 WHEN k IN (12, 15, 16) THEN 1 ELSE 0 END AS n_threats"),
    ("scan_strict", "paranoid", "CASE WHEN k IN (10, 11, 15, 16) THEN 'blocked' WHEN k = 12 THEN 'quarantined' ELSE 'safe' END AS status, CASE k WHEN 10 THEN 50 WHEN 11 THEN 100 WHEN 12 THEN 25 WHEN 15 THEN 100 WHEN 16 THEN 60 ELSE 0 END AS risk_score, CASE WHEN k = 10 THEN 2 WHEN k = 11 THEN 3 WHEN k IN (12, 15, 16) THEN 1 ELSE 0 END AS n_threats"),
    ("scan_permissive", "minimal", "CASE WHEN k = 15 THEN 'blocked' ELSE 'safe' END AS status, CASE WHEN k = 15 THEN 100 ELSE 0 END AS risk_score, CASE WHEN k = 15 THEN 1 ELSE 0 END AS n_threats"),
    ("scan_disabled", "disabled", "'unchecked' AS status, 0 AS risk_score, 0 AS n_threats"),
):
    _f = _scan(_preset)
    _f.__name__ = _name
    query(WITH_MEDIA + f" SELECT ord, {_sql} FROM m")(_f)


@query(WITH_MEDIA + """ SELECT ord, CASE WHEN k = 3 THEN replace(url, 'CDN', 'cdn') WHEN k = 14 THEN replace(url, 'utm_source=feed&', '') WHEN k = 19 THEN 'https://example.com/dup/' ELSE url END AS sanitized FROM m""")
def sanitized_urls(spark, sf_dir):
    return sanitize.with_sanitized_url(media(spark, sf_dir, parsed=False), "url").select("ord", "sanitized")


@query(r"""SELECT page_id, regexp_replace(html, '(?i)<(?:script|iframe|object|embed|form|input|button|textarea|select|style|link|meta|base|applet|frame|frameset|layer|ilayer|bgsound|title|head|html|body)\b[^>]*>|</(?:script|iframe|object|embed|form|input|button|textarea|select|style|link|meta|base|applet|frame|frameset|layer|ilayer|bgsound|title|head|html|body)>', '', 'g') AS clean FROM pages""")
def sanitized_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sanitize.sanitize_html(F.col("html")).alias("clean"))


@query("""SELECT page_id, ord, CASE ord WHEN 0 THEN 'https://e.com/a%20b/' || page_id || '.png?id=1' WHEN 1 THEN 'https://f.com/x' WHEN 2 THEN 'http://g.com/%3Cy' END AS url
  FROM pages, (SELECT unnest([0, 1, 2]) AS ord)""")
def safe_page_urls(spark, sf_dir):
    """Absolute URLs among those of each page, cleaned and without tracking; script and data URLs and relative ones are none."""
    more = F.concat(F.lit('<img src="https://e.com/a%20b/'), "page_id", F.lit(".png?utm_source=q&id=1\"><a href='https://f.com/x' onclick='go()'>f</a><a href=\"javascript:alert(1)\">j</a><iframe src=\"https://h.com/\"></iframe><img src=http://g.com/<y >"), "html")
    found = sanitize.safe_urls(table(spark, sf_dir, "pages").select("page_id", more.alias("html")), "html")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1
    return found.select("page_id", place.alias("ord"), "url")


# ---- sources and the whole pipeline --------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href FROM pages), d AS (SELECT DISTINCT page_id, href FROM l)
  SELECT page_id, CASE WHEN regexp_matches(href, '(?i)^(doc|pdf|download|file|attachment|export)') AND NOT regexp_matches(href, '(?i)^(image|img|photo|picture)') THEN 'document' ELSE 'image' END AS media_type, count(*) AS n
  FROM d WHERE NOT contains(href, '.') OR regexp_matches(href, '(?i)^(doc|pdf|download|file|attachment|export|image|img|photo|picture)') GROUP BY ALL""")
def html_links(spark, sf_dir):
    """Items of whole pages by type; relative links are resolved against the page."""
    items = H.html_items(spread(table(spark, sf_dir, "pages")), base_url="url")
    return items.groupBy("page_id", "media_type").agg(F.count(F.lit(1)).alias("n"))


MARKUP_SQL = """concat('<a href="https://example.com/full', CAST(p_partkey AS STRING), '.jpg"><img src="/i/', CAST(p_partkey AS STRING), '.png" width="', CAST(p_size AS STRING), '" height="20px" alt="A &amp; B" class="Hero"></a>',
  '<img src="/i/', CAST(p_partkey AS STRING), '.png"><img src="logo.svg" class="site-logo" srcset="logo@2x.svg 2x, logo@3x.svg 3x"><picture><source srcset="/w.webp 1x"></picture>',
  '<div style="background: url( /bg.jpg )"></div><video src="/v" poster="/poster.jpg"><source src="/v.mp4"></video><audio src="/a"></audio><a href="/report.pdf" title="R">r</a><a href="/plain.html">p</a>')"""


@query(f"""WITH k AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, i AS item, media_type, hint FROM k, (VALUES
  ('png', 'image', 'primary'), ('logo.svg', 'image', 'ui-element'), ('logo@2x.svg', 'image', 'secondary'), ('logo@3x.svg', 'image', 'secondary'), ('w.webp', 'image', 'secondary'), ('bg.jpg', 'image', 'secondary'),
  ('v', 'image', 'primary'), ('v.mp4', 'video', 'secondary'), ('poster.jpg', 'image', 'secondary'), ('a', 'image', 'primary'), ('full', 'image', 'unknown'), ('report.pdf', 'document', 'unknown')) AS t(i, media_type, hint)""")
def html_media(spark, sf_dir):
    """All passes of the HTML reader on made-up markup."""
    part = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey", f"{MARKUP_SQL} AS html", "'https://example.com/x/' AS base")
    items = H.html_items(part, base_url="base", key="p_partkey")
    name = F.when(F.contains("url", F.lit("/full")), "full").when(F.contains("url", F.lit("/i/")), "png").otherwise(F.substring_index("url", "/", -1))
    return items.select("p_partkey", name.alias("item"), "media_type", "hint")


@query("""WITH k AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, i AS item, media_type, CASE WHEN i = 'png' AND p_size <= 32 THEN 'ui-element' ELSE hint END AS hint, pos FROM k, (VALUES
  (1, 'png', 'image', 'unknown'), (2, 'logo.svg', 'image', 'ui-element'), (3, 'bg.jpg', 'image', 'secondary'), (4, 'v', 'image', 'unknown'), (5, 'v.mp4', 'video', 'secondary'), (6, 'poster.jpg', 'image', 'secondary'), (7, 'a', 'image', 'unknown')) AS t(pos, i, media_type, hint)""")
def dom_media(spark, sf_dir):
    """The walk in document order on the same markup."""
    part = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey", f"{MARKUP_SQL} AS html", "'https://example.com/x/' AS base")
    items = H.html_items(part, base_url="base", key="p_partkey", mode="dom")
    name = F.when(F.contains("url", F.lit("/i/")), "png").otherwise(F.substring_index("url", "/", -1))
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy("ord"))
    return items.select("p_partkey", name.alias("item"), "media_type", "hint", place.alias("pos"))


@query(WITH_MEDIA + " SELECT ord, k = 15 AS is_blocked, k NOT IN (10, 11, 15, 16) AS is_safe FROM m")
def url_verdicts(spark, sf_dir):
    return with_verdicts(media(spark, sf_dir, parsed=False)).select("ord", "is_blocked", "is_safe")


@query(WITH_MEDIA + " SELECT ord, i AS pos, u AS url FROM (SELECT ord, 0 AS i, url AS u FROM m UNION ALL SELECT ord, 1, 'http://example.org/b.mp4' FROM m)")
def text_urls(spark, sf_dir):
    text = F.concat(F.lit("See "), "url", F.lit(", and (http://example.org/b.mp4).!"))
    return media(spark, sf_dir, parsed=False).select("ord", F.posexplode(X.urls_in_text(text)).alias("pos", "url")).withColumn("pos", F.col("pos").cast("int"))


@query(WITH_MEDIA + f""", i AS (SELECT ord, 1 AS sub, url, 'text-url' AS source, {TYPE_SQL} AS media_type, k FROM m WHERE k NOT IN (9, 19) UNION ALL
    SELECT ord, 0, concat('https://cdn.example.com/photos/p', CAST(ord AS STRING), '.jpg'), 'embedded', 'image', k FROM m WHERE k = 13), f AS (SELECT *, CASE WHEN k = 11 THEN 'a' || (ord % 250) ELSE ord || '-' || sub END AS key FROM i)
  SELECT ord, url, source, media_type, CASE WHEN k = 13 AND sub = 0 THEN 'primary' WHEN k = 13 THEN 'secondary' WHEN row_number() OVER (ORDER BY ord, sub) = 1 THEN 'primary' ELSE 'unknown' END AS hint
  FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, sub) = 1)""")
def url_items(spark, sf_dir):
    """URLs with the URLs within them, first seen by normal form."""
    items = X.first_seen(X.parse_with_embedded(media(spark, sf_dir, parsed=False).select("ord", "url")))
    return items.select("ord", "url", "source", "media_type", "hint")


_FILES_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'photo.jpg' WHEN 1 THEN 'Clip.MP4' WHEN 2 THEN 'notes' ELSE 'paper.pdf' END"


@query("SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'document' END AS media_type, CASE p_partkey % 4 WHEN 2 THEN 'audio/ogg' END AS mime_type, nullif(CAST(p_size % 3 AS BIGINT), 0) AS file_size FROM part")
def file_listing(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", f"{_FILES_SQL} AS name", "CASE p_partkey % 4 WHEN 2 THEN 'audio/ogg' ELSE '' END AS type", "CAST(p_size % 3 AS BIGINT) AS size")
    return X.file_items(files).select("ord", "media_type", "mime_type", "file_size")


@query("""WITH p AS (SELECT p_partkey AS payload_id FROM part) SELECT payload_id, pos AS ord, source, media_type, hint FROM p, (VALUES (1, 'file', 'image', 'primary'), (2, 'html-element', 'image', 'primary'), (3, 'uri-list', 'video', 'unknown'),
  (4, 'uri-list', 'image', 'unknown'), (5, 'embedded', 'document', 'primary'), (6, 'text-url', 'audio', 'unknown')) AS t(pos, source, media_type, hint)""")
def payload_sources(spark, sf_dir):
    """Files, HTML, a URI list with an embedded URL and plain text of drop payloads, in that order."""
    data = """map('text/html', '<img src="https://e.com/h.png">', 'text/uri-list', concat('# list\\r\\nhttps://e.com/v.mp4\\nhttps://w.com/o?url=', 'https%3A%2F%2Fe.com%2Fd.pdf'), 'text/plain', 'hear https://e.com/s.mp3!! and https://e.com/h.png')"""
    df = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey AS payload_id", "array(named_struct('name', 'a.b.JPG', 'type', 'image/jpeg', 'size', 10L), named_struct('name', 'x.bin', 'type', 'application/x', 'size', 1L)) AS files", f"{data} AS data")
    return X.payload_items(df).select("payload_id", "ord", "source", "media_type", "hint")


@query("SELECT p_partkey AS payload_id, true AS media, true AS has_files, 1 AS file_count, false AS has_html, p_partkey % 2 = 0 AS has_uri_list, true AS has_text FROM part")
def payload_previews(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS payload_id", "array(named_struct('name', 'a', 'type', if(p_partkey % 2 = 0, 'text/x', 'video/mp4'), 'size', 1L)) AS files", "if(p_partkey % 2 = 0, map('text/uri-list', 'x', 'text/plain', 'y'), map('text/plain', 'y')) AS data")
    out = df.select("payload_id", X.has_media(F.col("files"), F.col("data")).alias("media"), X.payload_preview(F.col("files"), F.col("data")).alias("p"))
    return out.select("payload_id", "media", "p.*")


_ITEMS_SQL = WITH_MEDIA + f""", i AS (SELECT ord, 1 AS sub, k, url, {TYPE_SQL} AS t, {CONFIDENCE_SQL} AS c FROM m WHERE k NOT IN (9, 19) UNION ALL
    SELECT ord, 0, 0, concat('https://cdn.example.com/photos/p', CAST(ord AS STRING), '.jpg'), 'image', 1.0 FROM m WHERE k = 13),
  f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY CASE WHEN k = 11 THEN 'a' || (ord % 250) ELSE ord || '-' || sub END ORDER BY ord, sub) = 1),
  s AS (SELECT *, CASE WHEN k IN (11, 15, 16) THEN 'blocked' WHEN k = 10 THEN 'quarantined' ELSE 'safe' END AS status FROM f)"""


@query(_ITEMS_SQL + " SELECT ord, url, CASE WHEN c < 0.5 THEN 'unknown' ELSE t END AS media_type, status FROM s WHERE status <> 'blocked'")
def extracted_urls(spark, sf_dir):
    """The whole pipeline over URLs, balanced security."""
    return Extractor().from_urls(media(spark, sf_dir, parsed=False)).items.select("ord", "url", "media_type", "status")


@query(_ITEMS_SQL + " SELECT count(*) AS urls_processed, count(*) FILTER (status = 'blocked') AS blocked_urls, count(*) FILTER (status = 'quarantined') AS quarantined_urls, count(*) FILTER (status <> 'blocked') AS items_extracted, count(*) FILTER (status = 'blocked') AS items_filtered, 0 AS invalid_urls FROM s")
def extraction_stats(spark, sf_dir):
    return Extractor().from_urls(media(spark, sf_dir, parsed=False)).stats


@query(WITH_MEDIA + f""", s AS (SELECT ord, k, CASE WHEN {CONFIDENCE_SQL} < 0.5 THEN 'unknown' ELSE {TYPE_SQL} END AS media_type FROM m WHERE k NOT IN (9, 19)) SELECT ord, media_type FROM s WHERE k NOT IN (11, 15, 16)""")
def extracted_single_urls(spark, sf_dir):
    """Each URL by itself: no deduplication between rows, no URLs within URLs."""
    return Extractor().from_url(media(spark, sf_dir, parsed=False)).items.select("ord", "media_type")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href FROM pages), d AS (SELECT DISTINCT page_id, href FROM l)
  SELECT page_id, count(*) AS n FROM d WHERE NOT contains(href, '.') OR regexp_matches(href, '(?i)^(doc|pdf|download|file|attachment|export|image|img|photo|picture)') GROUP BY ALL""")
def extracted_pages(spark, sf_dir):
    """The whole pipeline over pages."""
    items = Extractor(scanner=security.Scanner(mode="permissive")).from_html(spread(table(spark, sf_dir, "pages")), base_url="url").items
    return items.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
