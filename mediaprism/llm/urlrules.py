"""URL filters: block and allow rules, spread over redirects and canonical links.  DataFrame operations only.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest fitting rule
decides.  URLs without a rule take the verdict of their equivalence class: pages that redirect (``<meta http-equiv=
refresh>``) or point with ``<link rel=canonical>`` to another URL form classes (connected components), and a class with a
blocked member is blocked.  Allow takes precedence for the URL that a rule allows, and for no other: an allowed alias says
nothing for the rest of its class, or one of them would clear any number of blocked pages.

Nulls, empty strings and strings without ``://`` have an empty host and path, fit no rule and are allowed unless their
class is blocked.  Repeated rows give repeated results.  An empty table gives an empty result; other columns of the
input are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stored, table
from .components import components

#: (action, host, path)
Rule = tuple[str, str, str]
PRODUCTION_RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=[^>]*>"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null.  Of equally long rules, an allow comes first."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def with_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds host, path and node, each computed once (put no filter right above: Catalyst would repeat the parsing in it).

    The node names a URL in the equivalence: host, path and query, without scheme and fragment; null if there is no host.
    """
    host, path, rest = f"{prefix}host", f"{prefix}path", f"{prefix}rest"
    df = df.withColumn(rest, _rest(F.col(url)))
    df = df.withColumns({
        host: F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        path: F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })
    node = F.when(F.col(host) != "", F.concat(host, F.when(F.col(path) == "", "/").otherwise(F.col(path)), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)))
    return df.withColumn(f"{prefix}node", node).drop(rest)


def _without_dots(path: Column) -> Column:
    """A rooted path without its ``.`` and ``..`` segments."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.element_at(parts, -1)
    up = lambda out: F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == ".", out).when(x == "..", up(out)).otherwise(F.array_append(out, x)))
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolve(to: Column, base: Column) -> Column:
    """A reference against an absolute http(s) URL, by RFC 3986, without its fragment; null for other schemes and for empty
    references, which name the page itself."""
    scheme = F.coalesce(F.nullif(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")), F.lit("http"))
    rest = _rest(base)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    plain = F.regexp_extract(to, r"^([^#]*)", 1)
    own, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"^[^?]*(\?.*)", 1)
    absolute = F.regexp_extract(plain, "(?i)^(https?://[^/?]*)", 1)
    return (
        F.when(plain == "", None).when(absolute != "", F.concat(absolute, _without_dots(F.substring(own, F.length(absolute) + 1, F.length(own))), query))
        .when(plain.startswith("//"), F.concat(scheme, F.lit(":"), plain)).when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(plain.startswith("?"), F.concat(root, path, query)).when(plain.startswith("/"), F.concat(root, _without_dots(own), query)).otherwise(F.concat(root, _without_dots(F.concat(folder, own)), query))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) of pages(url, html): all canonical links and meta redirects between URL nodes.

    Targets may be absolute, scheme-relative, rooted, relative to the page's folder or its ``<base href>``, or a query alone;
    dot segments are resolved, and other schemes are no links.
    """
    seen = pages.filter(F.col("html").rlike("(?i)<link[^>]*canonical|<meta[^>]*refresh")).select("url", "html")
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    href = lambda tag: F.concat(*(F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)))
    clean = lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")))
    canonical = F.transform(every(_CANONICAL), href)
    moved = F.transform(every(_REFRESH), lambda tag: F.regexp_extract(tag, _REFRESH_URL, 1))
    base = href(F.regexp_extract("html", _BASE, 0))
    each = seen.select("url", clean(base).alias("base"), F.explode(F.concat(canonical, moved)).alias("to")).filter("to <> ''")
    each = stored(each, "targets").withColumn("at", F.coalesce(F.when(F.col("base") != "", resolve(F.col("base"), F.col("url"))), F.col("url")))
    each = with_parts(each.withColumn("target", resolve(clean(F.col("to")), F.col("at"))), "url")
    return with_parts(each, "target", "to_").select(F.col("node").alias("a"), F.col("to_node").alias("b"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, html).

    ``redirects(url, target)`` adds known redirects to those that the pages themselves declare.  ``rules`` is a short
    list: it becomes one CASE expression.
    """
    links = page_links(pages)
    if redirects is not None:
        known = with_parts(with_parts(redirects.select("url", "target"), "url"), "target", "to_")
        links = links.unionAll(known.select(F.col("node").alias("a"), F.col("to_node").alias("b")))
    classes = components(stored(links, "links"))  # stored first: else filters above would repeat the parsing below
    judged = with_parts(pages.select("page_id", "url"), "url").withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    out = ["page_id", "host", "path", F.col("best.rule").alias("rule")]
    if classes.isEmpty():
        return judged.select(*out, F.coalesce("best.action", F.lit("allow")).alias("verdict"))
    member = with_parts(classes.withColumn("url", F.concat(F.lit("http://"), "node")), "url")
    member = member.withColumn("action", best_rule(F.col("host"), F.col("path"), rules)["action"])
    bad = member.filter("action = 'block'").select("component").distinct()
    blocked = stored(member.join(bad, "component").select("node", F.lit("block").alias("spread")), "blocked")
    return judged.join(blocked, "node", "left").select(*out, F.coalesce("best.action", "spread", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every row of ``pages`` under the production rules."""
    return judge_urls(table(spark, sf_dir, "pages"), PRODUCTION_RULES)


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM p
), r(action, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), n AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, html,
         CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM q
), l AS (
  SELECT DISTINCT node AS a, CASE WHEN regexp_extract(t, '^[a-zA-Z]+://([^/?#]*)', 1) = '' THEN NULL ELSE
    lower(regexp_extract(t, '^[a-zA-Z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract(t, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(t, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END
    || regexp_extract(t, '^[^?#]*(\?[^#]*)', 1) END AS b
  FROM (SELECT node, unnest([regexp_extract(regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*>'), '(?i)href="([^"]*)"', 1),
                             regexp_extract(regexp_extract(html, '(?i)<meta[^>]*http-equiv="refresh"[^>]*>'), '(?i)url=([^">]*)', 1)]) AS t FROM n)
), e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b
), reach(node, other) AS (SELECT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a
), acted AS (
  SELECT o.node, arg_max(r.action, length(r.h || r.pre)) AS action
  FROM (SELECT DISTINCT other AS node FROM reach) o JOIN r ON (regexp_extract(o.node, '^[^/]*') = r.h OR regexp_extract(o.node, '^[^/]*') LIKE '%.' || r.h) AND starts_with(substr(o.node, strpos(o.node, '/')), r.pre)
  GROUP BY o.node
), spread AS (
  SELECT reach.node FROM reach LEFT JOIN acted ON reach.other = acted.node GROUP BY reach.node
  HAVING coalesce(bool_or(action = 'block'), false)
), m AS (
  SELECT n.page_id, n.host, n.path, n.node, r.h || r.pre AS rule, r.action,
         row_number() OVER (PARTITION BY n.page_id, n.host, n.path, n.node ORDER BY length(r.h || r.pre) DESC NULLS LAST) AS k
  FROM n LEFT JOIN r ON (n.host = r.h OR n.host LIKE '%.' || r.h) AND starts_with(n.path, r.pre)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN node IN (SELECT node FROM spread) THEN 'block' END, 'allow') AS verdict FROM m WHERE k = 1
"""
