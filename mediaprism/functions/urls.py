"""URL functions as Column expressions over a parsed URL.

``with_url(df, "url")`` adds a struct column with the parts of a URL, parsed once for all functions.  Plain ASCII http(s)
URLs, by far the most, are taken apart by native expressions; others (escapes to add, dot segments, odd hosts, other
schemes) go through one Arrow UDF that sees nulls for the plain ones.  ``exact=False`` leaves the UDF out; such rows then
count as not parsable.

The functions take ``Url("url")``, which stands for the raw column and its parts.  Where a function's result depends on
the letter case, spaces or invalid input, see the function.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from . import whatwg

PARTS = "scheme string, username string, password string, host string, port string, path string, query string, hash string, href string"
#: Plain URLs: http(s), a host of letters, digits, dots and dashes that isn't a number, and a rest that needs no escapes.
_PLAIN = (
    r"^[hH][tT][tT][pP][sS]?://(?![^/?#]*[xX][nN]--)(?:[A-Za-z0-9-]+\.)*(?:[A-Za-z0-9-]*[A-Za-z-][A-Za-z0-9-]*)(?::[1-9][0-9]{0,3})?(?:/(?:[!$&(-;=@-Z\[\]_a-z|~]|%[0-9A-Fa-f]{2})*)?"
    r"(?:\?(?:[!$&(-;=?-Z\[\]_a-z|~]|%[0-9A-Fa-f]{2})*)?(?:#[!#$&(-;=?-Z\[\]_a-z|~%]*)?$"
)
_IPV4 = r"^[hH][tT][tT][pP][sS]?://(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|(?=[/:?#]|$))){4}(?::[1-9][0-9]{0,3})?(?:/(?:[!$&(-;=@-Z\[\]_a-z|~]|%[0-9A-Fa-f]{2})*)?(?:\?(?:[!$&(-;=?-Z\[\]_a-z|~]|%[0-9A-Fa-f]{2})*)?$"
_DOTS = r"(?i)^[a-z]+://[^/?#]*[^?#]*/(?:\.|%2e){1,2}(?:[/?#]|$)|^.{4000}"


@cache
def _udf(f, kind: str):
    """An Arrow UDF of a plain function; made on the driver only, as modules are imported by workers, too."""
    return F.pandas_udf(f, kind)


def barrier(value: Column) -> Column:
    """For ``withColumn``: a value that Catalyst neither inlines into what uses it (such as the argument of a UDF) nor
    repeats in a filter that it pushes down.  The one-element explode costs less than parsing a URL twice."""
    return F.explode(F.array(value))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row.  Expressions that use a value several times would otherwise hold it
    several times, and nested ones would grow beyond what can be compiled."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Url:
    """A URL column and the struct with its parts."""

    name: str
    parts: str = ""

    @property
    def raw(self) -> Column:
        return F.coalesce(F.col(self.name), F.lit(""))

    def part(self, name: str) -> Column:
        return F.coalesce(F.col(f"`{self.parts or self.name + '_parts'}`.{name}"), F.lit(""))

    @property
    def ok(self) -> Column:
        return F.col(f"`{self.parts or self.name + '_parts'}`.scheme").isNotNull()

    @property
    def params(self) -> Column:
        """Decoded query parameters in order: array<struct<k, v>>."""
        return F.coalesce(F.col(f"`{(self.parts or self.name + '_parts')}_params`"), F.array().cast("array<struct<k:string,v:string>>"))


def _slow_parts(urls: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in PARTS.split(", ")]
    found = [whatwg.parse(u) if u else None for u in urls]
    return pd.DataFrame([[f[n] for n in names] if f else [None] * len(names) for f in found], columns=names)


def _plain_parts(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(port)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), r"^\?$", "")
    fragment = F.regexp_replace(F.regexp_extract(url, r"(#.*)$", 1), r"^#$", "")
    href = F.concat(scheme, F.lit("://"), host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), path, query, fragment)
    values = {"scheme": scheme, "username": F.lit(""), "password": F.lit(""), "host": host, "port": port, "path": path, "query": query, "hash": fragment, "href": href}
    return F.struct(*(v.alias(k) for k, v in values.items()))


def _form_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def with_url(df: DataFrame, name: str, parts: str = "", exact: bool = True) -> DataFrame:
    """Adds ``<name>_parts`` (or ``parts``) and the decoded parameters beside it."""
    parts = parts or f"{name}_parts"
    url = F.col(name)
    plain = (url.rlike(_PLAIN) | url.rlike(_IPV4)) & ~url.rlike(_DOTS)
    df = df.withColumn("__plain", F.coalesce(plain, F.lit(False)))
    native = F.when(F.col("__plain"), _plain_parts(url))
    if exact:
        df = df.withColumn("__slow", _udf(_slow_parts, PARTS)(F.when(~F.col("__plain"), url)))
        native = native.when(F.col("__slow.scheme").isNotNull(), F.col("__slow"))
    df = df.withColumn(parts, barrier(native)).drop("__plain", "__slow")
    pair = lambda s: F.struct(_form_decoded(F.regexp_extract(s, "^([^=]*)", 1)).alias("k"), _form_decoded(F.regexp_extract(s, "(?s)^[^=]*=(.*)$", 1)).alias("v"))
    # absent queries, the most, cost no array work
    query = F.col(f"`{parts}`.query")
    params = F.when(F.length(query) > 1, F.transform(F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda s: s != ""), pair))
    return df.withColumn(f"{parts}_params", params)


# ---- predicates ----------------------------------------------------------------------------------------------------


def is_absolute(url: Column) -> Column:
    """http(s) in any letter case; data:, blob: and // are not absolute."""
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def is_data_url(url: Column) -> Column:
    return F.coalesce(url.startswith("data:"), F.lit(False))


def is_blob_url(url: Column) -> Column:
    return F.coalesce(url.startswith("blob:"), F.lit(False))


def is_https(url: Column) -> Column:
    return F.coalesce(F.lower(url).startswith("https://"), F.lit(False))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(url).startswith("http://"), F.lit(False))


def is_javascript_url(url: Column) -> Column:
    """javascript: in any letter case, white space anywhere in it."""
    return F.coalesce(F.lower(F.regexp_replace(url, r"(?U)\s+", "")).startswith("javascript:"), F.lit(False))


# ---- parts ---------------------------------------------------------------------------------------------------------


def domain(url: Url) -> Column:
    """The host; empty for data: URLs and what can't be parsed."""
    return F.when(is_data_url(url.raw), "").otherwise(url.part("host"))


def _two_part(host: Column) -> Column:
    return F.substring_index(host, ".", -2).isin(*T.TWO_PART_TLDS)


def tld(url: Url) -> Column:
    """The last label, or one of six two-part suffixes; a host of one label is its own."""
    host = domain(url)
    return let(host, lambda h: F.when(_two_part(h), F.substring_index(h, ".", -2)).otherwise(F.substring_index(h, ".", -1)))


def registered_domain(url: Url) -> Column:
    """The last two labels, three after a two-part suffix; addresses are cut like names."""
    host = domain(url)
    return let(host, lambda h: F.when(_two_part(h), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2)))


def path(url: Url) -> Column:
    return url.part("path")


def query_string(url: Url) -> Column:
    return F.substring(url.part("query"), 2, 1 << 30)


def query_params(url: Url) -> Column:
    """Map of decoded parameters; of equal names the last wins."""
    last = F.aggregate(url.params, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return last


def count_query_params(url: Url) -> Column:
    return F.size(url.params)


def param(url: Url, name: str) -> Column:
    """The first value of a parameter, or null."""
    return F.get(F.filter(url.params, lambda p: p["k"] == name), F.lit(0))["v"]


def first_value(params: Column, name: Column) -> Column:
    return F.get(F.filter(params, lambda p: p["k"] == name), F.lit(0))["v"]


def has_param(url: Url, name: str) -> Column:
    return F.exists(url.params, lambda p: p["k"] == name)


# ---- normal forms --------------------------------------------------------------------------------------------------


def encoded_params(params: Column) -> Column:
    """Form encoding of an array<struct<k, v>>."""
    return F.array_join(F.transform(params, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def _sorted_params(params: Column) -> Column:
    """Stable sort by name in the root collation."""
    tagged = F.transform(params, lambda p, i: F.struct(F.collate(p["k"], "UNICODE").alias("c"), i.alias("i"), p["k"].alias("k"), p["v"].alias("v")))
    order = lambda a, b: F.when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).when(a["i"] < b["i"], -1).otherwise(1)
    return F.when(F.size(params) < 2, params).otherwise(F.transform(F.array_sort(tagged, order), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))


def normalize(url: Url) -> Column:
    """Lower-case scheme and host, no default port, no slash at the end of a path, sorted and re-encoded parameters; login
    and fragment stay.  data: and blob: URLs and what can't be parsed stay as they are."""
    p = url.part
    user = F.when(p("username") == "", "").otherwise(F.concat(p("username"), F.when(p("password") == "", "").otherwise(F.concat(F.lit(":"), p("password"))), F.lit("@")))
    port = F.when(p("port") == "", "").otherwise(F.concat(F.lit(":"), p("port")))
    short = F.when(F.length(p("path")) > 1, F.regexp_replace(p("path"), r"/\z", "")).otherwise(p("path"))
    query = encoded_params(_sorted_params(url.params))
    whole = F.concat(p("scheme"), F.lit("://"), user, p("host"), port, short, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), p("hash"))
    return F.when(~url.ok | is_data_url(url.raw) | is_blob_url(url.raw), url.raw).otherwise(whole)


def dedupe_key(url: Url) -> Column:
    """Host and path; data: and blob: URLs and what can't be parsed stay as they are."""
    return F.when(~url.ok | is_data_url(url.raw) | is_blob_url(url.raw), url.raw).otherwise(F.concat(url.part("host"), url.part("path")))


# ---- addresses -----------------------------------------------------------------------------------------------------


def ip_number(text: str) -> int:
    """A dotted address as a number, on the driver."""
    return reduce(lambda a, b: a * 256 + int(b), text.split("."), 0)


def ipv4_to_int(host: Column) -> Column:
    """The address as a bigint, null if it is none.  Each of four parts counts up to its first non-digit."""
    parts = F.split(host, r"\.", -1)
    numbers = F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("bigint"))
    value = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, n: a * 256 + n)
    good = (F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull() & n.between(0, 255))
    return F.when(good, value)


def is_ipv4(host: Column) -> Column:
    return ipv4_to_int(host).isNotNull()


def is_private_ip(host: Column) -> Column:
    """In one of 13 private and reserved ranges."""
    return F.coalesce(F.exists(F.array(ipv4_to_int(host)), lambda v: reduce(Column.__or__, (v.between(ip_number(a), ip_number(b)) for a, b in T.PRIVATE_RANGES))), F.lit(False))


def is_localhost(host: Column) -> Column:
    low = F.lower(host)
    return F.coalesce(low.isin("localhost", "127.0.0.1", "[::1]", "::1") | low.endswith(".localhost"), F.lit(False))


def is_private_url(url: Url) -> Column:
    """A local or private IPv4 host; private IPv6 ranges are not looked at."""
    host = domain(url)
    return (host != "") & (is_localhost(host) | is_private_ip(host))


# ---- encoding ------------------------------------------------------------------------------------------------------


def decode_component(text: Column) -> Column:
    """Percent-decoding; a text with malformed escapes or invalid UTF-8 stays as it is.  Plus signs stay."""


    def decoded(t: Column) -> Column:
        lossy = F.contains(F.upper(t), F.lit("%EF%BF%BD")) | F.contains(t, F.lit("�"))
        plain = F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B")))
        return let(plain, lambda d: F.when(d.isNull() | (F.contains(d, F.lit("�")) & ~lossy), t).otherwise(d))

    return let(text, lambda t: F.when(F.contains(t, F.lit("%")), decoded(t)).otherwise(t))


_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _decode_uri(texts: pd.Series) -> pd.Series:
    def run(m: re.Match) -> str:
        decoded = bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
        at, out = 0, []
        for c in decoded:
            size = 3 * len(c.encode())
            out.append(m[0][at : at + size] if c in ";/?:@&=+$,#" else c)
            at += size
        return "".join(out)

    def one(text: str | None) -> str | None:
        if text is None or "%" in _ESCAPES.sub("", text):
            return text
        try:
            return _ESCAPES.sub(run, text)
        except UnicodeDecodeError:
            return text

    return texts.map(one)


def decode_uri(text: Column) -> Column:
    """As ``decode_component``, but escapes of reserved characters stay."""
    return _udf(_decode_uri, "string")(text)


def count_encoded(text: Column) -> Column:
    return F.regexp_count(text, F.lit("%[0-9A-Fa-f]{2}"))


def is_excessively_encoded(text: Column) -> Column:
    """More than 30 % of the characters belong to escapes."""
    return F.coalesce(F.try_divide(count_encoded(text) * 3, F.length(text)) > 0.3, F.lit(False))


# ---- URLs in URLs --------------------------------------------------------------------------------------------------


def embedded_url(url: Url) -> Column:
    """The first absolute URL in one of twelve parameters, as it is or decoded once more; null if there is none."""

    absolute = lambda v: F.when(is_absolute(v), v)
    found = lambda name: let(first_value(url.params, name), lambda v: F.coalesce(absolute(v), absolute(decode_component(v))))
    names = F.array(*map(F.lit, T.EMBEDDED_PARAMS))
    return F.when(F.size(url.params) > 0, F.get(F.filter(F.transform(names, found), lambda v: v.isNotNull()), F.lit(0)))


def is_shortener(url: Url) -> Column:
    return registered_domain(url).isin(*T.SHORTENERS)


def _redirects(urls: pd.Series) -> pd.Series:
    from urllib.parse import parse_qsl, unquote

    def inner(url: str) -> str | None:
        found = whatwg.parse(url)
        if not found:
            return None
        first: dict[str, str] = {}
        for k, v in parse_qsl(found["query"][1:], keep_blank_values=True, errors="replace"):
            first.setdefault(k, v)
        for name in T.EMBEDDED_PARAMS:
            value = first.get(name)
            for x in (value, unquote(value, errors="replace")) if value else ():
                if x.lower().startswith(("http://", "https://")):
                    return x
        return None

    def count(url: str | None) -> int:
        n = 0
        while url and n < 10:
            after = inner(url)
            if not after or after == url:
                break
            url, n = after, n + 1
        return n

    return urls.map(count)


def with_redirects(df: DataFrame, url: Url, out: str = "redirects", exact: bool = True) -> DataFrame:
    """Adds how many URLs lie within each other, 10 at most.  An Arrow UDF follows them; it gets only URLs whose query
    could hold another one (``exact=False``: 0 or 1, without the UDF)."""
    if exact:
        count = F.coalesce(_udf(_redirects, "int")(F.when(url.part("query").rlike("=.*(?:://|%)"), url.raw)), F.lit(0))
    else:
        count = let(embedded_url(url), lambda e: F.when(e != url.raw, 1).otherwise(0))
    return df.withColumn(out, count)
