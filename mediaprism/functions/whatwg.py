"""URL parsing by the WHATWG rules, for the URLs that the native expressions in ``urls`` don't cover.

``parse(url, base)`` gives a dict of the serialized parts or None.  It covers hierarchical URLs (special and other
schemes), opaque ones (``data:``, ``blob:``, ``mailto:``), relative references, IPv4 in any notation, IPv6, internationalized
host names (IDNA 2003 as in the standard library) and percent-encoding of each part.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_to_bytes

PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_CONTROL = frozenset(chr(c) for c in range(0x20)) | {"\x7f"}
_FRAGMENT = _CONTROL | set(' "<>`')
_QUERY = _CONTROL | set(' "#<>')
_PATH = _QUERY | set("?^`{}")
_USER = _PATH | set("/:;=@[\\]|")


def _escape(text: str, chars) -> str:
    return "".join("".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) if c in chars or c > "~" else c for c in text)


def _number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16) if re.fullmatch(r"[0-9A-Fa-f]*", part[2:]) else None
        if len(part) > 1 and part[0] == "0":
            return int(part, 8) if re.fullmatch(r"[0-7]+", part) else None
        return int(part) if re.fullmatch(r"[0-9]+", part) else None
    except ValueError:
        return None


def host_of(raw: str, special: bool) -> str | None:
    """The serialized host, or None if it is invalid."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    if not special:
        return None if re.search(r"[\x00\t\n\r #/<>?@\[\\\]^|]", raw) else _escape(raw, _CONTROL)
    try:
        host = unquote_to_bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    if host.isascii():
        host = host.lower()
    else:
        host = host.lower().replace("。", ".").replace("．", ".").replace("｡", ".")
        try:
            host = ".".join(label.encode("idna").decode() if label and not label.isascii() else label for label in host.split("."))
        except UnicodeError:
            return None
    if not host or _FORBIDDEN.search(host):
        return None
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    if re.fullmatch(r"[0-9]+|0[xX][0-9A-Fa-f]*", labels[-1]):
        numbers = [_number(x) for x in labels]
        if len(numbers) > 4 or any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
        return str(ipaddress.IPv4Address(value))
    return host


def _path(text: str, special: bool, above: list[str]) -> str:
    """A hierarchical path with dot segments resolved; ``above`` are the base's segments."""
    out = list(above)
    segments = re.split(r"[/\\]" if special else "/", text)
    for k, part in enumerate(segments):
        last, plain = k == len(segments) - 1, part.lower().replace("%2e", ".")
        if plain == "..":
            del out[-1:]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_escape(part, _PATH))
    return "/" + "/".join(out)


def parse(url: str, base: str | None = None) -> dict[str, str | None] | None:
    """scheme, username, password, host, port, path, query, hash (the last two with their sign, or empty), href."""
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(0x21)))))
    m = _SCHEME.match(url)
    rest, tail = url[m.end() :] if m else url, ""
    known = parse(base) if base else None
    scheme = m[1].lower() if m else (known or {}).get("scheme")
    if scheme is None or (not m and known["opaque"] and not url.startswith("#")):
        return None
    special = scheme in PORTS
    rest, _, tail = rest.partition("#")
    fragment = "#" + _escape(tail, _FRAGMENT) if tail else ""
    body, mark, asked = rest.partition("?")
    query = "?" + _escape(asked, _QUERY | {"'"} if special else _QUERY) if asked else ""
    out = {"scheme": scheme, "username": "", "password": "", "host": "", "port": "", "query": query, "hash": fragment, "opaque": False}
    slashes = re.match(r"[/\\]*" if special else r"/*", body)[0]
    relative = not m or (special and scheme != "file" and known and known["scheme"] == scheme and not slashes)
    if relative and len(slashes) < 2:
        if known is None:
            return None
        out |= {k: known[k] for k in ("username", "password", "host", "port")}
        above = known["path"].split("/")[1:-1]
        if not body:
            out |= {"path": known["path"], "query": query if mark else known["query"], "opaque": known["opaque"]}
        else:
            out["path"] = _path(body[1:] if slashes else body, special, [] if slashes else above)
    elif scheme == "file" and len(slashes) < 2:
        out["path"] = _path(body[1:] if slashes else body, special, [])  # no host without two slashes
    elif special or slashes.startswith("//"):
        after = body[len(slashes) :] if special and scheme != "file" else body[min(2, len(slashes)) :]
        end = re.search(r"[/\\]" if special else "/", after)
        authority, path = (after[: end.start()], after[end.start() + 1 :]) if end else (after, "")
        user, at, hostport = authority.rpartition("@")
        if at:
            name, _, secret = user.partition(":")
            out |= {"username": _escape(name, _USER), "password": _escape(secret, _USER)}
        port = re.search(r":([^:\]]*)$", hostport)
        raw = hostport[: port.start()] if port else hostport
        if port and port[1]:
            if not port[1].isdigit() or int(port[1]) > 65535:
                return None
            out["port"] = "" if str(int(port[1])) == PORTS.get(scheme) else str(int(port[1]))
        if scheme == "file":
            host = "" if raw in ("", "localhost") else host_of(raw, True)
        else:
            host = host_of(raw, special) if raw or special else ""
        if host is None:
            return None
        out |= {"host": host, "path": _path(path, special, []) if special or end else ""}
    elif slashes:
        out["path"] = _path(body[1:], special, [])
    else:
        out |= {"path": _escape(body, _CONTROL), "opaque": True}
    login = out["username"] + (":" + out["password"] if out["password"] else "")
    authority = ("" if out["opaque"] or (not out["host"] and scheme not in PORTS) else "//") + (login + "@" if login else "") + out["host"] + (":" + out["port"] if out["port"] else "")
    return out | {"href": f"{scheme}:{authority}{out['path']}{out['query']}{out['hash']}"}


def resolve(url: str, base: str | None) -> str | None:
    """The absolute form of a reference; absolute http(s), data and blob URLs stay as they are written."""
    if not url:
        return None
    if re.match(r"(?i)https?://", url) or url.startswith(("data:", "blob:")):
        return url
    found = parse(url, base) if base else None
    return found["href"] if found else None
