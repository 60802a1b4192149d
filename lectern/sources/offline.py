"""Answers without a network, for tests and queries: an opener like ``http.open_url`` that makes up what was asked for."""

from __future__ import annotations

import json
import re
import urllib.parse


def paged(url: str, timeout: float, agent: str) -> tuple[int, dict, bytes]:
    """Pages of a query ``name#n`` with ``n`` hits (3 if it names no number); with ``name#n!k`` the server fails from hit ``k`` on."""
    asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
    name, n, fails = re.fullmatch(r"(.*?)(?:#(\d+)(?:!(\d+))?)?", asked["q"]).groups()
    n = n or "3"
    first, size = int(asked["f"]), int(asked["h"])
    if fails is not None and first >= int(fails):
        return 404, {}, b""
    hits = [{"info": {"key": f"{name}/{i}", "title": f"Title {i}."}} for i in range(first, min(int(n), first + size))]
    found = {} if not hits else {"hit": hits[0] if len(hits) == 1 else hits}
    return 200, {}, json.dumps({"result": {"hits": {"@total": n} | found}}).encode()


def index(url: str, timeout: float, agent: str) -> tuple[int, dict, bytes]:
    """An index page that links two editions of the folder that ends the URL; pages of queries as ``paged``."""
    if "?" in url:
        return paged(url, timeout, agent)
    folder = url.partition("://")[2].partition("/")[2]
    stem = folder.rpartition("/")[2]
    return 200, {}, "".join(f'<a href="https://x/db/{folder}/{stem}{y}.html">' for y in (1999, 2004)).encode()


def lookup(url: str, timeout: float, agent: str) -> tuple[int, dict, bytes]:
    """A work for each value asked for in ``filter``, in the form ``results`` of a lookup answer; none for odd lengths."""
    asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
    values = asked["filter"].partition(":")[2].split("|")
    works = [{"doi": v, "display_name": f"Work {v}", "publication_year": 2000, "abstract_inverted_index": {"text": [0], v: [1]}} for v in values if len(v) % 2 == 0]
    return 200, {}, json.dumps({"results": works}).encode()
