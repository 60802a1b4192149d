"""A rate-limited, cached HTTP source as a Python data source.

All requests of a source are one partition with one client, so they run one after the other, however many cores there
are, and the pause that a throttling server asked for is kept from one edition to the next. Bodies go through the cache
folder, so a retried task asks again only for what is missing. Run it with speculation off.
"""

from __future__ import annotations

import gzip
import hashlib
import importlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, InputPartition

# Answers after which a request is tried again.
RETRY_ON = {429, 500, 502, 503, 504}
COUNTS = "requests int, cached int, retries int, failed int"


class FetchError(Exception):
    pass


def open_url(url: str, timeout: float, agent: str) -> tuple[int, dict, bytes]:
    """``(status, headers, body)`` of one request."""
    request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Client:
    """Requests with a pause that grows when the server throttles and shrinks after a run of successes."""

    def __init__(self, cache: str | None = None, delay: float = 3.0, longest: float = 20.0, retries: int = 6, ttl_days: float | None = None,
                 refresh: bool = False, timeout: float = 60.0, agent: str = "lectern", opener: Callable = open_url, sleep: Callable = time.sleep):
        self.cache, self.base, self.delay, self.longest = cache, delay, delay, longest
        self.retries, self.ttl_days, self.refresh, self.timeout, self.agent = retries, ttl_days, refresh, timeout, agent
        self.opener, self.sleep = opener, sleep
        self.counts: Counter = Counter()
        self._good, self._last = 0, 0.0

    def _file(self, url: str) -> str | None:
        if not self.cache:
            return None
        key = hashlib.sha1(url.encode()).hexdigest()
        return os.path.join(self.cache, key[:2], key)

    def _cached(self, url: str) -> str | None:
        path = self._file(url)
        if not path or not os.path.exists(path):
            return None
        if self.ttl_days is not None and time.time() - os.path.getmtime(path) > self.ttl_days * 86400:
            return None
        with open(path, encoding="utf-8") as f:
            return f.read()

    def _keep(self, url: str, body: str) -> None:
        if path := self._file(url):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
                f.write(body)
            os.replace(f"{path}.{os.getpid()}", path)

    def get(self, url: str, params: dict | None = None, force: bool = False) -> str:
        """The body; from the cache unless ``force`` or ``refresh``. ``FetchError`` after the last retry."""
        if params:
            url = f"{url}?{urllib.parse.urlencode(params)}"
        if not (force or self.refresh) and (body := self._cached(url)) is not None:
            self.counts["cached"] += 1
            return body
        said = ""
        for attempt in range(self.retries + 1):
            if (pause := self._last + self.delay - time.monotonic()) > 0:
                self.sleep(pause)
            self._last = time.monotonic()
            self.counts["requests"] += 1
            try:
                status, headers, raw = self.opener(url, self.timeout, self.agent)
            except OSError as e:
                status, headers, raw, said = 0, {}, b"", str(e)
            if status == 200:
                self._succeeded()
                body = self._decode(headers, raw)
                self._keep(url, body)
                return body
            said = said or f"status {status}"
            if status and status not in RETRY_ON:
                break
            self._throttled()
            if attempt < self.retries:
                self.counts["retries"] += 1
                asked = str(headers.get("Retry-After", ""))
                self.sleep(min(180.0, float(asked)) if asked.isdigit() else min(180.0, 10.0 * 2**attempt))
        self.counts["failed"] += 1
        raise FetchError(f"{url}: {said}")

    def _decode(self, headers: dict, raw: bytes) -> str:
        low = {k.lower(): v for k, v in headers.items()}
        if low.get("content-encoding") == "gzip":
            raw = gzip.decompress(raw)
        charset = low.get("content-type", "").partition("charset=")[2].strip() or "utf-8"
        return raw.decode(charset, "replace")

    def _succeeded(self) -> None:
        self._good += 1
        if self._good >= 20:
            self.delay, self._good = max(self.base, self.delay / 1.3), 0

    def _throttled(self) -> None:
        self.delay, self._good = min(self.longest, self.delay * 1.6), 0


def _callable(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def client_of(o: dict) -> Client:
    """The client that the options of a source describe."""
    return Client(cache=o.get("cache"), delay=float(o.get("delay", 3.0)), longest=float(o.get("maxDelay", 20.0)), retries=int(o.get("retries", 6)),
                  ttl_days=float(o["ttlDays"]) if "ttlDays" in o else None, refresh=o.get("refresh", "false").lower() == "true", timeout=float(o.get("timeout", 60.0)),
                  agent=o.get("userAgent", "lectern"), opener=_callable(o["opener"]) if "opener" in o else open_url)


class All(InputPartition):
    """What one client has to ask for."""

    def __init__(self, wanted: list):
        super().__init__(wanted)


class _Reader(DataSourceReader):
    """One partition for all that is wanted; each row carries what its requests counted."""

    option = "queries"

    def __init__(self, options: dict):
        self.options = CaseInsensitiveDict(options)  # Spark hands the keys over in lower case

    def partitions(self) -> list[InputPartition]:
        return [All(json.loads(self.options[self.option]))]

    def counted(self, client: Client) -> tuple[int, int, int, int]:
        """What was counted since the last call."""
        counts = tuple(client.counts[k] for k in ("requests", "cached", "retries", "failed"))
        client.counts.clear()
        return counts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = client_of(self.options)
        for wanted in partition.value:
            yield from self.ask(client, wanted)


class PagedReader(_Reader):
    """Pages of each query until the first page's total is reached or a page is empty; a failure keeps the pages before it."""

    def ask(self, client: Client, query: str) -> Iterator[tuple]:
        size, offset, total = int(self.options.get("pageSize", 100)), 0, None
        while True:
            params = {"q": query, "h": size, "f": offset, "c": 0, "format": "json"}
            try:
                body = client.get(self.options["url"], params)
                hits = json.loads(body)["result"]["hits"]
            except (FetchError, ValueError, KeyError) as e:
                yield query, offset, None, total, str(e), *self.counted(client)
                return
            found = hits.get("hit", [])
            n = 1 if isinstance(found, dict) else len(found)
            total = int(hits.get("@total", 0)) if total is None else total
            yield query, offset, body, total, "", *self.counted(client)
            offset += n
            if not n or offset >= total:
                return


class PagedSource(DataSource):
    """``spark.read.format("lectern_pages")`` with ``url`` and ``queries`` (a JSON array): ``query, offset, body, total, error``."""

    @classmethod
    def name(cls) -> str:
        return "lectern_pages"

    def schema(self) -> str:
        return f"query string, offset int, body string, total int, error string, {COUNTS}"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


class UrlReader(_Reader):
    option = "urls"

    def ask(self, client: Client, url: str) -> Iterator[tuple]:
        try:
            yield url, client.get(url), "", *self.counted(client)
        except FetchError as e:
            yield url, None, str(e), *self.counted(client)


class UrlSource(DataSource):
    """``spark.read.format("lectern_urls")`` with ``urls`` (a JSON array): ``url, body, error``; index pages come so."""

    @classmethod
    def name(cls) -> str:
        return "lectern_urls"

    def schema(self) -> str:
        return f"url string, body string, error string, {COUNTS}"

    def reader(self, schema) -> UrlReader:
        return UrlReader(dict(self.options))


class LookupReader(_Reader):
    """One request for each batch of values: they are put into one parameter, joined by a separator."""

    option = "batches"

    def ask(self, client: Client, batch: list[str]) -> Iterator[tuple]:
        o = self.options
        values = o.get("separator", "|").join(batch)
        params = json.loads(o.get("params", "{}")) | {o["parameter"]: o.get("template", "{}").replace("{}", values)}
        try:
            yield batch, client.get(o["url"], params), "", *self.counted(client)
        except FetchError as e:
            yield batch, None, str(e), *self.counted(client)


class LookupSource(DataSource):
    """``spark.read.format("lectern_lookup")``: ``items, body, error`` for each batch.

    Options: ``url``, ``batches`` (a JSON array of arrays), ``parameter`` that takes the values, ``template`` around them,
    ``separator`` between them, ``params`` (a JSON object) sent with every request, and those of the client.
    """

    @classmethod
    def name(cls) -> str:
        return "lectern_lookup"

    def schema(self) -> str:
        return f"items array<string>, body string, error string, {COUNTS}"

    def reader(self, schema) -> LookupReader:
        return LookupReader(dict(self.options))


def register(spark) -> None:
    for source in (PagedSource, UrlSource, LookupSource):
        spark.dataSource.register(source)
