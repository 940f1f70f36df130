"""Fetching pages, from a frame of URLs or as a Spark data source, with a limiter for each domain.

A domain's pages are dealt to one partition, so its limiter is local to one task. Tests give a transport of their own.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BACKOFF, MOST_WAIT = 60.0, 30
AGENT = "Mozilla/5.0"
#: Columns of fetched pages.
PAGE = "url string, final_url string, status int, html string, error string"
#: Bytes of pages that a task holds before it passes them on.
HELD_BYTES = 16 << 20
Transport = Callable[[str, float], tuple[int, dict, str, str]]


class Limiter:
    """Least seconds between requests to a domain; each refusal doubles them, up to a bound."""

    def __init__(self, delay: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep = delay, clock, sleep
        self.last: dict[str, float] = {}
        self.extra: dict[str, float] = {}

    def wait(self, domain: str) -> None:
        gap = max(self.delay, self.extra.get(domain, 0.0))
        past = self.clock() - self.last.get(domain, float("-inf"))
        if past < gap:
            self.sleep(gap - past)
        self.last[domain] = self.clock()

    def refused(self, domain: str) -> None:
        self.extra[domain] = min(2 * (self.extra.get(domain) or self.delay), MOST_BACKOFF)


def http(url: str, timeout: float, agent: str = AGENT) -> tuple[int, dict, str, str]:
    """Status, headers, final URL and text of a page; raises OSError if there is no answer."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.url, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers), error.url or url, ""


def fetch(url: str, limiter: Limiter, transport: Transport = http, timeout: float = 15, attempts: int = 2) -> dict:
    """One page: 429 waits and tries again, 403 and 404 end, other failures try again after 1, 2, 4, ... seconds."""
    domain = urlsplit(url).netloc
    out = {"url": url, "final_url": url, "status": None, "html": None, "error": None}
    for attempt in range(attempts):
        limiter.wait(domain)
        more = attempt < attempts - 1
        try:
            status, headers, final, text = transport(url, timeout)
        except OSError as error:
            out["error"] = str(error)[:100]
            if more:
                limiter.sleep(2**attempt)
            continue
        out |= {"status": status, "final_url": final, "error": None if status < 400 else f"HTTP {status}"}
        if status == 429:
            limiter.refused(domain)
            if more:
                asked = str(headers.get("Retry-After", 2 ** (attempt + 1)))
                limiter.sleep(min(int(asked) if asked.isdigit() else 2 ** (attempt + 1), MOST_WAIT))
            continue
        if status in (403, 404):
            return out
        if status < 400:
            return out | {"html": text}
        if more:
            limiter.sleep(2**attempt)
    return out


def fetch_pages(urls: DataFrame, tasks: int = 5, timeout: float = 15, attempts: int = 2, delay: float = 1.0, agent: str = AGENT, transport: Transport | None = None) -> DataFrame:
    """The page of each distinct url (column url) that isn't null, with the columns of PAGE. The urls stay where they
    are stored and are dealt by domain; `tasks` is how many are asked at a time. Every use of the result fetches anew,
    so write it to a table first."""
    ask = transport or partial(http, agent=agent)
    domain = F.lower(F.regexp_extract("url", "^[^:/?#]*://([^/?#]*)", 1))
    dealt = urls.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct().repartition(tasks, domain)
    names = [c.split()[0] for c in PAGE.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in PAGE.split(", ")]

    def built(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        limiter, held, weight = Limiter(delay), [], 0
        for batch in batches:
            for url in batch.column(0).to_pylist():
                held.append(fetch(url, limiter, ask, timeout, attempts))
                weight += len(held[-1]["html"] or "")
                if weight >= HELD_BYTES:
                    yield built(held)
                    held, weight = [], 0
        if held:
            yield built(held)

    return dealt.mapInArrow(run, PAGE)


class PageSource(DataSource):
    """spark.read.format("pages").option("urls", newline-separated).load(): url, final_url, status, html, error."""

    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return _Pages(self.options)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(0)
        self.urls = urls


class _Pages(DataSourceReader):
    transport: Transport = staticmethod(http)

    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.workers = int(options.get("max_workers", 5))
        self.timeout, self.attempts, self.delay = float(options.get("timeout", 15)), int(options.get("retry_attempts", 2)), float(options.get("delay", 1.0))

    def partitions(self):
        dealt: dict[int, list[str]] = {}
        for u in self.urls:
            dealt.setdefault(zlib.crc32(urlsplit(u).netloc.encode()) % self.workers, []).append(u)
        return [_Urls(u) for u in dealt.values()] or [_Urls([])]

    def read(self, partition) -> Iterator[tuple]:
        limiter = Limiter(self.delay)
        for u in partition.urls:
            yield tuple(fetch(u, limiter, self.transport, self.timeout, self.attempts).values())
