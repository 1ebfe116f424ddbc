"""A data source that fetches pages over HTTP, at once or as a stream."""

from __future__ import annotations

import datetime as dt
import re
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .. import schemas

# What a link looks like in a page, and the beginnings of those that are no pages.
HREF = re.compile(r"href=[\"']([^\"'>]+)[\"']", re.I)
NO_PAGE = ("javascript:", "mailto:", "tel:", "#", "data:")
#: Seconds for a page and for its connection, and bytes of it, by default.
TIMEOUT, CONNECT_TIMEOUT, MOST_BYTES = 30.0, 10.0, 64_000_000


class _Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class PageSource(DataSource):
    """``spark.read.format("pages")``: options ``urls`` (one a line), ``agent``, ``delay_ms``, ``timeout``, ``connect_timeout``, ``most_bytes``, ``parallel``, ``depth``.

    Every URL gives a row.  What goes wrong is in ``error``: pages that are no
    HTML or too large, timeouts (status 0) and failed connections.  With
    ``readStream`` the URLs are fetched in their order, all in one batch, or
    ``per_batch`` at a time.  A run over what is available takes one batch.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return schemas.PAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


class _Fetcher:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]

    def dealt(self, urls: list[str]) -> list[InputPartition]:
        n = max(1, min(len(urls), int(self.options.get("parallel", "5"))))
        return [_Urls(urls[k::n]) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = self.options.get
        delay = int(get("delay_ms", "0")) / 1000
        for url in partition.urls:
            yield fetch(url, get("agent", "lexmill"), float(get("timeout", TIMEOUT)), int(get("depth", "0")), float(get("connect_timeout", CONNECT_TIMEOUT)), int(get("most_bytes", MOST_BYTES)))
            if delay:
                time.sleep(delay)


class _Reader(_Fetcher, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(self.urls)


class _StreamReader(_Fetcher, DataSourceStreamReader):
    """An offset is the number of URLs that have been fetched."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.at = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(len(self.urls), self.at + int(self.options.get("per_batch") or len(self.urls)))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["at"])  # after a restart, go on from there
        return self.dealt(self.urls[start["at"] : end["at"]])

    def commit(self, end: dict) -> None:
        pass


def links_of(html: str, base: str) -> list[str]:
    """A page's distinct links to pages, made absolute and normalized, in order."""
    found: dict[str, None] = {}
    for href in HREF.findall(html):
        if href.startswith(NO_PAGE):
            continue
        try:
            parts = urlsplit(urljoin(base, href))
        except ValueError:
            continue
        if parts.scheme in ("http", "https"):
            path = re.sub(r";[^/]*$", "", parts.path)
            query = f"?{parts.query}" if parts.query else ""
            found[f"{parts.scheme}://{parts.netloc}{path}{query}".rstrip("/")] = None
    return list(found)


def _body(r, deadline: float, most: int) -> bytes:  # noqa: ANN001
    """What a response holds, if it comes in time and is not larger than ``most``."""
    parts, size = [], 0
    while part := r.read1(1 << 16):
        parts.append(part)
        size += len(part)
        if size > most:
            raise ValueError(f"Larger than {most} bytes")
        if time.monotonic() > deadline:
            raise TimeoutError
    return b"".join(parts)


def fetch(url: str, agent: str, timeout: float = TIMEOUT, depth: int = 0, connect_timeout: float = CONNECT_TIMEOUT, most: int = MOST_BYTES) -> tuple:
    """One page as a row of the page schema."""
    now = dt.datetime.now(dt.timezone.utc)
    deadline = time.monotonic() + timeout
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=min(timeout, connect_timeout)) as r:
            kind, final, status = r.headers.get("Content-Type") or "", r.geturl(), r.status
            charset = r.headers.get_content_charset() or "utf-8"
            if "text/html" not in kind.lower():
                return (final, status, "", kind, 0, now, depth, [], f"Non-HTML content: {kind}")
            body = _body(r, deadline, most)
    except urllib.error.HTTPError as e:
        return (url, e.code, "", e.headers.get("Content-Type") or "", 0, now, depth, [], str(e))
    except (TimeoutError, socket.timeout):
        return (url, 0, "", "", 0, now, depth, [], "Timeout")
    except (urllib.error.URLError, OSError, ValueError) as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        return (url, 0, "", "", 0, now, depth, [], "Timeout" if late else str(e))
    try:
        text = body.decode(charset, "replace")
    except LookupError:  # a charset that nobody knows
        text = body.decode("utf-8", "replace")
    return (final, status, text, kind, len(text), now, depth, links_of(text, final), None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
