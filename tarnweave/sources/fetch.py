"""Fetching pages into the table that crawls read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.session import ship

#: What a fetch gives: status, content type, HTML; all null if it failed.
Response = tuple[int | None, str | None, str | None]
SNAPSHOT = "url string, status long, content_type string, html string"
AGENT = "tarnweave"


def http_get(url: str, timeout: float, max_bytes: int) -> Response:
    """One request; a body of more than `max_bytes` bytes, an error or a timeout gives nulls."""
    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:  # noqa: S310
            body = r.read(max_bytes + 1)
            if len(body) > max_bytes:
                return None, None, None
            return r.status, r.headers.get("Content-Type"), body.decode(r.headers.get_content_charset() or "utf-8", "replace")
    except Exception:
        return None, None, None


def fetch_pages(urls: DataFrame, *, get: Callable[[str, float, int], Response] = http_get, timeout: float = 10.0, max_bytes: int = 2_000_000, workers: int = 5, url_col: str = "url") -> DataFrame:
    """`url, status, content_type, html` of the distinct `urls`, fetched by `workers` threads a task; write it before use, as it is fetched anew each time it is read.

    `get` may be any function of URL, timeout and greatest size; one that raises counts as a failed fetch. Null URLs are left out.
    """
    ship(urls.sparkSession)

    def one(url: str) -> Response:
        try:
            return get(url, timeout, max_bytes)
        except Exception:
            return None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                names = batch.column(0).to_pylist()
                found = list(pool.map(one, names))
                columns = [pa.array(names, pa.string()), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["url", "status", "content_type", "html"])

    return urls.select(url_col).where(urls[url_col].isNotNull()).distinct().mapInArrow(run, SNAPSHOT)
