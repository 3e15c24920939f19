"""An HTTP interface as a source: ranges of titles are fetched by tasks that share one rate; a stream fetches the titles that a list gains."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .staging import ship

SCHEMA = "place bigint, title string, status string, body string, tries int"
#: Retries after the first try, and the exponent up to which the wait doubles.
RETRIES, MOST_DOUBLINGS = 8, 6


def fetch(url: str, retries: int, unit: float, turn: Callable[[], None]) -> tuple[str, str | None, int]:
    """(status, body, tries): ok, missing (404, and nothing else) or error, once the retries are used up. ``turn`` waits for the next request's turn.

    A 429 waits as long as its Retry-After says, and at least as every other failure: ``unit`` seconds, doubled with each try.
    """
    for attempt in range(retries + 1):
        turn()
        asked = 0.0
        try:
            with urllib.request.urlopen(url, timeout=30) as reply:  # noqa: S310  the caller names the service
                return "ok", reply.read().decode("utf-8", "replace"), attempt + 1
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return "missing", None, attempt + 1
            if e.code == 429:
                try:
                    asked = float(e.headers.get("Retry-After") or 0)
                except ValueError:
                    asked = 0.0
            elif e.code < 500:
                return "error", None, attempt + 1
        except (urllib.error.URLError, OSError):
            pass
        if attempt < retries:
            time.sleep(max(asked, unit * 2 ** min(attempt, MOST_DOUBLINGS)))
    return "error", None, retries + 1


def _lines(path: str, first: int = 0, last: int | None = None) -> Iterator[str]:
    """The lines that are not blank, from ``first`` on and before ``last``."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with files.open_input_stream(at) as f:
        rest, n = b"", 0
        while True:
            chunk = f.read(1 << 20)
            *whole, rest = (rest + chunk).split(b"\n") if chunk else (rest, b"")
            for line in whole:
                if line.strip():
                    if last is not None and n >= last:
                        return
                    if n >= first:
                        yield line.decode("utf-8", "replace").strip()
                    n += 1
            if not chunk:
                return


@dataclass
class Titles(InputPartition):
    first: int
    last: int
    share: float  # requests a second


class _Fetcher:
    def __init__(self, options):
        self.url, self.titles = options["url"], options["titles"]
        self.tasks, self.rate = int(options.get("tasks", 4)), float(options.get("rate", 10))
        self.retries, self.unit = int(options.get("retries", RETRIES)), float(options.get("unit", 1.0))

    def split(self, first: int, last: int) -> list[Titles]:
        """As many ranges as tasks; each has its part of the rate, so all of them together never exceed it."""
        n = max(1, min(self.tasks, last - first))
        edges = [first + (last - first) * i // n for i in range(n + 1)]
        return [Titles(a, b, self.rate / n) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def read(self, part: Titles | None) -> Iterator[tuple]:
        if part is None:
            return
        due = 0.0

        def turn() -> None:
            nonlocal due
            now = time.monotonic()
            if now < due:
                time.sleep(due - now)
            due = max(now, due) + 1 / part.share

        for i, title in enumerate(_lines(self.titles, part.first, part.last)):
            yield part.first + i, title, *fetch(self.url.replace("{title}", urllib.parse.quote(title, safe="")), self.retries, self.unit, turn)


class ApiReader(_Fetcher, DataSourceReader):
    def partitions(self) -> list[Titles]:
        return self.split(0, sum(1 for _ in _lines(self.titles)))


class ApiStream(_Fetcher, DataSourceStreamReader):
    """The offset is the number of titles done."""

    def initialOffset(self) -> dict:
        return {"titles": 0}

    def latestOffset(self) -> dict:
        return {"titles": sum(1 for _ in _lines(self.titles))}

    def partitions(self, start: dict, end: dict) -> list[Titles]:
        return self.split(start["titles"], end["titles"])


class Api(DataSource):
    """format("api"): url (with {title}), titles (a file of lines, which may grow at its end), tasks, rate (requests a second of all tasks), retries, unit."""

    @classmethod
    def name(cls) -> str:
        return "api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ApiReader:
        return ApiReader(self.options)

    def streamReader(self, schema) -> ApiStream:
        return ApiStream(self.options)


def _options(options: dict) -> dict:
    return {k: str(v) for k, v in options.items()}


def read_api(spark: SparkSession, url: str, titles: str, **options) -> DataFrame:
    """SRC12, CLS4: place, title, status (ok, missing, error), body, tries. A failure is never a missing page."""
    ship(spark)
    spark.dataSource.register(Api)
    return spark.read.format("api").options(url=url, titles=titles, **_options(options)).load()


def stream_api(spark: SparkSession, url: str, titles: str, **options) -> DataFrame:
    """The same as a stream: a restart goes on behind the last title of the last batch."""
    ship(spark)
    spark.dataSource.register(Api)
    return spark.readStream.format("api").options(url=url, titles=titles, **_options(options)).load()
