"""Paged endpoints as a Spark data source: each partition requests its share of the pages through a cache."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

# Responses that are worth another try.
RETRIED = (429, 500, 502, 503, 504)
#: What a request gives: where its body came from is network, cache, stale (the cache, as the server failed), missing (404) or failed.
SCHEMA = "url string, offset long, status int, origin string, fetched_at string, attempts int, bytes long, body string, error string"


@dataclass(frozen=True)
class EndpointOptions:
    """How a client behaves; quota requests in any window seconds and one every interval seconds hold for all partitions.

    Partitions don't see each other, so each of `lanes` has its share of both: a lane spaces its requests lanes times as
    wide and sends quota / lanes in a window.  A quota below the lanes makes fewer lanes.
    """

    cache: str | None = None
    refresh: bool = False
    interval: float = 0.0
    quota: int | None = None
    window: float = 60.0
    lanes: int = 4
    retries: int = 4
    timeout: float = 30.0
    backoff: float = 2.0
    #: Without a body to give, fail the job; else the row says what went wrong.
    strict: bool = True
    agent: str = "gridspark"

    def shared(self, pages: int) -> EndpointOptions:
        """The options of one lane when so many pages are requested."""
        lanes = max(1, min(self.lanes, pages, self.quota or self.lanes))
        return EndpointOptions(**{**self.__dict__, "lanes": lanes, "interval": self.interval * lanes, "quota": self.quota // lanes if self.quota else None})


class Limiter:
    """Waits so that requests keep a least spacing and at most a quota in any window."""

    def __init__(self, interval: float, quota: int | None, window: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.interval, self.quota, self.window, self.clock, self.sleep = interval, quota, window, clock, sleep
        self.recent: deque[float] = deque(maxlen=quota or 1)

    def wait(self) -> None:
        now = self.clock()
        due = self.recent[-1] + self.interval if self.recent else now
        if self.quota and len(self.recent) == self.quota:
            due = max(due, self.recent[0] + self.window)
        if due > now:
            self.sleep(due - now)
        self.recent.append(max(due, self.clock()))


class ResponseCache:
    """Bodies and records of responses in a folder that all executors reach (any URI that Arrow's file systems open)."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.files.create_dir(self.root, recursive=True)

    def _paths(self, url: str) -> tuple[str, str]:
        key = hashlib.sha256(url.encode()).hexdigest()[:32]
        return f"{self.root}/{key}.json", f"{self.root}/{key}.meta.json"

    def get(self, url: str) -> tuple[str, dict] | None:
        try:
            body, meta = (self.files.open_input_file(p).read().decode() for p in self._paths(url))
        except FileNotFoundError:
            return None
        return body, json.loads(meta)

    def put(self, url: str, body: bytes, meta: dict) -> None:
        """Both files are written beside their place and moved to it, the record last: readers see whole responses."""
        for path, data in zip(self._paths(url), (body, json.dumps(meta).encode())):
            part = f"{path}.{time.monotonic_ns()}.part"
            with self.files.open_output_stream(part) as f:
                f.write(data)
            self.files.move(part, path)


def retry_after(value: str | None, now: datetime | None = None) -> float:
    """Seconds that a Retry-After header asks for, given as a number or as a date; 0 if it says nothing."""
    if not value:
        return 0.0
    try:
        return max(float(value), 0.0)
    except ValueError:
        pass
    try:
        return max((parsedate_to_datetime(value) - (now or datetime.now(UTC))).total_seconds(), 0.0)
    except (TypeError, ValueError):
        return 0.0


class Client:
    """One lane's requests: read-through cache, limiter, retries, and the cache once more if the server fails."""

    def __init__(self, options: EndpointOptions, sleep: Callable[[float], None] = time.sleep) -> None:
        self.options, self.sleep = options, sleep
        self.limiter = Limiter(options.interval, options.quota, options.window, sleep=sleep)
        self.cache = ResponseCache(options.cache) if options.cache else None

    def get(self, url: str, offset: int = 0) -> tuple:
        """A row of SCHEMA."""
        o, error, status, attempts = self.options, None, None, 0
        held = self.cache.get(url) if self.cache else None
        if held and not o.refresh:
            return (url, offset, held[1]["status"], "cache", held[1]["fetched_at"], 0, held[1]["bytes"], held[0], None)
        for attempts in range(1, o.retries + 1):
            self.limiter.wait()
            pause = o.backoff * attempts
            try:
                request = urllib.request.Request(url, headers={"User-Agent": o.agent, "Accept": "application/json"})
                with urllib.request.urlopen(request, timeout=o.timeout) as response:
                    body = response.read()
                    json.loads(body)  # a body that is no JSON is a failed attempt, and is not cached
                    meta = {"url": url, "fetched_at": datetime.now(UTC).isoformat(), "status": response.status, "bytes": len(body)}
                if self.cache:
                    self.cache.put(url, body, meta)
                return (url, offset, meta["status"], "network", meta["fetched_at"], attempts, len(body), body.decode(), None)
            except urllib.error.HTTPError as e:
                status, error = e.code, f"HTTP {e.code}"
                if e.code == 404:
                    return (url, offset, 404, "missing", None, attempts, 0, None, error)
                if e.code not in RETRIED:
                    break
                pause = retry_after(e.headers.get("Retry-After")) or pause
            except (OSError, ValueError) as e:
                status, error = None, f"{type(e).__name__}: {e}"
            if attempts < o.retries:
                self.sleep(pause)
        if held:
            return (url, offset, held[1]["status"], "stale", held[1]["fetched_at"], attempts, held[1]["bytes"], held[0], error)
        if o.strict:
            raise RuntimeError(f"no response from {url} after {attempts} attempts: {error}")
        return (url, offset, status, "failed", None, attempts, 0, None, error)


def _at(body: str, path: str):
    """The value at a dotted path of a JSON text; None where there is none."""
    value = json.loads(body)
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


@dataclass
class Pages(InputPartition):
    """One lane: its options, urls by offset, and the first page if it was already read."""

    lane: EndpointOptions
    pages: tuple[tuple[int, str], ...]
    first: tuple | None = None


def page_url(url: str, limit: int, offset: int) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urlencode({'limit': limit, 'offset': offset})}"


class EndpointReader(DataSourceReader):
    """The first page says how many there are; the others are dealt to lanes."""

    def __init__(self, url: str, limit: int, total: str | None, options: EndpointOptions) -> None:
        self.url, self.limit, self.total, self.options = url, limit, total, options

    def partitions(self) -> list[Pages]:
        if self.total is None:
            return [Pages(self.options.shared(1), ((0, self.url),))]
        row = Client(self.options.shared(1)).get(page_url(self.url, self.limit, 0))
        try:
            total = int(_at(row[7], self.total)) if row[7] else 0
        except (TypeError, ValueError):
            total = 0
        pages = [(o, page_url(self.url, self.limit, o)) for o in range(self.limit, total, self.limit)]
        lane = self.options.shared(len(pages) or 1)
        return [Pages(lane, (), row), *[Pages(lane, tuple(pages[k :: lane.lanes])) for k in range(lane.lanes) if pages]]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if partition.first is not None:
            yield partition.first
        if partition.pages:
            client = Client(partition.lane)
            for offset, url in partition.pages:
                yield client.get(url, offset)


class EndpointSource(DataSource):
    """spark.read.format("paged_endpoint"): url, and as options what EndpointOptions has, limit and total (the dotted path
    of the number of records in a response; without it one request is made)."""

    @classmethod
    def name(cls) -> str:
        return "paged_endpoint"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EndpointReader:
        given, kinds = {k.lower(): v for k, v in self.options.items()}, {"int": int, "float": float, "bool": lambda x: str(x).lower() == "true", "str": str}
        known = {n: kinds[f.type.split(" |")[0]](given[n]) for n, f in EndpointOptions.__dataclass_fields__.items() if n in given}
        if "url" not in given:
            raise ValueError("paged_endpoint needs a url")
        return EndpointReader(given["url"], int(given.get("limit", 100)), given.get("total"), EndpointOptions(**known))


def read_endpoint(spark: SparkSession, url: str, limit: int = 100, total: str | None = None, options: EndpointOptions = EndpointOptions()) -> DataFrame:
    """The pages of an endpoint as rows of SCHEMA, one a page; a missing endpoint (404) gives one row without a body.

    A page that neither the server nor the cache gives fails the job, or is a row with its error if strict is off.
    """
    ship_package(spark)
    spark.dataSource.register(EndpointSource)
    reader = spark.read.format("paged_endpoint").option("url", url).option("limit", limit)
    reader = reader.option("total", total) if total else reader
    for name, value in options.__dict__.items():
        reader = reader.option(name, value) if value is not None else reader
    return reader.load()


def landed(pages: DataFrame, query: str) -> DataFrame:
    """body, fetched_at, query of the pages that have a body: what the flatten functions of responses take."""
    return pages.where("body IS NOT NULL").select("body", "fetched_at", F.lit(query).alias("query"))


def records(pages: DataFrame, schema: str) -> DataFrame:
    """The records of endpoints that answer with a list: schema's columns, source_url and fetched_at.

    A missing endpoint or an empty list has none; a body that is no list is refused.
    """
    rows = pages.where("body IS NOT NULL").select("url", "fetched_at", "body", F.from_json("body", f"array<struct<{schema}>>").alias("r"))
    listed = F.when(F.ltrim("body").startswith("["), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("no list of records: "), F.col("url"))).cast(rows.schema["r"].dataType))
    return rows.select(F.explode(listed).alias("r"), F.col("url").alias("source_url"), "fetched_at").select("r.*", "source_url", "fetched_at")


def fetch_each(requests: DataFrame, url: str = "url", options: EndpointOptions = EndpointOptions()) -> DataFrame:
    """One row of SCHEMA for each distinct url of a table, dealt to lanes by its hash; offset is 0, NULL urls are left out."""
    ship_package(requests.sparkSession)
    lane = options.shared(1 << 30)

    def work(batches):
        client = Client(lane)
        for pdf in batches:
            rows = [client.get(u) for u in pdf["url"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"status": "Int32"})

    wanted = requests.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct()
    return wanted.repartition(lane.lanes, "url").mapInPandas(work, SCHEMA)
