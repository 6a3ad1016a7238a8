"""HTTP source: URLs to response rows, fetched in the tasks.

The source is a Python data source, `http`: it reads a folder of Parquet files that name what to ask for, a file a partition. All
URLs of a host lie in one file, so a task keeps the time of each of its hosts: between the starts of two requests to one host lie
`delay` seconds at least, and a random time of up to `jitter` seconds more, while other hosts are asked meanwhile. A task looks
AHEAD rows ahead for a host whose turn it is, so its memory does not grow with the folder.

A request follows no redirect, ends after `timeout` seconds, and reads at most 10 MiB of a body. Credentials go only to the hosts
that they are for. A transport error is a row with timeout set, status 0 and no body."""

from __future__ import annotations

import base64
import heapq
import http.client
import json
import random
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditlake.functions import urls as url_functions
from auditlake.functions.shared import shared_dir
from auditlake.sources.html import MOST_BODY, RESPONSE, decode


@dataclass(frozen=True)
class Client:
    agent: str = "auditlake"
    timeout: float = 10.0
    user: str = ""
    password: str = ""
    auth_hosts: tuple[str, ...] = ()
    delay: float = 0.25
    jitter: float = 0.25
    tasks: int = 0

    def ask(self, method: str, url: str) -> dict:
        """status_code, headers, body, content_length, ttfb in whole milliseconds (rounded up) and timeout of one request."""
        out = {"status_code": 0, "headers": {}, "body": None, "content_length": 0, "ttfb": 0, "timeout": True}
        connection = None
        try:
            parts = urlsplit(url)
            kind = {"http": http.client.HTTPConnection, "https": http.client.HTTPSConnection}[parts.scheme]
            headers = {"User-Agent": self.agent}
            if self.user and parts.netloc in self.auth_hosts:
                headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
            connection = kind(parts.netloc, timeout=self.timeout)
            began = time.monotonic()
            connection.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
            answer = connection.getresponse()
            ttfb = -int(-(time.monotonic() - began) * 1000 // 1)
            body = answer.read(MOST_BODY)
            found: dict[str, list[str]] = {}
            for k, v in answer.getheaders():
                found.setdefault(k, []).append(v)
            size = answer.getheader("Content-Length") or ""
            out |= {"status_code": answer.status, "headers": found, "body": body, "content_length": int(size) if size.isdigit() else 0, "ttfb": ttfb, "timeout": False}
        except (OSError, http.client.HTTPException, ValueError, KeyError):
            pass
        finally:
            if connection:
                connection.close()
        return out


#: Rows that a task looks ahead for another host.
AHEAD = 10_000


def polite(rows: Iterator[dict], ask: Callable[[dict], dict], delay: float, jitter: float, clock=time.monotonic, sleep=time.sleep) -> Iterator[dict]:
    """ask(row) of every row(host, ..), each host at its pace: the host whose time comes first is next."""
    waiting: dict[str, deque] = {}
    turns: list[tuple[float, int, str]] = []  # (time, a number against ties, host)
    last: dict[str, float] = {}
    held, number = 0, 0
    rows = iter(rows)
    while True:
        while held < AHEAD and (row := next(rows, None)) is not None:
            host = row["host"] or ""
            if host not in waiting:
                waiting[host] = deque()
                heapq.heappush(turns, (last.get(host, 0.0), number, host))
                number += 1
            waiting[host].append(row)
            held += 1
        if not turns:
            return
        due, _, host = heapq.heappop(turns)
        if (pause := due - clock()) > 0:
            sleep(pause)
        last[host] = clock() + delay + random.uniform(0, jitter)
        yield ask(waiting[host].popleft())
        held -= 1
        if waiting[host]:
            heapq.heappush(turns, (last[host], number, host))
            number += 1
        else:
            del waiting[host]
            if not delay and not jitter:
                del last[host]


@dataclass
class Bucket(InputPartition):
    """One file of the folder."""

    path: str


class HttpReader(DataSourceReader):
    def __init__(self, path: str, client: Client):
        self.path, self.client = path, client

    def partitions(self) -> list[Bucket]:
        files, name = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(name))
        return [Bucket(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".parquet")]

    def ask(self, row: dict) -> dict:
        got = self.client.ask("GET", row["url"])
        kind = next((v[0] for k, v in got["headers"].items() if k.lower() == "content-type" and v), "")
        got["body"] = decode(got["body"], kind) if got["body"] is not None else None
        got["headers"] = list(got["headers"].items())
        return {k: row[k] for k in ("crawl_id", "url", "depth", "in_sitemap")} | got | {"robotstxt_blocked": False}

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.path) as held:
            rows = (r for batch in parquet.ParquetFile(held).iter_batches(1000) for r in batch.to_pylist())
            for got in polite(rows, self.ask, self.client.delay, self.client.jitter):
                yield pa.RecordBatch.from_pylist([got], ARROW)  # a body can be large, so each goes on alone


class HttpSource(DataSource):
    """spark.read.format("http").option("path", folder).load(): RESPONSE rows of the folder's (crawl_id, url, depth, in_sitemap,
    host), one GET each. client: a Client as JSON."""

    @classmethod
    def name(cls) -> str:
        return "http"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: T.StructType) -> HttpReader:
        given = json.loads(self.options.get("client", "{}"))
        return HttpReader(self.options["path"], Client(**given | {"auth_hosts": tuple(given.get("auth_hosts", ()))}))


ARROW = pa.schema(
    [
        ("crawl_id", pa.int64()), ("url", pa.string()), ("status_code", pa.int32()), ("headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("body", pa.string()),
        ("content_length", pa.int64()), ("ttfb", pa.int32()), ("depth", pa.int32()), ("in_sitemap", pa.bool_()), ("robotstxt_blocked", pa.bool_()), ("timeout", pa.bool_()),
    ]
)
_registered: set[int] = set()


def fetch(asked: DataFrame, client: Client = Client()) -> DataFrame:
    """RESPONSE rows of asked(crawl_id, url, depth, in_sitemap), one GET each."""
    spark = asked.sparkSession
    if id(spark) not in _registered:
        spark.dataSource.register(HttpSource)
        _registered.add(id(spark))
    path = shared_dir(spark, "asked")
    rows = asked.select("crawl_id", "url", "depth", "in_sitemap", url_functions.authority(F.col("url")).alias("host"))
    # hosts in a random order, so that those of a task take turns
    dealt = rows.repartition(client.tasks or spark.sparkContext.defaultParallelism, "host").sortWithinPartitions(F.xxhash64("url"))
    dealt.write.parquet(path)
    return spark.read.format("http").option("path", path).option("client", json.dumps(asdict(client))).load()


def statuses(urls: DataFrame, client: Client = Client()) -> DataFrame:
    """(url, status_code) by one HEAD for each distinct URL of urls(url); -1 where there is no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [client.ask("HEAD", u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1 if x["timeout"] else x["status_code"] for x in found], pa.int32())], ["url", "status_code"])

    return urls.select("url").where("url IS NOT NULL").distinct().mapInArrow(run, "url string, status_code int")


def with_external_status(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages with the status of each external link filled in from known(url, status_code); the links keep their order."""
    one = pages.select("crawl_id", "url", F.posexplode("external_links").alias("at", "link"))
    filled = one.join(known.select(F.col("url").alias("asked"), F.col("status_code").alias("told")), F.col("link.url") == F.col("asked"), "left")
    link = F.col("link").withField("status_code", F.coalesce("told", F.lit(-1)))
    lists = filled.groupBy("crawl_id", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", link.alias("link")))), lambda x: x["link"]).alias("told_links"))
    return pages.join(lists, ["crawl_id", "url"], "left").withColumn(
        "external_links",
        F.coalesce("told_links", "external_links"),
    ).drop("told_links").select(*pages.columns)
