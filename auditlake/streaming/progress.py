"""Live progress of streaming audits: metrics that Spark gathers while the rows pass, published to subscribers.

The counts are observed metrics of the stream's own plan, so no row is read again for them. A listener turns each trigger's
metrics, and the query's end, into messages of the query's topic."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PAGES, ISSUES = "pages", "issues"


class Broker:
    """Topics and their subscribers. A subscriber whose callback fails is dropped; the others get the message all the same."""

    def __init__(self):
        self._lock, self._subscribers = threading.Lock(), defaultdict(dict)
        self._next = 0

    def subscribe(self, topic: str, callback: Callable[[dict], None]) -> int:
        with self._lock:
            self._next += 1
            self._subscribers[topic][self._next] = callback
            return self._next

    def unsubscribe(self, topic: str, subscription: int) -> None:
        with self._lock:
            self._subscribers[topic].pop(subscription, None)

    def publish(self, topic: str, message: dict) -> int:
        """The number of subscribers that took the message."""
        with self._lock:
            held = list(self._subscribers[topic].items())
        taken = 0
        for subscription, callback in held:
            try:
                callback(message)
                taken += 1
            except Exception:  # noqa: BLE001  whatever a subscriber does, the crawl goes on
                self.unsubscribe(topic, subscription)
        return taken


def observed_pages(records: DataFrame) -> DataFrame:
    """Page records whose numbers are told as they pass."""
    return records.observe(
        PAGES,
        F.count("*").alias("pages"),
        F.count_if(F.col("status_code").between(200, 299)).alias("ok"),
        F.count_if("noindex").alias("noindex"),
        F.max("depth").alias("depth"),
    )


def observed_issues(issues: DataFrame) -> DataFrame:
    return issues.observe(ISSUES, F.count("*").alias("issues"))


class Progress(StreamingQueryListener):
    """Messages of the queries that have a name, which is their topic: pages and issues since the query's start, and the end with the
    error, if any."""

    def __init__(self, broker: Broker):
        self.broker = broker
        self.names: dict[str, str] = {}
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name:
            self.names[str(event.runId)] = event.name
            self.totals[str(event.runId)] = defaultdict(int)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        if run not in self.names:
            return
        totals = self.totals[run]
        for name, row in event.progress.observedMetrics.items():
            if name not in (PAGES, ISSUES):
                continue
            for k, v in row.asDict().items():
                totals[k] = max(totals[k], v or 0) if k == "depth" else totals[k] + (v or 0)
            if row[name]:
                fields = ("pages", "ok", "noindex", "depth") if name == PAGES else ("issues",)
                self.broker.publish(self.names[run], {"name": name, **{k: totals[k] for k in fields}})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        if run in self.names:
            self.broker.publish(self.names.pop(run), {"name": "end", "error": event.exception, **self.totals.pop(run)})


def publish_progress(spark: SparkSession, broker: Broker) -> Progress:
    """Tell the broker of this session's queries from now on; spark.streams.removeListener() ends it."""
    listener = Progress(broker)
    spark.streams.addListener(listener)
    return listener
