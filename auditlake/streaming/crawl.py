"""A crawl as a stream that feeds itself: what pages lead to arrives as files, keyed state says what is new, and what the new URLs lead
to is written as files again.

The state of a URL is its depth, whether a sitemap names it and whether it was admitted; it is kept by RocksDB, in the checkpoint, so a
restarted crawl goes on where it was. A timer drops it when files have come that are `keep` younger than the one that first named the
URL. Each run takes all files that the one
before it left, so runs are the levels of a breadth-first crawl, and a URL's depth is that of the first level that named it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditlake.operators.crawl import allowed

FOUND = "url string, depth int, in_sitemap boolean, admitted boolean"
KEEP = "1 day"
#: fresh: the URL is new; else a sitemap has named a URL that is known.
TOLD = "url string, depth int, in_sitemap boolean, fresh boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seen(StatefulProcessor):
    """One row for each admitted URL that is new, and one if a sitemap names it later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "depth int, in_sitemap boolean, admitted boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802
        arrived = list(rows)
        depth, mapped, admitted = min(r.depth for r in arrived), any(r.in_sitemap for r in arrived), any(r.admitted for r in arrived)
        if not self.known.exists():
            self.known.update((depth, mapped, admitted))
            self.handle.registerTimer(max(r.arrived_ms for r in arrived))  # the watermark comes there `keep` later
            if admitted:
                yield Row(url=key[0], depth=depth, in_sitemap=mapped, fresh=True)
            return
        was = self.known.get()
        if mapped and not was[1]:
            self.known.update((was[0], True, was[2]))
            if was[2]:
                yield Row(url=key[0], depth=was[0], in_sitemap=True, fresh=False)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:  # noqa: N802
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def new_urls(spark: SparkSession, path: str, keep: str = KEEP) -> DataFrame:
    """TOLD rows of a stream of the FOUND rows that arrive as files; a file's rows are as old as the file."""
    rows = spark.readStream.schema(FOUND).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    aged = rows.withWatermark("arrived", keep).withColumn("arrived_ms", F.unix_millis("arrived"))
    return aged.groupBy("url").transformWithState(Seen(), TOLD, "Update", "EventTime")


class StreamCrawl:
    """root: a folder that all nodes see: found/ has what is still to be looked at, told/ what was admitted, checkpoint/ the state.

    expand: (new URLs as url, depth) to (url, in_sitemap) of what they lead to, as a batch: a fetch and a parse, or a join."""

    def __init__(self, spark: SparkSession, root: str, main: str, expand: Callable[[DataFrame], DataFrame], subdomains: bool = False, limit: int = 20000, keep: str = KEEP):
        self.spark, self.root, self.main, self.expand, self.subdomains, self.limit, self.keep = spark, root.rstrip("/"), main, expand, subdomains, limit, keep
        self.last = 0

    def feed(self, rows: DataFrame, name: str = "") -> None:
        """Let URLs(url, depth, in_sitemap) arrive."""
        admitted = allowed(F.col("url"), self.main, self.subdomains).alias("admitted")
        rows.select("url", F.col("depth").cast("int"), "in_sitemap", admitted).write.mode("overwrite").parquet(f"{self.root}/found/{name or uuid.uuid4().hex}")

    def _level(self, told: DataFrame, batch: int) -> None:
        """A run's rows: kept, and what the new ones lead to goes back. Both are folders of the batch, so a repeated batch replaces
        what it wrote before."""
        path = f"{self.root}/told/batch-{batch}"
        told.write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema(TOLD).parquet(path)
        fresh = kept.where("fresh").select("url", "depth")
        self.last += (n := fresh.count())
        if n and self.told().where("fresh").count() < self.limit:
            led = self.expand(fresh).select("url", (F.lit(1) + F.lit(self._depth(fresh))).alias("depth"), F.coalesce("in_sitemap", F.lit(False)).alias("in_sitemap")).distinct()
            self.feed(led, f"batch-{batch}")
        elif n:
            self.last = 0

    @staticmethod
    def _depth(fresh: DataFrame) -> int:
        return fresh.agg(F.max("depth")).first()[0]

    def told(self) -> DataFrame:
        return self.spark.read.schema(TOLD).parquet(f"{self.root}/told/*")

    def run(self) -> DataFrame:
        """(url, depth, in_sitemap) of every URL that is admitted, when nothing new arrives any more or the limit is met."""
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)
        try:
            while True:
                self.last = 0
                query = new_urls(self.spark, f"{self.root}/found/*", self.keep).writeStream.outputMode("update").foreachBatch(self._level)
                query.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
                if not self.last:
                    break
        finally:
            if before is None:
                self.spark.conf.unset(PROVIDER)
            else:
                self.spark.conf.set(PROVIDER, before)
        return self.told().groupBy("url").agg(F.min("depth").alias("depth"), F.bool_or("in_sitemap").alias("in_sitemap"))
