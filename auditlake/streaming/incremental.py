"""Incremental audit: responses arrive as files, page rules run on each as it comes; relational rules run in a later batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators.page_rules import page_issues
from auditlake.sources.html import RESPONSE, page_records
from auditlake.streaming.progress import observed_issues, observed_pages


def response_stream(spark: SparkSession, path: str, keep: str = "1 day") -> DataFrame:
    """Each URL of a crawl once: the seen-set is streaming state, bounded by time. A file's rows are as old as the file; a URL that
    comes again within `keep` of its first is passed over. A crawl lasts two hours at most, so a day is ample."""
    rows = spark.readStream.schema(RESPONSE).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    return rows.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["crawl_id", "url"]).drop("arrived")


def issue_stream(responses: DataFrame) -> DataFrame:
    """Page issues of the stream; the numbers of pages and issues are observed metrics, which progress.py publishes."""
    return observed_issues(page_issues(observed_pages(page_records(responses)).withColumn("id", F.xxhash64("crawl_id", "url"))))


def write_issues(issues: DataFrame, path: str, checkpoint: str, topic: str | None = None) -> StreamingQuery:
    """All that has arrived, then stop; restarts go on from the checkpoint. topic: the query's name, under which its progress is
    published."""
    to = issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (to.queryName(topic) if topic else to).start()


def progress(responses: DataFrame) -> DataFrame:
    return responses.groupBy("crawl_id").agg(F.count("*").alias("crawled"), F.max("depth").alias("depth"))
