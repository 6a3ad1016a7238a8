"""URL search by an inverted index: a posting for each word of each crawled URL, in buckets by the word's hash, sorted by word.

A search reads the buckets of its words, and of those the row groups that hold them; not the pages. Beside the postings lie the
words' document counts, for an order by relevance. A word that most URLs have is spread over SALTS files of its bucket."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.reports import PAGE_SIZE, STOPWORDS, tokens

BUCKETS, SALTS = 64, 8
POSTING = "crawl_id long, token string, id long, url string, bucket int"
TERM = "crawl_id long, token string, documents long"


def words(term: str) -> list[str]:
    """The words of a search term, as tokens() has those of a URL."""
    return sorted({w for w in re.split(r"[^\w]+", term.lower()) if len(w) >= 3 and w not in STOPWORDS})


def postings(pages: DataFrame) -> DataFrame:
    """POSTING rows of pages(crawl_id, id, url, crawled)."""
    each = pages.where("crawled").select("crawl_id", F.explode(F.array_distinct(tokens(F.col("url")))).alias("token"), "id", "url")
    return each.withColumn("bucket", F.pmod(F.crc32("token"), F.lit(BUCKETS)).cast("int"))


def write_index(pages: DataFrame, path: str) -> None:
    """Postings and document counts of all crawled pages, below a folder that does not exist yet."""
    rows = postings(pages)
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS))
    dealt = rows.repartition("bucket", salt).sortWithinPartitions("bucket", "crawl_id", "token", "url")
    dealt.write.option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{path}/postings")
    counts = rows.groupBy("crawl_id", "token").agg(F.count("*").alias("documents"))
    counts.repartitionByRange("crawl_id", "token").sortWithinPartitions("crawl_id", "token").write.parquet(f"{path}/terms")


def _of(spark: SparkSession, path: str, term: str, crawl_id: int | None) -> DataFrame:
    found = words(term)
    rows = spark.read.schema(POSTING).parquet(f"{path}/postings")
    rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in found})) & F.col("token").isin(found))
    return rows if crawl_id is None else rows.where(F.col("crawl_id") == crawl_id)


def _exact(term: str) -> Column:
    return (F.col("url") == term).desc()


def search(spark: SparkSession, path: str, term: str, crawl_id: int | None = None, by_relevance: bool = False) -> DataFrame:
    """(crawl_id, id, url, score) of the pages whose URL has a word of the term, an exact URL first, then by URL, or by relevance: the
    sum over the words of ln(1 + pages of the crawl with the commonest of them / pages with the word)."""
    rows = _of(spark, path, term, crawl_id)
    counts = spark.read.schema(TERM).parquet(f"{path}/terms").where(F.col("token").isin(words(term)))
    most = counts.groupBy("crawl_id").agg(F.max("documents").alias("most"))
    weighed = counts.join(most, "crawl_id").select("crawl_id", "token", F.log1p(F.col("most") / F.col("documents")).alias("weight"))
    # a row for each word of the term and crawl
    found = rows.join(F.broadcast(weighed) if crawl_id is not None else weighed, ["crawl_id", "token"]).groupBy("crawl_id", "id", "url").agg(F.sum("weight").alias("score"))
    return found.orderBy(_exact(term), *([F.desc("score")] if by_relevance else []), "url", "id")


def page_count(spark: SparkSession, path: str, term: str, crawl_id: int | None = None) -> DataFrame:
    """Pages of a listing of what a term finds: from its postings alone."""
    found = _of(spark, path, term, crawl_id).select("crawl_id", "id").distinct()
    return found.agg(F.ceil(F.count("*") / PAGE_SIZE).alias("pages"))
