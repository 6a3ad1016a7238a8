"""The audit's tables on disk: written by crawl, published together, and dropped by crawl.

The rows of a save lie in folders of their own, <table>/version=<v>/crawl_id=<c>, which nobody reads until a manifest names them:
_manifests/<n>.json has, for each table, the version that holds each crawl. A save writes all its tables first and then publishes
one manifest more, by a rename that fails if another writer took the number, whose changes are then read and kept. So readers,
who follow the last manifest, see a crawl's old rows or its new ones, in all tables alike, whatever breaks in between; a deletion is
a manifest without the crawl. Folders that only earlier manifests name go later (`vacuum`), so that queries under way can end.

Children carry their page's id; there is no cascade, all tables of a crawl go together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.functions.urls import truncate, url_hash
from auditlake.sources.html import RECORD

#: table -> (array column of the page record, its columns)
CHILDREN = {
    "links": ("links", ["url", "rel", "text", "nofollow", "sponsored", "ugc"]),
    "external_links": ("external_links", ["url", "rel", "text", "nofollow", "sponsored", "ugc", "status_code"]),
    "hreflangs": ("hreflangs", ["url", "lang"]),
    "images": ("images", ["url", "alt"]),
    "videos": ("videos", ["url", "poster"]),
    "scripts": ("scripts", None),
    "styles": ("styles", None),
    "iframes": ("iframes", None),
    "audios": ("audios", None),
}
#: Characters that a stored text has at most.
MOST = {"title": 2048, "description": 2048, "h1": 1024, "h2": 1024, "text": 1024, "alt": 1024}


def _cut(df: DataFrame) -> DataFrame:
    return df.withColumns({c: truncate(F.col(c), n) for c, n in MOST.items() if c in df.columns})


def page_table(records: DataFrame) -> DataFrame:
    """The flat page rows of records with an id."""
    nested = {column for column, _ in CHILDREN.values()} | {"internal_links", "headers", "dom"}
    flat = records.select(*[c for c in records.columns if c not in nested])
    redirect = F.when(F.coalesce(F.col("redirect_url"), F.lit("")) == "", "").otherwise(url_hash(F.col("redirect_url")))
    return _cut(flat.withColumn("url_hash", url_hash(F.col("url"))).withColumn("redirect_hash", redirect))


def child_columns(name: str) -> list[str]:
    """The record's columns that a child table is made of, beside the page's keys."""
    return [CHILDREN[name][0], *["lang"][: name == "hreflangs"]]


def child_table(records: DataFrame, name: str) -> DataFrame:
    """Rows of one child table: pagereport_id, crawl_id, line (its place on the page), and its own columns."""
    column, names = CHILDREN[name]
    of_page = [F.col("url").alias("page_url"), F.col("lang").alias("page_lang")] if name == "hreflangs" else []
    rows = records.select(F.col("id").alias("pagereport_id"), "crawl_id", *of_page, F.posexplode(column).alias("line", "x"))
    if name == "hreflangs":
        return rows.select(
            "pagereport_id",
            "crawl_id",
            "line",
            F.col("page_lang").alias("from_lang"),
            F.col("x.lang").alias("to_lang"),
            F.col("x.url").alias("to_url"),
            url_hash(F.col("page_url")).alias("from_hash"),
            url_hash(F.col("x.url")).alias("to_hash"),
        )
    own = [F.col("x").alias("url")] if names is None else [F.col(f"x.{c}").alias(c) for c in names]
    out = _cut(rows.select("pagereport_id", "crawl_id", "line", *own))
    return out.withColumn("url_hash", url_hash(F.col("url"))) if name == "links" else out


#: table -> crawl -> version
Manifest = dict[str, dict[int, str]]
#: Manifests that stay readable, the last one included.
HISTORY = 2


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, files = _path(spark, f"{root}/_manifests")
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))


def _read_manifest(spark: SparkSession, root: str, number: int) -> Manifest:
    at, files = _path(spark, f"{root}/_manifests/{number}.json")
    held = files.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()
    return {name: {int(c): v for c, v in crawls.items()} for name, crawls in json.loads(text).items()}


def manifest(spark: SparkSession, root: str) -> tuple[int, Manifest]:
    """The last manifest and its number; an empty one, 0, before the first."""
    numbers = _numbers(spark, root)
    return (numbers[-1], _read_manifest(spark, root, numbers[-1])) if numbers else (0, {})


def publish(spark: SparkSession, root: str, change: Callable[[Manifest], None]) -> int:
    """Apply a change to the last manifest and publish the result; the new number. If another writer publishes first, the change is
    applied to theirs."""
    fs = spark._jvm.org.apache.hadoop.fs
    while True:
        number, held = manifest(spark, root)
        change(held)
        draft, files = _path(spark, f"{root}/_manifests/draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        context = fs.FileContext.getFileContext(files.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(draft, _path(spark, f"{root}/_manifests/{number + 1}.json")[0], none)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass()):
                raise
            continue
        return number + 1


def vacuum(spark: SparkSession, root: str, history: int = HISTORY) -> int:
    """Drop all manifests but the last `history`, and the folders that only those name; the number of folders. Folders that no
    manifest names yet belong to saves under way and stay."""
    numbers = _numbers(spark, root)
    named = lambda ns: {(t, c, v) for n in ns for t, crawls in _read_manifest(spark, root, n).items() for c, v in crawls.items()}
    old, kept = numbers[:-history], numbers[-history:]
    gone = named(old) - named(kept)
    for table, crawl, version in sorted(gone):
        at, files = _path(spark, f"{root}/{table}/version={version}/crawl_id={crawl}")
        files.delete(at, True)
    for n in old:  # last, so that what is named stays named until it is gone
        at, files = _path(spark, f"{root}/_manifests/{n}.json")
        files.delete(at, False)
    return len(gone)


def _stage(df: DataFrame, root: str, name: str) -> str:
    """Write rows that nobody reads yet; their version."""
    version = uuid.uuid4().hex
    df.write.partitionBy("crawl_id").parquet(f"{root}/{name}/version={version}")
    return version


def _replace(staged: dict[str, str], crawl_ids: list[int]) -> Callable[[Manifest], None]:
    def change(held: Manifest) -> None:
        for name, version in staged.items():
            held.setdefault(name, {}).update({int(c): version for c in crawl_ids})

    return change


def save_crawl(records: DataFrame, root: str, crawl_ids: list[int] | None = None) -> None:
    """Write the page and child rows of the given crawls, or of those that records hold; a repetition replaces them, in all tables at
    once. The records are read once for each table, so they should be stored, and not below `root`."""
    ids = crawl_ids if crawl_ids is not None else [r[0] for r in records.select("crawl_id").distinct().collect()]
    staged = {"pagereports": _stage(page_table(records), root, "pagereports")}
    for name in CHILDREN:
        staged[name] = _stage(child_table(records, name), root, name)
    publish(records.sparkSession, root, _replace(staged, ids))
    vacuum(records.sparkSession, root)


def save_issues(issues: DataFrame, root: str, crawl_ids: list[int]) -> None:
    """Replace the issues of these crawls, which may have none left."""
    staged = {"issues": _stage(issues.where(F.col("crawl_id").isin(crawl_ids)), root, "issues")}
    publish(issues.sparkSession, root, _replace(staged, crawl_ids))
    vacuum(issues.sparkSession, root)


#: A crawl's row: what is known at its start, and what is filled in at its end.
CRAWL = (
    "id long, project_id long, url string, start timestamp, end timestamp, total_urls long, blocked_by_robotstxt long, noindex long, robotstxt_exists boolean, sitemap_exists boolean, sitemap_blocked boolean, "
    "internal_follow long, internal_nofollow long, external_follow long, external_nofollow long, sponsored long, ugc long, issues_end timestamp, critical long, alert long, warning long, total long"
)


def save_crawl_row(spark: SparkSession, root: str, **values) -> None:
    """Write a crawl's row, or write it anew over what it said before: columns that are not given keep their value."""
    fields = StructType.fromDDL(CRAWL)
    if unknown := set(values) - set(fields.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    before = crawl_rows(spark, root).where(F.col("id") == values["id"]).collect()
    row = (before[0].asDict() if before else {x: None for x in fields.names}) | values
    new = spark.createDataFrame([tuple(row[x] for x in fields.names)], fields).coalesce(1).withColumn("crawl_id", F.col("id"))
    publish(spark, root, _replace({"crawls": _stage(new, root, "crawls")}, [values["id"]]))


def crawl_rows(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "crawls").select(*StructType.fromDDL(CRAWL).names)


def schema(spark: SparkSession, name: str) -> StructType:
    if name == "issues":
        return StructType.fromDDL("pagereport_id long, crawl_id long, issue_type_id int")
    if name == "crawls":
        return StructType.fromDDL(f"{CRAWL}, crawl_id long")
    none = spark.createDataFrame([], f"{RECORD}, id bigint")
    return page_table(none).schema if name == "pagereports" else child_table(none, name).schema


def load(spark: SparkSession, root: str, name: str, crawl_id: int | None = None) -> DataFrame:
    """A table's rows, or those of one crawl, as the last manifest has them: only the folders that it names are listed."""
    crawls = manifest(spark, root)[1].get(name, {})
    named = [f"{root}/{name}/version={v}/crawl_id={c}" for c, v in sorted(crawls.items()) if crawl_id in (None, c)]
    # a crawl without rows in a table has no folder
    paths = [x for x in named if (at := _path(spark, x))[1].exists(at[0])]
    kind = schema(spark, name)
    if not paths:
        return spark.createDataFrame([], kind)
    # a table without any row has no file to tell its columns
    return spark.read.schema(kind).option("basePath", f"{root}/{name}").parquet(*paths).select(*kind.names)


def delete_crawls(spark: SparkSession, root: str, crawl_ids: list[int]) -> int:
    """Drop the rows of the crawls from every table, their row in crawls apart; the number of tables' crawls that went."""
    ids, gone = {int(c) for c in crawl_ids}, []

    def change(held: Manifest) -> None:
        gone.clear()
        for name in ["pagereports", "issues", *CHILDREN]:
            crawls = held.get(name, {})
            gone.extend((name, c) for c in ids & crawls.keys())
            held[name] = {c: v for c, v in crawls.items() if c not in ids}

    publish(spark, root, change)
    vacuum(spark, root)
    return len(gone)


def unfinished(crawls: DataFrame) -> DataFrame:
    """Crawls whose issues were never completed."""
    return crawls.where("issues_end IS NULL").select("id")


def superseded(crawls: DataFrame, keep: int = 1) -> DataFrame:
    """Crawls of a project beyond its newest `keep`; their rows may go, their row in crawls stays as history."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy(F.desc("start"), F.desc("id"))
    return crawls.withColumn("rn", F.row_number().over(w)).where(F.col("rn") > keep).select("id")
