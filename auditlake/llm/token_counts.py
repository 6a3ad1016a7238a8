"""Token totals by source, language and tokenizer version, maintained by deltas.

A change is an insert (+1 document, +n tokens), a delete (-1, -n) or a revision (the old count signed -, the new one +, on
whichever keys they fall). A batch of changes is aggregated to one signed row per key and committed under its batch id: the
delta table lies in a folder of its own below <root>/deltas, and the batch counts once <root>/log/<id>.json, which names that
folder, has been put in place by a rename. Committing an id that the log already has changes nothing; a commit that broke off
leaves files that nothing names. Totals are plain sums over the committed batches, so batches may arrive in any order;
compact() folds batches into one, which names them as covered, without changing any total. (Of two writers that commit one id
at the same time only one counts where the store's rename refuses an existing target, as HDFS does; the driver is the only
writer of a rollup otherwise.)

Defined results: a null or empty text has 0 tokens and counts as a document; null source or lang is a group of its own;
repeated rows count as often as they occur; totals whose documents have all been deleted are left out; no batch, or an
empty table, gives no rows; columns that are not named here are not read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import text as tx
from auditlake.llm import tokens

KEY = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(tokens.encode(t.as_py(), path)) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(n, pa.int64())],
            ["doc_id", "source", "lang", "text_hash", "n_tokens"],
        )


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens, text_hash) of every whole text; text_hash is 32 digits of its SHA-256."""
    tx.arrow_batches(docs.sparkSession)
    read = tx.only(docs, "doc_id", "text", "source", "lang").withColumn("text_hash", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
    counted = read.mapInArrow(
        lambda b, p=path or tokens.vocabulary(version): _count_batches(b, p),
        "doc_id long, source string, lang string, text_hash string, n_tokens long",
    )
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "text_hash")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEY, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """The rollup at `root`, a folder that all nodes see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._log = self._path(f"{self.root}/log")
        self._fs = self._log.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def batches(self) -> dict[str, dict]:
        """The log by batch id: the folder of a batch's delta, and the ids that it covers besides its own."""
        if not self._fs.exists(self._log):
            return {}
        found = {}
        for status in self._fs.listStatus(self._log):
            if status.getPath().getName().endswith(".json"):
                stream = self._fs.open(status.getPath())
                try:
                    found[status.getPath().getName().removesuffix(".json")] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return found

    def known(self) -> set[str]:
        """Ids that count already, by themselves or in a batch that covers them."""
        return {x for name, entry in self.batches().items() for x in (name, *entry["covers"])}

    def commit(self, batch_id: str, changes: DataFrame, covers: list[str] | None = None) -> bool:
        """False if the batch is already committed; its changes are then not read."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if batch_id in self.known():
            return False
        summed = changes.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 OR d_tokens <> 0")
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        summed.write.parquet(f"{self.root}/deltas/{attempt}")
        entry, draft = self._path(f"{self.root}/log/{batch_id}.json"), self._path(f"{self.root}/log/{attempt}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"folder": attempt, "covers": sorted(covers or [])}).encode()))
        finally:
            stream.close()
        # the rename publishes the batch in one step; of two writers of one id the second finds the entry there
        if not self._fs.exists(entry) and self._fs.rename(draft, entry):
            return True
        self._fs.delete(draft, False)
        return False

    def _deltas(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.root}/deltas/{x}" for x in folders])

    def totals(self) -> DataFrame:
        summed = self._deltas([x["folder"] for x in self.batches().values()]).groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: "Rollup") -> bool:
        """Fold the committed batches that another rollup doesn't know into one batch of it, which names them as covered.

        One commit does both, so a compaction that broke off is repeated whole, or has nothing left to do; batches that came
        in between are folded by the next one. False if there was nothing to fold."""
        known, mine = into.known(), self.batches()
        new = {x: entry for x, entry in mine.items() if x not in known}
        covers = sorted({y for x, entry in new.items() for y in (x, *entry["covers"])})
        if both := known.intersection(covers):
            raise ValueError(f"batches that are known there are folded with others here: {sorted(both)[:5]}")
        name = "compacted-" + hashlib.sha256(",".join(covers).encode()).hexdigest()[:16]
        return bool(new) and into.commit(name, self._deltas([x["folder"] for x in new.values()]), covers)


def estimated(docs: DataFrame, version: str = "byte_bpe_50k.json", bytes_a_token: int = 4) -> DataFrame:
    """As count_tokens(), with a guess from the text's bytes: what a load knows before any text is encoded."""
    guess = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / bytes_a_token)
    return tx.only(docs, "doc_id", "text", "source", "lang").select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), guess.alias("n_tokens"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals over all documents, and over distinct texts. Guessed counts are loaded, then revised to the exact ones; then all
    documents but the first of equal texts are deleted. Each batch is delivered twice."""
    docs = tx.table(spark, sf_dir, "documents")
    counted = tx.written(count_tokens(docs), "counted")
    # all rows of a text that occurs again are deleted but one; rows are summed by text and key before they meet
    per = counted.groupBy("text_hash", *KEY).agg(
        F.count("*").alias("m"),
        F.sum("n_tokens").alias("sum"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_tokens")).alias("row"),
    )
    first = F.min(F.struct("row.none", "row.doc_id", *KEY, "row.n_tokens")).alias("first")
    again = tx.written(
        per.groupBy("text_hash").agg(
            F.sum("m").alias("rows"),
            first,
            F.collect_list(F.struct(*KEY, "m", "sum")).alias("each"),
        ).where("rows > 1"),
        "copies",
    )
    gone = again.select(F.explode("each").alias("x")).select(*[f"x.{c}" for c in KEY], (-F.col("x.m")).alias("d_docs"), (-F.col("x.sum")).alias("d_tokens"))
    gone = gone.unionByName(inserts(again.select("first.*")))
    rollup = Rollup(spark, tx.shared_dir(spark, "rollup"))
    for _ in range(2):
        rollup.commit("load", inserts(estimated(docs)))
    for _ in range(2):
        rollup.commit("recount", revisions(estimated(docs), counted))
    whole = tx.written(rollup.totals(), "totals")
    for _ in range(2):
        rollup.commit("copies", gone)
    distinct = rollup.totals().select(*[F.col(x).alias(f"{x}_") for x in KEY], F.col("n_docs").alias("n_distinct_docs"), F.col("n_tokens").alias("n_distinct_tokens"))
    same = F.lit(True)
    for x in KEY:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_"))
    return whole.join(distinct, same, "left").select(
        *KEY,
        "n_docs",
        "n_tokens",
        *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_distinct_docs", "n_distinct_tokens")],
    )
