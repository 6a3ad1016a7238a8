"""Bounds that hostile or repeated rows must not break: linear scans, bounded samples, settings."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import frame

from auditlake.llm import quality_classifier, secrets, warc

PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")


def test_key_marks_as_the_pattern_has_them():
    rng = np.random.default_rng(1)
    parts = ["-----BEGIN ", "-----", "PRIVATE KEY", "RSA ", "7", " ", "x", "-----BEGIN PRIVATE KEY-----", "KEY"]
    for _ in range(3000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 12))
        at, got = 0, []
        while (end := secrets.pem_mark(text, at)) >= 0:
            got.append(end)
            at = end
        assert got == [m.end() for m in PEM.finditer(text)], text


@pytest.mark.parametrize("piece", ["PRIVATE KEY", "-----BEGIN PRIVATE KEY ", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----"])
def test_key_marks_are_found_in_linear_time(piece):
    text = "-----BEGIN " + piece * (5_000_000 // len(piece))
    began = time.process_time()
    sum(1 for _ in secrets.key_bodies(text))
    assert time.process_time() - began < 5


def test_a_repeated_doc_id_counts_once(spark, monkeypatch):
    """2,000 rows of one rated doc_id are one text of the sample."""
    docs = frame(spark, [(1, f"text {i} of the id") for i in range(2000)] + [(2, "another text")])
    rated = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    seen = []
    plain = quality_classifier.Ordinal.fit
    monkeypatch.setattr(quality_classifier.Ordinal, "fit", lambda self, texts, grade: seen.append((len(texts), sorted(grade.tolist()))) or plain(self, texts, grade))
    quality_classifier.train(docs, rated)
    assert seen == [(2, [0, 1])]


def test_archives_leave_batches_of_many_rows(spark, tmp_path):
    pages = spark.range(30).select(F.col("id").alias("page_id"), F.lit("http://h.example/").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int") * 50).alias("html"))
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 30
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1
