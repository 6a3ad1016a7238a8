"""Media types that an extension stands for."""

from pyspark.sql import functions as F

from auditlake.functions import mime


def test_mismatch(spark):
    rows = [
        ("http://h/a.js", "application/javascript", False), ("http://h/a.js", "text/javascript", False), ("http://h/a.js", "text/plain", True),
        ("http://h/a", "text/html", False), ("http://h/a", "text/plain", True), ("http://h/a.DOC?x=.png", "application/msword", False),
        ("http://h/a.doc", "text/html", True), ("http://h/a.tiff", "image/tiff", False), ("http://h/a.mov", "video/quicktime", False), ("http://h/a.mov", "video/mp4", True),
        ("http://h/a.unknown", "x/y", False), ("http://h/a.unknown", "", True), ("http://h/.tar/a", "text/html", False),
    ]
    df = spark.createDataFrame(rows, "url string, kind string, want boolean").withColumn("got", mime.mismatch(F.col("url"), F.col("kind")))
    assert df.where("got <> want").collect() == [] and len(mime.TYPES) > 120
