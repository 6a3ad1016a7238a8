"""The audit's tables in a relational database, by Spark's JDBC connector; the driver's jar must be on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(
    spark: SparkSession,
    url: str,
    table: str,
    user: str = "",
    password: str = "",
    parts: int = 1,
    key: str | None = None,
    low: int = 0,
    high: int = 0,
    **options: str,
) -> DataFrame:
    """A table, or a query in brackets with an alias. With a numeric key its range is read in `parts` connections at once; rows
    outside low .. high are read too, by the first and last of them."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **_account(user, password), **options)
    if key and parts > 1:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write(
    rows: DataFrame,
    url: str,
    table: str,
    user: str = "",
    password: str = "",
    mode: str = "append",
    connections: int = 25,
    batch: int = 1000,
    **options: str,
) -> None:
    """Rows into a table, in batches; at most `connections` at once. "overwrite" empties the table instead of dropping it."""
    rows.write.format("jdbc").options(
        url=url,
        dbtable=table,
        batchsize=batch,
        numPartitions=connections,
        truncate="true",
        **_account(user, password),
        **options,
    ).mode(mode).save()


def _account(user: str, password: str) -> dict[str, str]:
    return {k: v for k, v in (("user", user), ("password", password)) if v}
