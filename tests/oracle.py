"""Spark against DuckDB: rows as sorted tuples, columns by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def same(spark, run, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = run(spark, sf_dir)
    got = plain(df.collect(), df.columns)
    rel = con.sql(sql)
    want = plain(rel.fetchall(), rel.columns)
    return got == want, got, want
