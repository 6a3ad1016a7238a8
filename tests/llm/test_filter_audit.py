"""The filter audit against plain Python and DuckDB, and its defined results at the edges."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_llm import EDGES, SF, frame, rows

from auditlake.llm import filter_audit, lexicon
from auditlake.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """The audit by loops over all orders. docs: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failing = []
    for i, lang, t in docs:
        t = t or ""
        w = WORD.findall(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        f += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and i > least[t])
        failing.append((lang or "", f, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in failing}:
        mine, counted = [x[1:] for x in failing if x[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in mine if x in m[0] and not before & set(m[0])]
                counted[x] += len(here)
                kept = sum(not (before | {x}) & set(m[0]) for m in mine)
                redundant = sum(x in m[0] and bool(before & set(m[0])) for m in mine)
                out[part, order, step] = [kept, len(here), redundant, sum(m[0] == x for m in mine), sum(m[1] for m in here), sum(m[2] for m in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(counted[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    found = {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    assert df.columns == [x.split()[0] for x in filter_audit.ROWS.split(", ")]
    return found


def test_against_loops(spark):
    data = rows() + EDGES + [(None, "null id text"), (1, "null id text"), (9, ""), (7001, "A B C D"), (7002, "a% " * 300), (7003, "x y " * 150)]
    docs = frame(spark, data)
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    labels += [(5005, 0, 1), (5005, 1, None), (5005, None, 0), (None, 1, 1), (5002, 1, 0)]
    table = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, mask string")
    want = plain([(i, "en" if i != 5004 else None, t) for i, t in data], labels)
    assert {k[0] for k in want} == {"en", ""}
    assert got(filter_audit.audit(docs, table)) == want


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = ", ".join(x.split()[0] for x in filter_audit.ROWS.split(", "))
    want = {r[:3]: r[3:] for r in con.sql(f"SELECT {names} FROM ({filter_audit.OP11_SQL})").fetchall()}
    found = got(filter_audit.op11_filter_audit(spark, SF))
    assert found == want and len(found) % 600 == 0


def test_bounds_of_the_filters():
    """Each failure at its bound and one beside it; code points, not bytes."""
    cases = {
        "A": (" ".join(map(str, range(199))), " ".join(map(str, range(200)))),
        "B": ("a a a b b", "a a b b"),
        "C": ("AAAA" + "é" * 96, "AAA" + "é" * 97),
        "D": ("a|b", "a!b"),
    }
    for i, (bad, fine) in enumerate(cases.values()):
        mask = filter_audit.masks(*tx.utf8(pa.array([bad, fine])))
        assert (mask >> i & 1).tolist() == [1, 0], i


@pytest.mark.parametrize("hash_bits", [44, 3])
def test_word_numbers(hash_bits):
    """Exact whatever the hash: with 3 bits nearly all texts have words that share one."""
    texts = ["b a b a c", "", "a b", "x " * 50 + "longer-word " * 3, "é è é è ê", "a", *[t or "" for _, t in rows(40)]]
    data, offs = tx.utf8(pa.array(texts))
    starts, ends, first = tx.words(data, offs)
    numbers, distinct = lexicon.word_numbers(data, starts, ends, first, hash_bits)
    for t, x in enumerate(texts):
        w = WORD.findall(x)
        mine = numbers[first[t] : first[t + 1]]
        assert distinct[t] == len(set(w))
        assert len(set(zip(w, mine.tolist()))) == len(set(w)) == len(np.unique(mine))


def test_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, [])[["doc_id", "text", "lang"]], labels).collect() == []
    assert filter_audit.audit(frame(spark, [(1, "a")]), labels).count() == 600
