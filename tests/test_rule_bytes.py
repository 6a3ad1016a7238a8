"""What the rules write and shuffle: keys and ids, no stored tables, no texts or hashes in hex."""

import time

from pyspark.sql import functions as F

from auditlake.operators.reports import issues_count
from auditlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def moved(spark, run):
    """Bytes that a run shuffles and writes, by the stages' own figures."""
    store, void = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        held = store.stageList(None, False, False, void, spark._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() + x.outputBytes() for x in map(held.apply, range(held.size()))}

    before = set(stages())
    run()
    time.sleep(1)
    return sum(n for k, n in stages().items() if k not in before)


def test_all_rules_move_a_few_bytes_a_row(spark):
    # 15,000 pages, 60,000 links and as many alternates: 11.7 MB before
    assert moved(spark, lambda: QUERIES["agg_crawl_totals"](spark, SF).collect()) < 6 << 20


def test_counted_pages_are_shuffled_once(spark):
    rows = spark.range(20000).select(F.col("id").alias("pagereport_id"), F.lit(1).alias("crawl_id"), F.explode(F.sequence(F.lit(1), F.lit(150), F.lit(6))).alias("issue_type_id"))
    # twice the same issue, a type that no page has, codes of several words, and of none
    odd = spark.createDataFrame([(0, 1, 1), (7, 1, 63), (8, 1, 64), (9, 1, 200), (None, 1, 64), (7, 1, None)], "pagereport_id long, crawl_id int, issue_type_id int")
    types = spark.createDataFrame([(c, f"t{c}", 1) for c in (1, 2, 7, 63, 64, 127, 145, 200)], "issue_type_id int, type string, priority int")
    found = []
    assert moved(spark, lambda: found.extend(issues_count(rows.union(odd), types).collect())) < 1 << 20  # 3.7 MB before
    assert {r.type: r.n for r in found} == {"t1": 20000, "t2": 0, "t7": 20000, "t63": 1, "t64": 1, "t127": 20000, "t145": 20000, "t200": 1}


def test_a_priority_asks_its_own_rules_only(spark):
    # 1.9 MB before
    assert moved(spark, lambda: QUERIES["agg_issues_priority_1"](spark, SF).collect()) < 1 << 20
