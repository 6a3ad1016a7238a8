"""The audit's tables stay whole whatever breaks: manifests, their history, writers at the same time."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import lifecycle
from auditlake.sources import html


def records(spark, body, *crawls):
    rows = [(c, "http://h.example/", 200, {"Content-Type": ["text/html"]}, body, 0, 1, 0, False, False, False) for c in crawls]
    return html.page_records(spark.createDataFrame(rows, html.RESPONSE)).withColumn("id", F.xxhash64("crawl_id", "url"))


def state(spark, root):
    """(crawl, title, links, issues) of all that readers see."""
    count = lambda name, c: lifecycle.load(spark, root, name, c).count()
    return {r.crawl_id: (r.title, count("links", r.crawl_id), count("issues", r.crawl_id)) for r in lifecycle.load(spark, root, "pagereports").collect()}


OLD, NEW = "<title>old</title><a href=/1>x</a><a href=/2>y</a>", "<title>new</title><a href=/3>z</a>"


@pytest.mark.parametrize("breaks_at", ["_stage", "_replace", "publish"])
def test_a_broken_save_leaves_the_old_crawl(spark, tmp_path, monkeypatch, breaks_at):
    """At the fourth table, or with all tables written but no manifest: readers go on with the old rows of all tables."""
    root = str(tmp_path)
    lifecycle.save_crawl(records(spark, OLD, 1, 2), root)
    lifecycle.save_issues(spark.createDataFrame([(1, 1, 2)], "pagereport_id long, crawl_id long, issue_type_id int"), root, [1])
    before = state(spark, root)
    assert before == {1: ("old", 2, 1), 2: ("old", 2, 0)}
    calls, plain = [], lifecycle._stage

    def broken(*args):
        calls.append(args)
        if breaks_at != "_stage" or len(calls) == 4:
            raise OSError("lost")
        return plain(*args)

    with monkeypatch.context() as m:
        m.setattr(lifecycle, breaks_at, broken)
        with pytest.raises(OSError, match="lost"):
            lifecycle.save_crawl(records(spark, NEW, 1), root)
        assert state(spark, root) == before
    lifecycle.save_crawl(records(spark, NEW, 1), root)
    assert state(spark, root) == {1: ("new", 1, 1), 2: ("old", 2, 0)}


def test_a_query_planned_before_a_save_still_ends(spark, tmp_path):
    root = str(tmp_path)
    lifecycle.save_crawl(records(spark, OLD, 1), root)
    planned = lifecycle.load(spark, root, "pagereports")
    lifecycle.save_crawl(records(spark, NEW, 1), root)
    assert planned.first().title == "old" and lifecycle.load(spark, root, "pagereports").first().title == "new"
    assert lifecycle.vacuum(spark, root, 1) == 10 and lifecycle.load(spark, root, "links").count() == 1


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    """A writer whose manifest number was taken meanwhile keeps what the other one published."""
    root = str(tmp_path)
    lifecycle.save_crawl(records(spark, OLD, 1), root)
    plain, other = lifecycle.manifest, []

    def slow(s, r):
        held = plain(s, r)
        if not other:
            other.append(True)
            lifecycle.save_crawl(records(spark, NEW, 2), root)  # gets the next number first
        return held

    monkeypatch.setattr(lifecycle, "manifest", slow)
    lifecycle.publish(spark, root, lambda m: m["links"].pop(1))
    monkeypatch.undo()
    assert state(spark, root) == {1: ("old", 0, 0), 2: ("new", 1, 0)}


def test_deletion_is_a_manifest(spark, tmp_path):
    root = str(tmp_path)
    lifecycle.save_crawl(records(spark, OLD, 1, 2), root)
    number, _ = lifecycle.manifest(spark, root)
    planned = lifecycle.load(spark, root, "links", 1)
    assert lifecycle.delete_crawls(spark, root, [1, 9]) == 10
    assert lifecycle.manifest(spark, root)[0] == number + 1 and state(spark, root) == {2: ("old", 2, 0)}
    assert planned.count() == 2 and lifecycle.load(spark, root, "links", 1).count() == 0


def test_folders_of_saves_under_way_stay(spark, tmp_path):
    root = str(tmp_path)
    version = lifecycle._stage(lifecycle.page_table(records(spark, OLD, 5)), root, "pagereports")
    for title in (OLD, NEW, OLD, NEW):
        lifecycle.save_crawl(records(spark, title, 1), root)
    assert len(lifecycle._numbers(spark, root)) == lifecycle.HISTORY
    lifecycle.publish(spark, root, lifecycle._replace({"pagereports": version}, [5]))
    assert {c: t for c, (t, _, _) in state(spark, root).items()} == {1: "new", 5: "old"}
