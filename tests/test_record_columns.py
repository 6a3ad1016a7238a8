"""Records of chosen columns, and the short ways of the tree's ends and scopes."""

from auditlake.plans import site
from auditlake.sources.tree import Tree

SF = "/root/testdata/sf0.001"


def test_only_wanted_columns_are_made(spark):
    some = site.records(spark, SF, "images", "lang")
    assert sorted(some.columns) == ["crawl_id", "id", "images", "lang", "url"]
    rows = lambda df: sorted(map(str, df.select("id", "lang", "images").where("id < 200").collect()))
    assert rows(some) == rows(site.records(spark, SF))


def test_near_and_far_scopes_agree():
    for depth in (1, 5, 9, 40):
        body = Tree("<p>" + "<span>" * depth + "<p>x").body
        assert [x.tag for x in body.kids] == ["p", "p"]
        inner = Tree("<p>" + "<span>" * depth + "<button><p>x").body
        assert [x.tag for x in inner.kids] == ["p"]
