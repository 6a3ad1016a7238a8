"""Plain bodies are read in one pass over their tags; the facts are those of the tree."""

import random

import pytest

from auditlake.functions.urls import Resolver, resolve
from auditlake.operators.lifecycle import child_columns
from auditlake.plans import site
from auditlake.plans.queries import EXTERNAL
from auditlake.sources import html
from auditlake.sources.tree import Tree

PAGE = "<!DOCTYPE html><html lang=en><head><title>a &amp; b</title></head><body>{}</body></html>"
PLAIN = [
    "<p>one<p>two<h2>three</h2><ul><li>a<li><b>c</b></li></ul>",
    '<A HREF="/a" rel=" nofollow">x<!-- c -->y</A><img src="/i.png" srcset="a.png 1x, b.png 2x">',
    "<picture><source srcset=/q><img src=r alt=z></picture><video poster=/v><source src=w></video><iframe src=/f>t</iframe>",
    "<b><b><b><b>deep</b></b></b></b><form action=/f><button>z</button></form><style>a{b:url(c)}</style><meta name=y>",
    "<dl><dt>a<dd>b<dt>c</dt></dl><script src=/s>no words</script><b id=x></b><i id=x style='b:url(d)'>e &lt; f</i>",
]
OTHER = [
    "<table>stray<tr><td>cell</table>",
    "<b>x<p>y</b>z</p>",
    "<a href=/one>one<a href=/two>two</a>",
    "<p><b>x<p>y</b>",
    "<form><form></form></form>",
    "<div><p>x</div>",
    "<h1><h2>x</h2></h1>",
    "<button><button>x</button>",
    "a < b",
    "<img alt='x",
    "<!-- a < b --> c",
    "<svg><a href=/s>s</a></svg>",
    "<script>a<b</script>",
    "</body>more",
]


def facts(body: str) -> tuple[bool, dict, dict]:
    """(whether a body is plain, its facts, those of its tree)."""
    of = lambda x: {k: v for k, v in vars(x).items() if k not in ("in_body", "same_ids")}
    tried, walked = (html.Facts.__new__(html.Facts) for _ in range(2))
    tried.clear()
    walked.clear()
    plain = tried.plain(body)
    walked.walk(Tree(body))
    return plain, of(html.Facts(body)), of(walked)


@pytest.mark.parametrize("body", PLAIN)
def test_plain_bodies_need_no_tree(body):
    plain, got, tree = facts(PAGE.format(body))
    assert plain and got == tree


@pytest.mark.parametrize("body", OTHER)
def test_other_bodies_go_to_the_tree(body):
    plain, got, tree = facts(PAGE.format(body))
    assert not plain and got == tree


def test_random_bodies_have_the_facts_of_their_trees():
    rng = random.Random(5)
    tags = "a p div li ul dl dd dt h1 h2 form button b i span br hr img picture source audio video script style title iframe label table td select".split()
    attrs = ["", "", " id=x", ' href="/a"', " src=s", ' style="a:url(q)"', " srcset='a 1x, b 2x'", " alt=\"&lt;\""]
    n = 0
    for _ in range(3000):
        out, open_ = [], []
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.55:
                tag = rng.choice(tags[:-3] if rng.random() < 0.98 else tags)
                out.append(f"<{tag}{rng.choice(attrs)}>")
                if tag in html.PLAIN_RAW:
                    out.append(f"t</{tag}>")
                elif tag not in html.PLAIN_VOID | {"hr"}:
                    open_.append(tag)
            elif open_:
                out.append(f"</{open_.pop() if rng.random() < 0.98 else rng.choice(tags)}>")
            out.append(rng.choice(["", "x", " ", "y &amp; z", "<!-- c -->"]))
        plain, got, tree = facts(PAGE.format("".join(out) + "".join(f"</{x}>" for x in reversed(open_))))
        assert got == tree
        n += plain
    assert n > 500


def test_every_page_of_the_site_is_plain(spark):
    pages = site.responses(spark, "/root/testdata/sf0.001").where("body LIKE '<!DOCTYPE%'").select("body").limit(300).collect()
    assert all(facts(r.body)[0] for r in pages)


@pytest.mark.parametrize("base", [None, "/base/x", "https://o.example/q?z=1", "", "?q", "/a/../b/", "http://["])
def test_prefixes_resolve_as_the_whole_way_does(base):
    refs = "a a/b.html /s.css /a/?x=1 a#f ?q=1 .. ./a /../a a//b // http: https://h.example https://h.example?x https://h.example/a/../b#c mailto:x a:b é".split() + ["", " a", "x y"]
    for page in ("https://site.example/d/p.html", "https://site.example", "http://a.example:80/x//y/p q.html?d=/e", "https://h.example/a/../b/c", "ftp://x/y", ""):
        assert [Resolver(page, base)(x) for x in refs] == [resolve(x, page, base) for x in refs]


def test_columns_without_their_elements_take_no_parse(monkeypatch):
    r = {"url": "http://h.example/", "status_code": 200, "headers": {"Content-Type": ["text/html"]}, "body": PAGE.format("<IFRAME src=/f></IFRAME>")}
    assert html.parse(r, frozenset({"iframes"}))["iframes"] == ["http://h.example/f"]
    monkeypatch.setattr(html, "Facts", None)
    assert html.parse(r, frozenset({"scripts", "url"}))["scripts"] == []


def test_child_tables_ask_for_their_own_columns():
    assert (child_columns("styles"), child_columns("hreflangs")) == (["styles"], ["hreflangs", "lang"])


def test_headers_of_null_maps_and_lists(spark):
    rows = [(1, "http://a.example/", 200, h, "<title>t</title>", 1, 1, 1, True, False, False) for h in (None, {}, {"Content-Type": None}, {"content-TYPE": ["text/html", "x"], "X-Robots-Tag": ["none"]})]
    found = html.page_records(spark.createDataFrame(rows, html.RESPONSE), columns=["crawl_id", "title", "crawled"]).collect()
    assert sorted((r.title, r.crawled) for r in found) == [("", True), ("", True), ("", True), ("t", False)]


def test_one_page_is_looked_for_before_any_is_parsed(spark):
    table = EXTERNAL(spark, "/root/testdata/sf0.001", 5)["external_links"]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("MapInArrow") :] and {r.pagereport_id for r in table.collect()} == {5}
