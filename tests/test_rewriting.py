"""Replay rewriting: mapped values change, all other bytes stay."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.operators import archive


def to(url):
    return archive.replay_url(url, "http://h.example/d/", 3)


def x(path):
    return f"/replay?pid=3&url=http%3A%2F%2Fh.example%2F{path}"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a class="k" href="x">', f'<a class="k" href="{x("d%2Fx")}">'),
        ("<A HREF='/x' id=a>t</A>", f'<A HREF="{x("x")}" id=a>t</A>'),
        ("<img src=i.png alt=none><img alt>", f'<img src="{x("d%2Fi.png")}" alt=none><img alt>'),
        ("<a href = /x title='a > b'>", f"<a href = \"{x('x')}\" title='a > b'>"),
        ('<a href="mailto:x@y"><a name="href">', '<a href="mailto:x@y"><a name="href">'),
        ("<a href=/x?a=1&amp;b=2>", f'<a href="{x("x%3Fa%3D1%26b%3D2")}">'),
        ("<a href=/x href=/y>", f'<a href="{x("x")}" href=/y>'),
        ("<script src=/s.js>var a = '<img src=\"/no.png\">'</script>", f"<script src=\"{x('s.js')}\">var a = '<img src=\"/no.png\">'</script>"),
        ("<!-- <a href=/x> --><![if x]><textarea><a href=/x></textarea>", "<!-- <a href=/x> --><![if x]><textarea><a href=/x></textarea>"),
        ("a < b <a href='/x'", "a < b <a href='/x'"),
        ("<video poster=/p src=/v><source src=/w><audio src=/a>", f'<video poster="{x("p")}" src="{x("v")}"><source src="{x("w")}"><audio src="{x("a")}">'),
        ('<img srcset="a.png 1x, /b.png 2x" src="">', f'<img srcset="{x("d%2Fa.png")} 1x, {x("b.png")} 2x" src="{x("d%2F")}">'),
        ("<style>p{background:url( 'b.png' )}</style><p style='background:url(/c.png)'>", f"<style>p{{background:url({x('d%2Fb.png')})}}</style><p style=\"background:url({x('c.png')})\">"),
        ("<link rel=stylesheet href=/s.css><form action=/f><div data-src=/n>", f'<link rel=stylesheet href="{x("s.css")}"><form action=/f><div data-src=/n>'),
        ("<iframe src=/f><a href=/x></iframe><a href=/y>", f'<iframe src="{x("f")}"><a href=/x></iframe><a href="{x("y")}">'),
    ],
)
def test_rewriting(html, want):
    assert archive.rewrite_html(html, to) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><HEAD a=1><title>t</title></head><body class=x>b", "<html><HEAD a=1>[H]<title>t</title></head><body class=x>[B]b"),
        ("<!-- <head> --><html><header>x", "<!-- <head> --><html>[H][B]<header>x"),
        ("<!doctype html><p>x", "<!doctype html>[H][B]<p>x"),
        ("<head><script>'<body>'</script></head>x", "<head>[H]<script>'<body>'</script></head>[B]x"),
        ("text", "[H][B]text"),
    ],
)
def test_injection(html, want):
    assert archive.inject(html, "[H]", "[B]") == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<a href=", "<img src='", '"', "'", ">", "/x", " ", "<script>", "</script>", "<style>url(a)", "</style>", "<!--", "-->", "<", "b", "=", "&amp;", "srcset=a"]), max_size=40).map("".join))
def test_nothing_but_mapped_values_changes(html):
    assert archive.rewrite_html(html, lambda u: u) == re.sub("url\\(\\s*a\\s*\\)", "url(a)", html)
    archive.inject(archive.rewrite_html(html, to), "h", "b")


@pytest.mark.parametrize("piece", ["<a href='", "<img srcset=a,", "<!--", "<style>", "<a href=x>", "<p style='url("])
def test_linear_time(piece):
    began = time.process_time()
    archive.rewrite_html(piece * (400_000 // len(piece)), to)
    assert time.process_time() - began < 5
