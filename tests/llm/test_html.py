import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import html


def text(page):
    return html.extract(page)[1]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a<b>b</b>c <i> d</i>", "abc d"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol><li>w</ul>", "- x\n- y\n  3. z\n- w"),
        ("<h1>T</h1>after", "T\n\nafter"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>", "aa  b\nc   dddd"),
        ("<table><tr><th colspan=2>wide head<tr><td>a<td>b</table>", "wide head\na  b"),
        ("<table><caption>cap</caption><tr><td>x<p>y</table>z", "cap\nx y\n\nz"),
        ("a<script>if (a<b) '</p>'</script>b<style>p{}</style>", "ab"),
        ("<p hidden>no</p><p style='display : none'>no</p><p>yes", "yes"),
        ("<span style='visibility:hidden'>no</span>yes<template>no</template><noscript>no</noscript>", "yes"),
        ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<blockquote>q</blockquote>", "  q"),
        ("</p></div>x<!-- c --><!doctype html>y", "xy"),
        ("a < b and <3 c", "a < b and <3 c"),
        ("<p>unclosed <b>bold <a href='x>y'>link", "unclosed bold link"),
        ("<title>t</title><body>b", "b"),
    ],
)
def test_layout(page, want):
    assert text(page) == want


def test_title():
    assert html.extract("<head><title> a &lt;\n b</title></head>")[0] == "a < b"
    assert html.extract("<p>x")[0] is None


def words_of(page):
    """The visible words of a page without tables, by cutting hidden parts and tags."""
    page = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<script>.*?</script>|<style>.*?</style>", " ", page)
    page = re.sub(r"</?(?:b|i|em|span|a)\b[^>]*>", "", page)
    return unescape(re.sub(r"<[^>]*>", " ", page)).split()


def test_all_visible_words_of_the_tables_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        got = [w for w in text(r.html).split()]
        want = words_of(r.html)
        assert [w for w in got if w != "-"] == [w for w in want if w != "-"], r.page_id


TAGS = ["p", "div", "b", "ul", "ol", "li", "table", "tr", "td", "pre", "dl", "dd", "select", "option", "head", "details", "blockquote", "br", "script"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]), st.text(max_size=6)), max_size=30))
def test_never_fails_and_leaves_no_loose_space(parts):
    out = text("".join(parts))
    assert all(line == line.rstrip(" ") for line in out.split("\n"))


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "x") == "x"
    assert text("<table><tr><td>" * 300 + "x").split() == ["x"]
    assert text("<p>a " * 20_000).count("a") == 20_000
    assert text("<" * 5000 + "a='" * 3000).strip()


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>x"), (3, "<p>x"), (None, "y")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", html.F.lit("t")).withColumn("title", html.F.lit(1))
    got = sorted((str(r.page_id), r.text, r.n_chars, r.n_lines) for r in html.extract_pages(df).collect())
    assert got == [("1", "", 0, 0), ("2", "", 0, 0), ("3", "x", 1, 1), ("3", "x", 1, 1), ("None", "y", 1, 1)]
    assert html.extract_pages(df.limit(0)).count() == 0
