import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm.html import extract, op1_html, render

CASES = {
    "a<p>b<p>c</p>d": "a\n\nb\n\nc\n\nd",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c",
    "<ol start=3><li>p<li>q</ol>": "3. p\n4. q",
    "<table><tr><td>1<td>22<tr><td>333<td>4</table>": "1    22\n333  4",
    "<table><tr><th colspan=2>head<th>x<tr><td>a<td>b<td>c</table>": "head  x\na  b  c",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "x <b>y</b><i> z</i>  w": "x y z w",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>a\n  b\n</pre>c": "a\n  b\n\nc",
    "3 < 4 &amp; 5 &gt; 2 &eacute; &#x41;": "3 < 4 & 5 > 2 é A",
    "<script>var a='</p>';</script><style>.h{display:none}#i,em{visibility:hidden}</style>x<b class='k h'>n</b><i id=i>n</i><em>n</em>y": "xy",
    "<div hidden>n</div><div style='color:red;display: none'>n</div>y<template>n</template>": "y",
    "<details><summary>s</summary>n</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<dialog>n</dialog><dialog open>y</dialog>": "y",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote>q</blockquote>r": "  q\n\nr",
    "<title>n</title><h1>h</h1>t": "h\n\nt",
    "<!DOCTYPE html><html><head><meta charset=x><link rel=y></head><body>b<!-- n --></body></html>": "b",
    "</b>a</p>b": "a\n\nb",
    "a <x>b</x> <unknown/>c": "a b c",
    "<p>1<div>2</div>3": "1\n\n2\n3",
    "<select><option>a<option>b</select>": "a\nb",
    "<a title=\"x>y\">in</a> <b title='unclosed>t</b>": "in t",
    "a<": "a<",
    "<<b>x</b>": "<x",
    "": "",
    "plain  text\n here": "plain text here",
    "<textarea> keep  <b> </textarea>": " keep  <b>",
    "<ul><li><p>a</p><p>b</p></li></ul>": "- a\n\n  b",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert render(page) == CASES[page]


def test_null_and_depth_and_length():
    assert render(None) is None
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000).strip() == "deep"
    assert render("<ul><li>" * 3000 + "deep").strip().endswith("deep")
    assert len(render("<p>word " * 50_000).split()) == 50_000
    wide = "<table>" + "<tr><td>" + "x" * 100_000 + "<td>y" + "<tr><td>a<td>b" * 1000 + "</table>"
    assert len(render(wide)) < 200_000


@given(st.text(alphabet="<>/abptdrulih =\"'&;!-", max_size=80))
@settings(max_examples=1500, deadline=None)
def test_any_markup_renders(page):
    assert isinstance(render(page), str)


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_query_holds_just_the_visible_characters(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = Text()
        p.feed(pages[r.page_id])
        p.close()
        bare = lambda t: re.sub(r"[\s-]", "", t)
        assert bare("".join(p.out)) == bare(r.text)


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>a", "x"), (3, "<p>a", "x"), (None, "b", "x")], "page_id long, html string, text string")
    assert sorted((r.page_id or -1, r.text) for r in extract(df).where("text is not null").collect()) == [(-1, "b"), (2, ""), (3, "a"), (3, "a")]
    assert extract(df).count() == 5 and extract(df.where("false")).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<p style='backface-visibility:hidden'>a</p>", "a"),
    ("<style>.x{-webkit-backface-visibility: hidden}</style><p class=x>a</p>", "a"),
    ("<p style='display:none;display:block'>a</p><p style='visibility : hidden !important'>n</p>", "a"),
    ("<style>@media print { .no-print { display:none } } .n{display:none}</style><p class=no-print>a</p><p class=n>n</p>", "a"),
    ("<style>@media (max-width: 600px) { .w { display:none } } @media screen { .n{display:none} }</style><p class=w>a</p><p class=n>n</p>", "a"),
    ("<style media=print>p{display:none}</style><p>a</p>", "a"),
    ("<style>@import 'x'; /* } */ .a{color:red; .b{display:none} &:hover{display:none}} .n{display:none; b{color:red}}</style><p class=a>a<b class=b>b</b></p><p class=n>n", "ab"),
    ("<style>.n{display:none</style><p class=n>n</p>a", "a"),
    ("<html><head><title>n</title>text<p>b</html>", "text\n\nb"),
    ("<head><meta charset=x> <iframe></iframe>text", "text"),
    ("a<svg><title/><defs/><path d='m'/><g><text>one</text><text>two</text></g><desc>n</desc></svg>b", "a\none\ntwo\nb"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>n</annotation></math>", "x=1"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2\n3"),
    ("<desc>a</desc> <text>b</text>", "a b"),
])
def test_visible_text_stays(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page,text", [
    ("<style>@media print{p{display:none}}</style><p>a", "a"),
    ("<div style='visibility:hidden'>n<b style='visibility:visible'>a</b>n</div>", "a"),
    ("<style>p{display:none}</style><p>n</p><p style='display:block'>a</p>", "a"),
    ("<style>p{display:none!important}</style><p style='display:block'>n</p><p style='display:block!important'>a</p>", "a"),
    ("<style>div.h{display:none} .a .b{visibility:hidden}</style><div class=h>n</div><p class=h>x</p><div class=a><i><b class=b>n</b></i></div><b class=b>y</b>", "x\n\ny"),
    ("<style>.a>.b{display:none}</style><div class=a><p><b class=b>x</b></p><b class=b>n</b></div>", "x"),
    ("<style>h1+p,h2~p{display:none}</style><h1>h</h1><p>n</p><p>x</p><h2>i</h2><div>d</div><p>n</p>", "h\n\nx\n\ni\n\nd"),
    ("<style>[data-x],input[type='hidden'],[lang|=en],a[href^='no']{display:none}</style><p data-x=1>n</p><p lang=en-GB>n</p><a href=no/1>n</a><a href=yes>x</a>", "x"),
    ("<style>#i{display:block} .c{display:none} p{display:none}</style><p id=i class=c>x</p><p class=c>n</p>", "x"),
    ("<style>.c{display:none} .c{display:block}</style><p class=c>x</p>", "x"),
    ("<p class=late>n</p>x<style>.late{display:none}</style>", "x"),
    ("<style>div{display:block}</style><div hidden>x</div><p hidden>n</p>", "x"),
    ("<style>p:hover,p::before,:not(p){display:none}</style><p>x</p>y", "x\n\ny"),
    ("<style>*{visibility:hidden} b{visibility:visible}</style><p>n<b>x</b></p>", "x"),
    ("<ul style='visibility:hidden'><li>n<li style='visibility:visible'>x</ul>", "- x"),
    ("<style>b{display:block}li{display:inline}</style>1<b>2</b>3<ul><li>a</li> <li>b</li></ul>", "1\n2\n3\n\na b"),
    ("<style>p{content:'}display:none'} .x{display:none}</style><p>a</p><p class=x>n</p>", "a"),
    ("<p class=A>x</p><style>.a{display:none}</style>", "x"),
])
def test_cascade(page, text):
    assert render(page) == text


def test_wide_cells_are_aligned():
    for n in (40, 41, 500):
        long = "x" * n
        assert render(f"<table><tr><td>{long}<td>b<tr><td>a<td>c</table>") == f"{long}  b\na{' ' * (n + 1)}c"
    # One cell is too wide for the page; the others are aligned all the same.
    page = "<table><tr><td>" + "x" * 200_000 + "<td>y" + "<tr><td>abc<td>b<tr><td>a<td>d" * 3000 + "</table>"
    lines = render(page).split("\n")
    assert lines[0] == "x" * 200_000 + "  y" and lines[1:3] == ["abc  b", "a    d"]


def test_lists_of_any_depth():
    deep = render("<ul><li>t" * 400)
    assert [line.rstrip() for line in deep.split("\n")] == ["  " * i + "- t" for i in range(400)]
    assert render("<blockquote>" * 300 + "q") == "  " * 300 + "q"
    hostile = render("<ul><li>t" * 30_000).split("\n")
    assert len(hostile) == 30_000 and hostile[-1] == "{59998} - t"


@pytest.mark.parametrize("opened", ["<div>", "<p><div>", "<b>", "<ul><li>", "<ul><li>t", "<table><tr><td>", "<table><tr><td>a<td>", "<blockquote>q", "<svg><g>", "<span class=a>", "<p>", "<dl><dd>", "<a '\"><i>", "<a x=\" y=' >"])
def test_markup_takes_linear_time(opened):
    def seconds(n):
        page = "<style>.a .a,div>div{visibility:visible}</style>" + opened * n + "end"
        start = time.process_time()
        assert "end" in render(page)
        return time.process_time() - start

    seconds(500)
    few = seconds(10_000)
    assert seconds(40_000) < 10 * few + 0.5
