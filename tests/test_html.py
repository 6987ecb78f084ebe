import time

import pytest

from lodeseek.functions import html


def said(node):
    """A tree as compact markup."""
    if isinstance(node, str):
        return node
    attrs = "".join(f" {k}={v}" for k, v in node.attrs.items())
    inner = "".join(map(said, node.children))
    return f"<{node.tag}{attrs}>{inner}" + ("" if node.tag in html._VOID else f"</{node.tag}>")


def body(text):
    return "".join(said(c) for n in html.tree(text).children if n.tag == "body" for c in n.children)


@pytest.mark.parametrize("text,want", [
    # the standard's own examples
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
    ("<p><b class=x><b class=x><b><b class=x><b class=x><b>X<p>X<p><b><b class=x><b>X<p></b></b></b></b></b></b>X",
     "<p><b class=x><b class=x><b><b class=x><b class=x><b>X</b></b></b></b></b></b></p><p><b class=x><b><b class=x><b class=x><b>X</b></b></b></b></b></p>"
     "<p><b class=x><b><b class=x><b class=x><b><b><b class=x><b>X</b></b></b></b></b></b></b></b></p><p>X</p>"),
    # links and blocks
    ("<a href=a>x<a href=b>y", "<a href=a>x</a><a href=b>y</a>"),
    ("<a href=a><p>x<a href=b>y", "<a href=a></a><p><a href=a>x</a><a href=b>y</a></p>"),
    ("<b><i><div>x</b>y</i>z</div>w", "<b><i></i></b><i></i><div><i><b>x</b>y</i>z</div>w"),
    ("<i>1<div>2</i>3</div>4", "<i>1</i><div><i>2</i>3</div>4"),
    ("a</b>c</p>d", "ac<p></p>d"),
    # lists, headings, buttons
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>e"),
    ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<button>a<p>b</button>c<p>d", "<button>a<p>b</p></button>c<p>d</p>"),
    # tables
    ("<table>text<tr><td>c", "text<table><tbody><tr><td>c</td></tr></tbody></table>"),
    ("<table><tr><td><b>x<td>y</table>z", "<table><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z"),
    ("<table><td>a<table><td>b</table>c</table>d", "<table><tbody><tr><td>a<table><tbody><tr><td>b</td></tr></tbody></table>c</td></tr></tbody></table>d"),
    ("<table><caption>t<tbody><tr><th>h</table>", "<table><caption>t</caption><tbody><tr><th>h</th></tr></tbody></table>"),
    ("<td>a</td><tr>b", "ab"),
    ("<p>x<table><tr><td><p>y</table>z", "<p>x</p><table><tbody><tr><td><p>y</p></td></tr></tbody></table>z"),
    ("<b>x<object>y</object>z</b>w", "<b>x<object>y</object>z</b>w"),
])
def test_trees_of_the_standard(text, want):
    got = body(text)
    assert got == want
    assert body("<!DOCTYPE html><html><head><title>t</title></head><body>" + text) == want


def nodes(text):
    return sum(1 for _ in html.tree(text).walk())


@pytest.mark.parametrize("unit", ["<p><font color={}>x", "<b><div>x</b>", "<table><tr><td><b>{}", "<div>{}", "<a href={}><p>x", "</p><i>", "<li><b>x", "<table>x<b>{}", "<font color={}>x</p>"])
def test_time_follows_the_size(unit):
    def took(n):
        text = "".join(unit.format(i) for i in range(n))
        best = 1e9
        for _ in range(2):
            t = time.process_time()
            html.tag_texts(text)
            best = min(best, time.process_time() - t)
        return best

    a, b = took(1500), took(6000)
    assert b < 8 * a + 0.3, (a, b)  # four times the size


def test_every_node_is_in_its_parent():
    for text in ("<b>1<p>2</b>3<table><b>x<tr>y<td>z</b>", "<i><b><u><s><div>a</i>b</b>c</u>d</s>e", "<a><div><div><div><p>x</a>y"):
        for n in html.tree(text).walk():
            for c in n.children:
                assert isinstance(c, str) or c.parent is n
