"""Trees whose pages leave ends out, by hand, and pages that are made to be slow."""

import time

import pytest
from flowscope.operators.explore import _Elements, _Nodes
from flowscope.operators.scopes import Scopes
from flowscope.operators.states import tree_hash, tree_text


class Shape(Scopes):
    """The tree as text: tag(children)."""

    def __init__(self):
        super().__init__()
        self.open = [[]]

    def began(self, tag, attrs):
        node = [tag, []]
        self.open[-1].append(node)
        self.open.append(node[1])
        if tag in ("br", "img", "input", "hr"):
            self.open.pop()

    def ending(self, at):
        del self.open[at + 1 :]


def shape(html):
    show = lambda nodes: " ".join(t + (f"({show(c)})" if c else "") for t, c in nodes)
    p = Shape()
    root = p.open[0]
    p.read(html)
    return show(root)


@pytest.mark.parametrize(("html", "want"), [
    ("<ul><li>a<li>b<li>c</ul>", "ul(li li li)"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "ul(li(ul(li li)) li)"),
    ("<p>a<p>b<div>c</div><p>d<b>e</p>f", "p p div p(b)"),
    ("<p>a<button><p>b</button>", "p(button(p))"),
    ("<div><p>a</div><p>b", "div(p) p"),
    ("<select><option>a<option>b<optgroup><option>c<optgroup><option>d</select><i>", "select(option option optgroup(option) optgroup(option)) i"),
    ("<table><tr><td>a<td>b<tr><th>c<td>d</table>", "table(tr(td td) tr(th td))"),
    ("<table><thead><tr><th>a<tbody><tr><td>b<tr><td>c<tfoot><tr><td>d</table>", "table(thead(tr(th)) tbody(tr(td) tr(td)) tfoot(tr(td)))"),
    ("<table><tr><td><table><tr><td>a<td>b</table><td>c</table>", "table(tr(td(table(tr(td td))) td))"),
    ("<table><tr><td><p>a<td>b", "table(tr(td(p) td))"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dl(dt dd dt dd)"),
    ("<div>a</b></i>c<br>d</br></div><i>", "div(br) i"),
    ("<div><table><tr><td></div>x<i></table><b>", "div(table(tr(td(i))) b)"),
    ("<ul><li><div>a<li>b</ul>", "ul(li(div) li)"),
    ("<p><hr><img><input>", "p hr img input"),
])
def test_ends_that_are_left_out(html, want):
    assert shape(html) == want


def test_hashes_do_not_tell_left_out_ends_from_written_ones():
    assert tree_hash("<ul><li>a<li>b</ul><p>x<p>y") == tree_hash("<ul><li>a</li><li>b</li></ul><p>x</p><p>y</p>")
    assert tree_hash("<ul><li>a<li>b</ul>") != tree_hash("<ul><li>a<ul><li>b</ul></ul>")
    assert tree_text("<body id=x><p class='b a' class=c>q") == '{"tag":"body","id":"x","classes":[],"children":[{"tag":"p","classes":["a","b"]}]}'


def test_selectors_and_media_follow_the_tree():
    found = _Elements().read("<ul><li><a href=1>x</a><li><a href=2>y</a></ul><div hidden><button>z</button></div><button>t").found
    assert [e["selector"] for e in found][:2] == [f"ul:nth-of-type(1) > li:nth-of-type({k}) > a:nth-of-type(1)" for k in (1, 2)]
    assert [e["visible"] for e in found] == [True, True, False, True] and [e["text"] for e in found] == ["x", "y", "z", "t"]
    nodes = _Nodes().read("<main><section><p>a<canvas></canvas></section><section><p>b<video>").found
    assert [(n["tag"], n["media"]) for n in nodes] == [("main", True), ("section", True), ("p", True), ("canvas", False), ("section", True), ("p", True), ("video", False)]


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "</i>" * n,
    lambda n: "<div>" * n + "</p>" * n,
    lambda n: "<div hidden>" * n,
    lambda n: "<b>" * n + "<canvas></canvas>" * n,
    lambda n: "<b>" * n + "<li>" * n,
    lambda n: "<table><tr><td>" * n + "</div>" * n,
])
@pytest.mark.parametrize("reader", [_Nodes, Shape])
def test_time_grows_with_the_page_alone(make, reader):
    def seconds(n):
        html = make(n)
        began = time.perf_counter()
        reader().read(html)
        return time.perf_counter() - began

    small, large = min(seconds(4000) for _ in range(3)), seconds(32_000)
    assert large < 30 * small + 0.5


def test_trees_of_hostile_pages_end():
    began = time.perf_counter()
    assert len(tree_hash("<div>" * 30_000 + "</b>" * 30_000)) == 64
    _Elements().read("<i>" * 30_000 + "</b>" * 30_000)
    assert time.perf_counter() - began < 20
