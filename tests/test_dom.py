import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quarryline.operators import dom


def test_selectors():
    root = dom.parse('<div class="a b"><p id=x>1</p><span class="PriceTag">2</span></div><div class="grid"><p><img src="/i"></p></div>')
    assert dom.find(root, 'div[class="a b"]').classes == ["a", "b"]
    assert dom.find(root, 'div[class="b"]') is None
    assert dom.find(root, "div.b") is not None
    assert dom.text_raw(dom.find(root, 'span[class*="price"]')) == "2"
    assert dom.find(root, "div.grid img").attrs["src"] == "/i"
    assert dom.find(root, "#x >> parent").classes == ["a", "b"]
    assert dom.find(root, "span >> previous").attrs["id"] == "x"
    assert dom.find(root, "#x >> next img") is not None


def test_next_looks_inside_first():
    root = dom.parse("<div><p>before</p><h5>বই সংক্ষেপ</h5></div><p>after</p>")
    assert dom.text_raw(dom.find(root, 'h5:has-string("বই সংক্ষেপ") >> parent >> next p')) == "before"


def test_texts():
    root = dom.parse("<td>A <b>B</b><script>no</script><!-- c --></td>")
    td = dom.find(root, "td")
    assert (dom.text_strip(td), dom.text_space(td), dom.text_raw(td)) == ("AB", "A B", "A B")
    assert td.inner_html() == "A <b>B</b><script>no</script><!-- c -->"
    assert dom.find(dom.parse('<p a="&quot;&lt;">x &amp; y<br></p>'), "p").inner_html() == "x &amp; y<br/>"


def test_malformed():
    root = dom.parse("</b><div><b>x<p>y</div>z</p><td")
    assert dom.text_raw(root) .startswith("xyz")


def test_spec_rows():
    html = "<table><tr><th>h</th></tr><tr><td>K</td><td>1</td><td>2</td></tr></table><table><tr><td> k2 </td></tr></table>"
    rows = dom.spec_rows(dom.parse(html), "table tr")
    assert [(r["key"], r["v1"], r["vlast"], r["n_td"], r["table_idx"]) for r in rows] == [("K", "1", "2", 3, 0), ("k2", None, "k2", 1, 1)]
    assert len(dom.spec_rows(dom.parse(html), "table tr", first_table=True)) == 1


def test_deep_nesting():
    assert dom.text_raw(dom.parse("<div>" * 20_000 + "x")) == "x"


@given(st.text(alphabet='<>/="! abdivp-&;#x[]', max_size=200))
def test_never_raises(html):
    root = dom.parse(html)
    root.inner_html(), dom.text_strip(root), dom.spec_rows(root, "table tr")


def by_tokenizer(html):
    """The tree that the standard tokenizer alone makes."""
    builder = dom._Builder()
    dom._by_tokenizer(builder, html)
    return builder.shut()


def shape(root):
    return [(e.name, e.attrs, e.at, e.end, [c if isinstance(c, tuple) else c.at for c in e.children]) for e in root.document]


PIECES = ["<div>", "</div>", "<p class='a b' id=\"x\">", "</p>", "<br/>", "<img src='/i?a=1&amp;b=2'>", "<a href=foo>", "<a b=c/>", "<a\nb = 'c'>", "<A B='C'>", "</A >", "</ a>", "<a b='c'd>", "x", " &amp; ", "&am", "& ", "&#65;", "&notit;", "<", " < 3", "<3", "<!-- c -->", "<!-- a > b < c -->", "<!-->", "<!--->", "<!-- - -- -->", "<!DOCTYPE html>", "<!doctype>", "<!x>", "<![CDATA[ q ]]>", "<?php x ?>", "</>", "<script>", "</script>", "<script src='a&b'>", "if (a<b && '</div>') x", "<script>var a = '<p>' + 1</script>", "<style>p > a {}</style>", "<title>a &amp; b</title>", "<title>", "</title>", "<textarea><p></textarea>", "<iframe>", "<plaintext>", "</scrip", "<div", "ৎ", "<ſ>", "<p ſ='1'>", "<div/>", "<td", "</SCRIPT >", "<p a='1' a='2' b>", "<p a=\"'\" b='\"'>", "\r\n", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@example("<script>a</script><p>")
@example("<script/>a<p></script>")
@example("<title>a<b></title>c")
def test_plain_reading_equals_the_tokenizer(html):
    assert shape(dom.parse(html)) == shape(by_tokenizer(html))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/=\"'! abdivp-&;#x[]?\n", max_size=60))
def test_any_text_equals_the_tokenizer(html):
    assert shape(dom.parse(html)) == shape(by_tokenizer(html))


def plain_select(root, css):
    """Every element, tested from right to left."""
    *outer, last = dom._path(css)
    for e in root.document[root.at + 1 : root.end + 1]:
        node, need = e.parent, len(outer)
        while node is not None and need:
            need -= outer[need - 1](node)
            node = node.parent
        if last(e) and not need:
            yield e


@pytest.mark.parametrize("css", ["p", "*", ".a", "#x", "div .a", "div p.b", 'p[class="a b"]', 'p[class="b"]', '[class*="A"]', "[id]", "p#x.a", "div div p", 'p:has-string("1")', "td"])
def test_index_finds_what_a_walk_finds(css):
    draw = random.Random(css)
    for _ in range(30):
        html = "".join(draw.choice(["<div class=' a '>", "</div>", "<p class='a b'>1", "</p>", "<p id=x class=b>2", "<p class='a a'>", "<br id='x'>", "<td>"]) for _ in range(40))
        root = dom.parse(html)
        for e in (root, *root.document[:4]):
            assert list(dom.select(e, css)) == list(plain_select(e, css))


@pytest.mark.parametrize("selector", ["", "p >> up", "p >> next", "p >> next a b", "p >> parent a", "p >> in", "p[", "p:first-child"])
def test_bad_selectors(selector):
    with pytest.raises(ValueError):
        dom.check_selector(selector)
