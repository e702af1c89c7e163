"""Misnested tags: the trees that the HTML standard prescribes, and what holds for any tags."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetables.operators.elements import clean_pages
from pagetables.operators.nesting import AS_IS, END, FORMATTING, new_order

# Pages whose trees the standard gives, or that follow from its rules by hand.
GOLDEN = {
    "<b>a<p>b</b>c</p>": "<b>a</b><p><b>b</b>c</p>",
    "<a><div></a>x</div>": "<a></a><div><a></a>x</div>",
    "<p>1<b>2<i>3</b>4</i>5</p>": "<p>1<b>2<i>3</i></b><i>4</i>5</p>",
    "<b>1<p>2</b>3</p>": "<b>1</b><p><b>2</b>3</p>",
    "<b>1<i>2<p>3</b>4</p>": "<b>1<i>2</i></b><i><p><b>3</b>4</p></i>",
    "<b><div><p>x</b>y</p></div>": "<b></b><div><b></b><p><b>x</b>y</p></div>",
    "<p><b>a</p><p>c</b>d</p>": "<p><b>a</b></p><p><b>c</b>d</p>",
    "<ul><li><b>a<li>b</b></ul>": "<ul><li><b>a</b></li><li><b>b</b></li></ul>",
    "<a href=1><p>x</a>y": '<a href="1"></a><p><a href="1">x</a>y</p>',
    "<p><span>x</p>y</span>z": "<p><span>x</span></p>yz",
    "<h1>a</h2>b": "<h1>a</h1>b",
    "<p><b class=x><b class=x><b><b class=x><b class=x><b>X<p>X<p><b><b class=x><b>X<p>"
    "</b></b></b></b></b></b>X":
        '<p><b class="x"><b class="x"><b><b class="x"><b class="x"><b>X</b></b></b></b></b></b></p>'
        '<p><b class="x"><b><b class="x"><b class="x"><b>X</b></b></b></b></b></p>'
        '<p><b class="x"><b><b class="x"><b class="x"><b><b><b class="x"><b>X'
        "</b></b></b></b></b></b></b></b></p><p>X</p>",
    # content that may not stand in a table goes before it
    "<table><b><tr><td>aaa</td></tr>bbb</table>ccc":
        "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>",
    "<table>x<tr><td>1</table>": "x<table><tbody><tr><td>1</td></tr></tbody></table>",
    "<table><div>q<tr><td>1</table>r": "<div>q</div><table><tbody><tr><td>1</td></tr></tbody></table>r",
    "<table><tr><td><b>x</td><td>y</b></table>z":
        "<table><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z",
    "<table><tr><td><table>i<tr><td>1</table></table>":
        "<table><tbody><tr><td>i<table><tbody><tr><td>1</td></tr></tbody></table></td></tr></tbody></table>",
    # elements of HTML end svg and math
    "<math><mrow><p>x</math>y": "<math><mrow></mrow></math><p>xy</p>",
}


@pytest.fixture(scope="module")
def trees(spark):
    pages = spark.createDataFrame(
        [(n, "u", f"<body>{html}</body>") for n, html in enumerate(GOLDEN)],
        "page_id long, url string, html string")
    rows = clean_pages(pages, ["cleaned_html", "original_length"], rules=[], in_tree_order=True).collect()
    return {list(GOLDEN)[r.page_id]: r for r in rows}


@pytest.mark.parametrize("html", GOLDEN)
def test_tree_of_the_standard(trees, html):
    assert trees[html].cleaned_html == GOLDEN[html]
    assert trees[html].original_length == len(f"<body>{html}</body>")


def test_element_tables_follow_the_tree(spark):
    html = ("<body><h2>a<b>b</h2>c</b><table>x<tr><td>1<td><i>2</table>"
            "<ul><li><em>d<li>e</em></ul></body>")
    pages = spark.createDataFrame([(0, "u", html)], "page_id long, url string, html string")
    [row] = clean_pages(pages, ["headings", "tables", "lists", "visible_text"], in_tree_order=True).collect()
    row = row.asDict(recursive=True)
    assert row["headings"] == [{"level": 2, "text": "ab"}]
    assert row["tables"] == [{"headers": [], "rows": [["1", "2"]]}]
    assert row["lists"] == [{"type": "unordered", "items": ["d", "e"]}]
    assert row["visible_text"] == "a\nb\nc\nx\n1\n2\nd\ne"


def test_null_empty_and_very_deep_pages(spark):
    deep = "<b>x<p>" * 300 + "</b>y"
    rows = [(0, "u", None), (1, "u", ""), (2, "u", "</b></table>"), (3, "u", deep), (4, "u", "<tr><caption>c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in clean_pages(pages, ["cleaned_html", "visible_text"], rules=[], in_tree_order=True).collect()}
    assert [got[n].cleaned_html for n in (0, 1, 2)] == ["", "", ""]
    assert got[3].visible_text == "x\ny"
    assert len(got) == 5


TAGS = ["b", "i", "a", "em", "p", "div", "span", "ul", "li", "h1", "table", "tr", "td", "button", "section", "select",
        "option", "caption", "tbody", "object", "svg", "br"]
PIECES = st.lists(
    st.one_of(st.sampled_from(["#text", "#space", "#comment"]), st.sampled_from(TAGS), st.sampled_from([f"/{t}" for t in TAGS])),
    max_size=40)


def applied(names, order):
    out = []
    for entry in order:
        tag = re.sub("[/=].*", "", names[entry // 3])
        out.append(f"/{tag}" if entry % 3 == END else names[entry // 3])
    return out


@settings(max_examples=600, deadline=None)
@given(PIECES)
def test_new_order_is_nested_and_keeps_the_text(names):
    order = new_order(names)
    if order is None:
        return
    as_is = [entry // 3 for entry in order if entry % 3 == AS_IS]
    assert len(as_is) == len(set(as_is))
    kept = {n for n, name in enumerate(names) if name[0] == "#"}
    assert kept <= set(as_is)
    if "table" not in names:
        assert as_is == sorted(as_is)
    stack = []
    for name in applied(names, order):
        if name[0] == "#" or name in ("br", "/br"):
            continue
        if name[0] != "/":
            stack.append(name)
        elif name != "/p" or (stack and stack[-1] == "p"):
            assert stack.pop() == name[1:]
    assert not stack
    assert FORMATTING >= {names[e // 3] for e in order if e % 3 == 1}
