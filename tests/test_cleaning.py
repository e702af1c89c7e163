"""Cleaning on small inline pages: what is removed, counted and extracted."""

import re

import pytest

from pagetables.functions import fixed

SAMPLE = {
    ".": lambda s: f'<p class="a {s[1:]}">gone</p>',
    "#": lambda s: f'<p id="{s[1:]}">gone</p>',
}


def element_for(selector):
    """A small element that the selector matches."""
    if selector.startswith("script:not"):
        return "<script>gone</script>"
    if selector[0] in SAMPLE:
        return SAMPLE[selector[0]](selector)
    if m := re.fullmatch(r'\[([\w-]+)\*?="(.*)"\]', selector):
        return f'<p {m[1]}="x{m[2]}y">gone</p>' if "*" in selector else f'<p {m[1]}="{m[2]}">gone</p>'
    if selector.startswith("["):
        return f"<p {selector[1:-1]}>gone</p>"
    if selector in fixed.VOID_TAGS:
        return f"<{selector}>"
    return f"<{selector}>gone</{selector}>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "meta": page("", '<meta name="n" content="a &amp; b"><meta property="p" content="c">'
                     '<meta name="m" property="q" content="d"><meta name="e" content="">'
                     '<meta charset="utf-8" content="x">'),
    "nested_same": page('<div class="ad">a<div class="ad">b</div></div>x'),
    "nested_later": page('<svg><g class="hidden">a</g></svg>x'),
    "nested_earlier": page('<div class="ad">a<i class="hidden">b</i></div>x'),
    "near_miss": page('<i class="lead-text">a</i><i style="DISPLAY:NONE">b</i>'
                      '<i style="display:  none">c</i>'),
    "article_header": page("<article><header><h1>lost</h1></header><h2>kept</h2></article>"),
    "body_hidden": '<html><body class="modal">x<h1>y</h1></body></html>',
    "headings": page("<h2>b</h2><h1>a <i>i</i></h1><h3>c</h3><h1> </h1><h2>d</h2>"),
    "nested_list": page("<ul><li>a<ul><li>b<li>c</ul></li><li> </li><li>d</ul><ol><li>e</ol>"
                        "<ul></ul>"),
    "table": page("<table><tr><th>H<th> <td>x<tr><td>1<td><tr><td> <td></td></tr>"
                  "<tr><td><table><tr><td>in</table></table><table></table>"),
    "images": page('<img><img src=""><img src="data:x"><img src="/a"><img src=/b alt="">'
                   '<img src="/c" alt=" t ">'),
    "links": page('<a href="#a">1</a><a href="javascript:x">2</a><a href="mailto:m">3</a>'
                  '<a href="/e"></a><a href="">4</a><a>5</a><a href=/r/>6</a>'),
    "buttons": page('<button>a</button><div role="button">b</div><input type="submit" value="c">'
                    '<input type="BUTTON" value="d"><i class="x btn">e</i><i class="button"></i>'
                    '<input type="text" value="no"><button></button>'),
    "json_ld": page("<script type='application/ld+json'> {\"b\":1,\"a\":[]} </script>"
                    '<script type="application/ld+json">{bad</script>x'),
    "text_order": page('<div title="t" aria-label="l">x<img alt="a" title="i"><p alt="no">y</div>'),
    "repeat": page("<p>A<p>A<p>B<p>A"),
    "spaces": page("<h1> ﻿ a  b  </h1>"),
    "body_start": "<html><head><title>Title</title></head><body>in</body></html>after",
    "no_body": "<title>T</title><p>first",
    "stray": page('<p title="a > b">1 < 2 <3 & 4<!-- c -->5<br/>6'),
    "nested_links": page("<a href=/1>one<a href=/2>two</a><p><button>a<button>b</button></button>c"),
    "zeros": page("<p>&#x000000041;&#00000000065;&#x110000;&#99999999999999999999;"),
    "all_names": page("<p>&check;&phone;&notit;&NotEqualTilde;<a href='/?a=1&copy=2&check;'>x</a>"),
    "text_nodes": page("<p>a</b>b</p>c<!-- x -->d</p>e<script>s</script>f<!doctype x>g"),
    "entities": page("<p>&lt;&eacute;&#233;&#xe9;&#128;&nope;&copy &#0;&apos;"),
    "unclosed": page('<section><div class="ad">a<p>b</section>kept'),
    "crossing": page('<section class="modal"><div>a</section></div>kept'),
    "textarea": page("<textarea>a <b>c</b> &amp;</textarea><iframe>gone</iframe>"),
    "cut_off": '<html><body><p>a</p><a href="x',
    "unclosed_script": page("a<script>var x = '<p>gone</p>'"),
    "upper": "<HTML><BODY><NAV>n</NAV><H1 CLASS='Hidden'>a</H1></BODY></HTML>",
    "empty": "",
    "none": None,
}


@pytest.fixture(scope="module")
def result(clean):
    return clean(CASES)


def texts(rows, key="text"):
    return [r[key] for r in rows]


def test_every_selector_removes_and_counts_once(clean):
    groups = [fixed.TECHNICAL_SELECTORS, fixed.HIDDEN_SELECTORS, fixed.BOILERPLATE_SELECTORS]
    cases = {s: page(element_for(s) + "<p>kept") for group in groups for s in group}
    cases[fixed.JSON_LD_SELECTOR] = page('<script type="application/ld+json">{}</script><p>kept')
    rows = clean(cases)
    for n, group in enumerate(groups):
        for selector in group:
            row = rows[selector]
            assert row["visible_text"] == "kept", selector
            counts = [0, 0, 0]
            counts[n] = 1
            assert row["removed_by_group"] == counts, selector
    assert rows[fixed.JSON_LD_SELECTOR]["elements_removed"] == 0
    assert rows[fixed.JSON_LD_SELECTOR]["cleaned_html"] == "<p>kept</p>"


def test_meta(result):
    assert result["meta"]["meta"] == [
        {"name": "n", "property": None, "content": "a & b"},
        {"name": None, "property": "p", "content": "c"},
        {"name": "m", "property": "q", "content": "d"},
    ]


def test_removal_counts(result):
    assert result["nested_same"]["removed_by_group"] == [0, 0, 2]
    assert result["nested_later"]["removed_by_group"] == [1, 0, 0]
    assert result["nested_earlier"]["removed_by_group"] == [0, 1, 1]
    assert result["near_miss"]["visible_text"] == "b\nc"
    assert result["body_hidden"]["visible_text"] == result["body_hidden"]["cleaned_html"] == ""


def test_headings(result):
    assert texts(result["article_header"]["headings"]) == ["kept"]
    assert [(h["level"], h["text"]) for h in result["headings"]["headings"]] == [
        (1, "a i"), (2, "b"), (2, "d"), (3, "c")]
    assert texts(result["spaces"]["headings"]) == ["a  b"]


def test_lists(result):
    assert [(x["type"], x["items"]) for x in result["nested_list"]["lists"]] == [
        ("unordered", ["abc", "b", "c", "d"]), ("unordered", ["b", "c"]), ("ordered", ["e"])]


def test_tables(result):
    outer, inner = result["table"]["tables"]
    assert outer["headers"] == ["H"]
    assert outer["rows"] == [["x"], ["1", ""], ["in", "in"], ["in"]]
    assert inner == {"headers": [], "rows": [["in"]]}


def test_images_links_buttons(result):
    assert [(x["src"], x["alt"]) for x in result["images"]["images"]] == [
        ("/a", None), ("/b", ""), ("/c", " t ")]
    assert [(x["text"], x["href"]) for x in result["links"]["links"]] == [
        ("3", "mailto:m"), ("6", "/r/")]
    assert texts(result["buttons"]["buttons"]) == ["a", "b", "c", "d", "e"]


def test_json_ld(result):
    assert result["json_ld"]["json_ld"] == ['{"b":1,"a":[]}']
    assert result["json_ld"]["visible_text"] == "x"


def test_text(result):
    assert result["text_order"]["visible_text"] == "l\nt\nx\ni\na\ny"
    assert result["repeat"]["visible_text"] == "A\nB\nA"
    assert result["body_start"]["visible_text"] == "inafter"
    assert result["no_body"]["visible_text"] == "first"
    assert result["stray"]["visible_text"] == "a > b\n1 < 2 <3 & 4\n5\n6"
    assert result["entities"]["visible_text"] == "<ééé€&nope;© �'"
    nested = result["nested_links"]
    assert [(x["text"], x["href"]) for x in nested["links"]] == [("one", "/1"), ("two", "/2")]
    assert texts(nested["buttons"]) == ["a", "b"]
    assert result["zeros"]["visible_text"] == "AA\ufffd\ufffd"
    assert result["all_names"]["visible_text"] == "✓☎¬it;≂̸\nx"
    assert result["all_names"]["links"][0]["href"] == "/?a=1&copy=2✓"
    assert result["text_nodes"]["visible_text"] == "ab\nc\nd\ne\nfg"
    assert result["textarea"]["visible_text"] == "a <b>c</b> &"
    assert result["upper"]["visible_text"] == "a"


def test_malformed(result):
    assert result["unclosed"]["visible_text"] == "kept"
    assert result["crossing"]["visible_text"] == "kept"
    assert result["cut_off"]["visible_text"] == "a"
    assert result["unclosed_script"]["visible_text"] == "a"
    for name in ["empty", "none"]:
        assert result[name]["visible_text"] == "" and result[name]["headings"] == []


def test_stats(result):
    row = result["repeat"]
    assert row["cleaned_html"] == "<p>A</p><p>A</p><p>B</p><p>A</p>"
    assert (row["original_length"], row["cleaned_length"]) == (len(CASES["repeat"]), 32)
    assert row["token_estimate"] == 2


# Page and what a parser's serialiser gives for its cleaned body.
WRITTEN = {
    "<p>a<p>b<br/>&copy;": "<p>a</p><p>b<br>©</p>",
    "<P CLASS='A\"' id=x Id=y data-e>1 < 2 &amp; 3 > 2&nbsp;</P>":
        '<p class="A&quot;" id="x" data-e="">1 &lt; 2 &amp; 3 &gt; 2&nbsp;</p>',
    "<ul><li>a<li><b>b</b><ol><li>c</ol></ul>d": "<ul><li>a</li><li><b>b</b><ol><li>c</li></ol></li></ul>d",
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<div><nav>x<p>y</nav><p>z</div>": "<div><p>z</p></div>",
    "<table><tr><th>H<td>1<tr><td>2</table>x":
        "<table><tbody><tr><th>H</th><td>1</td></tr><tr><td>2</td></tr></tbody></table>x",
    "<table><thead><tr><td>a</thead><tr><td>b<tbody><tr><td>c</table>":
        "<table><thead><tr><td>a</td></tr></thead><tbody><tr><td>b</td></tr></tbody>"
        "<tbody><tr><td>c</td></tr></tbody></table>",
    "<table><td>a<td>b<tr><td>c</tr><td>d</table>":
        "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></tbody></table>",
    "<table><tr hidden><td>a<tr><td><table><tr><td>i</table>b</table>":
        "<table><tbody><tr><td><table><tbody><tr><td>i</td></tr></tbody></table>b</td></tr></tbody></table>",
    "<table class=ad><tr><td>a</table>b": "b",
    "a</p>b</br>c</i>d": "a<p></p>b<br>cd",
    "<!-- c --><!--u--!>x<!-->y<!foo>z<?pi?></3>": "<!-- c --><!--u-->x<!---->y<!--foo-->z<!--?pi?--><!--3-->",
    "<textarea>a <b> &lt;</textarea><xmp>1 < 2 &amp;</xmp>": "<textarea>a &lt;b&gt; &lt;</textarea><xmp>1 < 2 &amp;</xmp>",
    "<a href='?a=1&b=2'>x<a>y</a><img src=i>": '<a href="?a=1&amp;b=2">x</a><a>y</a><img src="i">',
    "<select><option>1<option selected>2</select>": '<select><option>1</option><option selected="">2</option></select>',
    "\U0001d11e<p>é\U0001f600": "\U0001d11e<p>é\U0001f600</p>",
    "<p>cut <a href='": "<p>cut </p>",
}


def test_written_out_again(clean):
    rows = clean({f"{n}": page(body) if not body.startswith("<p>cut") else body for n, body in enumerate(WRITTEN)})
    for n, (body, expected) in enumerate(WRITTEN.items()):
        row = rows[f"{n}"]
        assert row["cleaned_html"] == expected, body
        assert row["cleaned_length"] == len(expected.encode("utf-16-be")) // 2


def test_cleaning_what_was_written_changes_nothing(clean):
    once = clean({k: v for k, v in CASES.items() if v and k not in ("crossing", "zeros", "entities")})
    twice = clean({k: f"<html><head></head><body>{r['cleaned_html']}</body></html>" for k, r in once.items()})
    for name, row in once.items():
        assert twice[name]["cleaned_html"] == row["cleaned_html"], name
        if name != "text_nodes":  # texts around a removed element are one text node when read again
            assert twice[name]["visible_text"] == row["visible_text"], name


def test_documents(spark, result):
    from pagetables.operators.documents import documents
    from pagetables.operators.elements import clean_pages

    html = page('<ol><li>a</ol><table><tr><th>H<tr><td>1<td>2</table><img src="/i" alt="t">'
                + '<a href="/x">l</a>' * 31, '<meta name="" property="" content="c">')
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    lines = documents(clean_pages(pages)).head()["document"].split("\n")
    assert lines[:9] == ["URL: u", "", "## META", "", "## MAIN CONTENT", "a", "H", "1", "2"]
    assert lines[9:] == [
        "t", "l", "", "## TABLES", "Table 1:", "Headers: H", "Row: 1 | 2", "", "## IMAGES",
        "- /i (alt: t)", "", "## LISTS", "List 1 (ordered):", "1. a", "", "## LINKS",
        *["l → /x"] * 30, "", "", fixed.CLOSING_LINE]
