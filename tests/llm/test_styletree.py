import math

import pytest

from pagetables.llm import styletree as tree

PAGES = "page_id long, url string, html string, text string"


def text(html):
    return tree.page_text(tree.read_page(html), frozenset())


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<body><p>one<p>two\n <b>three</b>four", "one\ntwo threefour"),
    ("<nav>menu</nav><article><h1>T</h1><p>a<br>b</p><aside>x</aside></article><footer>f</footer>", "T\na b"),
    ("<article><p>in</p></article><p>out</p>", "in"), ("<article></article><p>out</p>", "out"),
    ("<div class='ad'>x</div><div class='post-content'>y</div>", "y"), ("<div id=comments><p>c</p></div>z", "z"),
    ("<p>a<script>var t='</p>';</script>b</p><style>p{}</style>", "ab"), ("<p>a<!-- <p>no</p> -->b", "ab"),
    ("<article><p>cut &copy; &am", "cut © &am"), ("<article><p>cut<p cla", "cut"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<form>f</form><p hidden>h</p><p style='display: none'>s</p><p>k</p>", "k"),
    ("<p>5 < 6 &lt; 7</p>", "5 < 6 < 7"), ("<title>t</title><p>x&nbsp;  y</p>", "x y"), ("</p></div>stray", "stray"),
    ("<article><div class=comment-list><p>reader</div><p>kept</article>", "kept"),
])
def test_page_text(html, want):
    assert text(html) == want


def shop(n, frame="All goods by post. No returns.", host="s.example"):
    body = "<div class=x1><p>{0}</p></div><div class=x2><p>Story {1} of many</p><p>Line {1} b</p></div>"
    return [(i, f"http://{host}/{i}", body.format(frame, i), "clash") for i in range(n)]


@pytest.mark.parametrize("broadcast_nodes", [1000, 0])
def test_tree_removes_what_a_site_repeats(spark, broadcast_nodes):
    rows = shop(20) + [(100 + i, "http://one.example/x", shop(1)[0][2], "c") for i in range(30)] + [(900, None, None, None), (901, "", "", "")]
    rows += [(500 + i, f"http://a.example/{i}", f"<article><div class=teaser><p>Same here</p></div><p>Same text</p><p>New {i}</p></article>", "") for i in range(12)]
    got = {r.row.page_id: r.text for r in tree.main_text(spark.createDataFrame(rows, PAGES), broadcast_nodes=broadcast_nodes).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Story 3 of many\nLine 3 b"
    assert got[101] == "All goods by post. No returns.\nStory 0 of many\nLine 0 b"  # copies of one page count once
    assert got[505] == "Same text\nNew 5"
    assert got[900] == got[901] == ""
    assert tree.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_importance_is_the_entropy(spark):
    counts = tree.node_counts(spark.createDataFrame(shop(16), PAGES))
    assert sorted(r.c for r in counts.filter("kind = 'text'").collect()) == [1] * 32 + [16]
    nodes = {r.path: r for r in tree.node_importance(counts, weight=0.25).collect()}
    frame, story = nodes[">div.x-1"], nodes[">div.x-2"]
    # one layout on all pages has no entropy; one text on all pages has all, texts on one page each none
    assert (frame.m, story.m) == (16, 16) and abs(frame.importance) < 1e-9 and abs(story.importance - 0.75) < 1e-9


def test_host():
    assert [tree.host_of(u) for u in (None, "", "x", "http://A.example:80/p", "//b.example?q", "https://u@c.example#f")] == [
        "", "", "", "a.example", "b.example", "c.example"]


@pytest.mark.parametrize("page", [
    '<div class="content with-sidebar"><p>the text</p></div>', '<main class="has-comments"><p>the text</p></main>', '<article class="post category-social"><p>the text</p></article>',
    '<article class="social"><p>the text</p><div class="ad">buy</div></article>', '<div class="side"><article><p>the text</p></article></div>',
    '<article><div class="entry has-comments"><p>the text</p></div></article>', '<div id="widget"><p>the text</p></div><div class="share">tweet</div>'])
def test_frame_words_do_not_take_the_main_text(page):
    assert tree.page_text(tree.read_page(f"<body>{page}</body>"), frozenset()) == "the text"


def test_a_page_cut_off_in_attributes_is_read_in_linear_time():
    assert tree.read_page("<p>x</p><a " + "b c=d " * 20_000).blocks[0].text == "x"


def test_features_are_worked_out_once(spark):
    pages = spark.createDataFrame(shop(20), PAGES)
    plan = tree.node_importance(tree.node_counts(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("MapInArrow") == 1


def test_nodes_without_text_are_not_judged(spark):
    counts = spark.createDataFrame(
        [("h", ">ul", "layout", 1, 3), ("h", ">div", "layout", 2, 2), ("h", ">div", "layout", 3, 2),
         ("h", ">div", "text", 4, 4), ("h", "", "text", 5, 4)],
        "host string, path string, kind string, feature long, c long")
    row, = tree.node_importance(counts).collect()
    assert (row.path, row.m) == (">div", 4) and row.importance == pytest.approx(0.1 * (1 - 4 * math.log(2) / 4 / math.log(4)))
