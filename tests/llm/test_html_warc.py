import hashlib
import time

import pytest
from pyspark.sql import functions as F

from loomwork.llm import html_text, warc
from loomwork.llm.common import work_dir


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four &eacute;&#233;&nbsp;x</article>", "A & B\n\none two three\n\nfour éé x"),
        ("<nav>menu</nav><header>site</header><main><p>text</p></main><footer>end</footer>", "text"),
        ("<body><p>plain <b>bold<p>next</body>", "plain bold\n\nnext"),
        ('<article><p>a</p><div class="ad">buy</div><div id="comments"><p>c</p></div><aside>s</aside><form>f</form><p>b</p></article>', "a\n\nb"),
        ("<script>var t='</p><article>x';</script><style>p{}</style><article><!-- note --><p>t</p></article>", "t"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\n\ny\n\n1\n\n2"),
        ("<article><header><h1>T</h1></header><p>cut off he", "T\n\ncut off he"),
        ("<article><p>cut tag <b", "cut tag"),
        ("<article><p>a < b &am; &amp</p></article>", "a < b &am; &"),
        ("<article><p>main</p><article class='comment'><p>reader</p></article></article>", "main"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<p class=\"add\">address</p>", "address"),
        ("<article><p>one</p><p class=x\">two</p><p>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<article><p>one</p><p it's>two</p><p>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<article><p>one</p><p class=\"x>two</p><p>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<article><p title='a > b' data-x = \"</p>\">one</p><a href=/x/>two</a></article>", "one\n\ntwo"),
        ("<main><p>body text that is long</p><article class=\"card\">teaser</article></main>", "body text that is long"),
        ("<main><p>lead</p><article><p>the article itself</p></article></main>", "the article itself"),
        ("<article><section id=\"search\"><p>on searching</p></section><p class=\"social-history\">on history</p></article>", "on searching\n\non history"),
    ],
)
def test_pages(source, text):
    assert html_text.Page(source).text() == text


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "x", "<p><button></button>" + "<div>" * 200_000 + "x", "<b>" * 100_000 + "x" + "</i></b>" * 100_000, "<li>" * 100_000 + "x", "<p " + "a='" * 100_000 + ">x", '<p a="' * 20_000 + ">x"])
def test_long_pages_take_linear_time(source):
    began = time.perf_counter()
    html_text.Page(source).text()
    assert time.perf_counter() - began < 20


def test_templates_decide_where_no_tag_does(spark):
    body = lambda i: f"<body><div><span>Home</span> <span>Shop</span></div><div><p>Own text {i} of this page.</p></div><div><p>All rights reserved</p></div></body>"
    rows = [(i, f"https://plain.example/{i}", body(i)) for i in range(9)] + [(100, "https://single.example/", body(100))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i} of this page." for i in range(9)} | {100: "Home Shop\n\nOwn text 100 of this page.\n\nAll rights reserved"}


def test_copies_of_an_article_are_no_template(spark):
    page = lambda i, body: f"<body><div><span>menu {i % 4}</span></div><article><div><div>{body}</div></div></article></body>"
    rows = [(i, f"https://copies.example/{i}", page(i, "the same article in other surroundings")) for i in range(12)] + [(100 + i, f"https://copies.example/n{i}", page(i, f"article {i}")) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "the same article in other surroundings" for i in range(12)} | {100 + i: f"article {i}" for i in range(20)}


def test_a_large_host_is_parted(spark):
    rows = [(i, f"https://large.example/{i}", f"<body><div>menu</div><div><p>text {i}</p></div></body>") for i in range(400)] + [(1000 + i, f"https://h{i}.example/", "<p>x</p>") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("other"), "template": F.lit(1), "kind": F.lit(0), "salt": F.lit(3)})
    found = html_text.main_text(df)
    got = {r.page_id: r.text for r in found.collect()}
    assert len(got) == 450 and all(got[i] == f"text {i}" for i in range(400))
    assert html_text.main_text(df.limit(0)).count() == 0


def test_templates_go_and_articles_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>same line</p><div><span>Join our list</span></div><p>own text {i}</p></article>") for i in range(12)]
    rows += [(20 + i, f"http://other.example/{i}", "<article><div>copied article</div></article>") for i in range(9)]
    rows += [(40, None, "<article><p>x</p></article>"), (41, "http://h.example/z", None), (None, "", ""), (40, None, "<article><p>x</p></article>")]
    got = {}
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[3] == [("same line\n\nown text 3", 21)]
    assert got[25] == [("copied article", 14)]
    assert got[40] == [("x", 1)] * 2 and got[41] == [("", 0)] and got[None] == [("", 0)]


def test_warc_round_trip(spark):
    big, other = "é" * 600, "z" * 999
    rows = [(1, "u1", big), (5, "u5\r\nX: y", big), (3, None, big), (2, "u2", other), (4, "u4", other), (6, "u6", None), (None, "u0", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == {1: (1200, sha(big), "revisit", 5), 5: (1200, sha(big), "response", None), 3: (1200, sha(big), "revisit", 5), 2: (999, sha(other), "response", None), 4: (999, sha(other), "response", None), 6: (0, sha(""), "response", None), None: (1200, sha(big), "response", None)}
    folder = work_dir(spark, "warc-test")
    index = warc.write(warc.records(df), folder)
    some = warc.read(index.where("page_id in (2, 5)"), folder, payload=True)
    assert {r.page_id: bytes(r.content).decode() for r in some.collect()} == {2: other, 5: big}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_ranges_are_coalesced():
    assert warc.coalesce([(0, 10), (10, 5), (100, 5), (300, 5)], gap=90, most=200) == [(0, 0, 105), (3, 300, 5)]
    assert warc.coalesce([(0, 10), (10, 10)], gap=0, most=15) == [(0, 0, 10), (1, 10, 10)]
