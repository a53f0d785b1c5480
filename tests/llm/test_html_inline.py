from loomwork.llm import html_text


def test_inline_elements_of_sentences_are_no_template(spark):
    page = lambda i: f"<body><article><p><b>Note:</b> sentence {i} has <a href='/x'>a <em>link</em></a>.</p><div><span>Share this</span></div></article></body>"
    rows = [(i, f"https://one.example/{i}", page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Note: sentence {i} has a link." for i in range(8)}
