from docloom.llm import html


def test_article_of_a_labelled_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav>
    <div class="ad">Buy now, cheap.</div><article><h1>A &amp; B</h1><p><b>First <i>para</i>,\n with text.<br><p>Second.</article><footer>&copy; me</footer>"""
    assert html.main_text(page) == "A & B\nFirst para, with text.\nSecond."


def test_page_without_article():
    page = """<body><div id="top-menu"><a href=x>Home</a></div><div class="content"><h1>Title</h1><p>First para, with text. More words here, yes.<p>Second &lt;x&gt;.
    <ul><li>One<li>Two</ul></div><div class="cookie-notice">We use cookies. Accept, please.</div><div id=comments><p>Nice post, thanks. Really.</div></body>"""
    assert html.main_text(page) == "Title\nFirst para, with text. More words here, yes.\nSecond <x>.\nOne\nTwo"


def test_odd_pages(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain text only", "x"), (4, "u", "<p" * 5000, "x"), (5, "u", "<div>" * 3000 + "deep. text, here" , "x"), (5, "u", "<p>a<!-- b", "x")], "page_id long, url string, html string, text string")
    out = [(r.page_id, r.text, r.n_chars) for r in html.extract(rows).orderBy("page_id", "text").collect()]
    assert out[0] == (1, "", 0) and out[1] == (2, "", 0) and out[2] == (3, "plain text only", 15)
    assert ("deep. text, here" in {t for _, t, _ in out}) and (5, "a", 1) in out
    assert html.extract(rows.limit(0)).count() == 0


def test_ratios_fuse_length_and_punctuation():
    blocks = [html.Block("body/div.a/p", "body/div.a", "Long text, with marks. And more.", 0, 0), html.Block("body/div.b/li", "body/div.b", "link", 4, 0)]
    ratios = html.ratios(blocks)
    assert ratios["body/div.a/p"] > 0 and ratios["body/div.b/li"] == 0
    assert html.content(blocks) == blocks[:1]


def test_every_page_of_the_table_against_a_plain_reading(spark):
    import html as h
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.sub(r"</?(?:b|br)>", " ", r.html.split("<article>", 1)[1].split("</article>")[0])
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert html.main_text(r.html) == "\n".join(x for x in parts if x)


def test_comments_marked_as_articles_and_pages_without_one():
    story = "".join(f"<p>Sentence one of part {i}, with commas, and more words. Another sentence, longer than the first, follows here.</p>" for i in range(6))
    plain = html.main_text(f"<html><body><div class='story'>{story}</div><div><a href='/a'>Home</a> <a href='/b'>About</a></div></body></html>")
    assert plain.count("Sentence one") == 6 and "Home" not in plain
    comment = "<article class='comment'><p>I liked this, really, a lot. Thank you, all of you, for it.</p></article>"
    got = html.main_text(f"<html><body><main><article>{story}</article>{comment}</main></body></html>")
    assert got == plain and "liked" not in got
