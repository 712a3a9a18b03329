from veilcell.llm import html as hx

PAGE = """<!doctype html><html lang=en><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li><li>About</ul></nav>
<div id="cookie-notice">We use cookies, all of them.</div><!-- <p>hidden</p> -->
<main><h1>Title &amp; more</h1><p>First <b>bold</b>   text,
with lines.<p>Second &eacute; &#8211; x<br>y &lt;b&gt;.<div class="ad">Buy this now, please.</div>
<form><p>Your name<input name=n></p></form><section class="comments"><p>Nice article, I like it a lot.</p></section>
<aside>See also this, that.</aside><p style="display: none">unseen, words.</p><p>Third, with <a href="u?a=1>2">a link</a>, ends.</p></main>
<footer>&copy; 2024, all rights.</footer></body></html>"""
WANT = "Title & more\nFirst bold text, with lines.\nSecond é – x y <b>.\nThird, with a link, ends."


def run(spark, ws, rows):
    return hx.extract(ws, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()


def test_main_text(spark, ws):
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "http://a.example/2", ""), (1, "http://a.example/1", PAGE), (None, "x", "plain text only")]
    got = run(spark, ws, rows)
    assert sorted((repr(r.page_id), r.text) for r in got) == sorted([("1", WANT), ("1", WANT), ("2", ""), ("3", ""), ("None", "plain text only")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert run(spark, ws, []) == []


def test_ratios_tell_content_without_marked_article(spark, ws):
    links = "".join(f"<div class=x><a href=/{i}>word {i}</a></div>" for i in range(20))
    body = "".join(f"<div class=story><p>This is paragraph {i}, which has several words, marks; and an end.</p></div>" for i in range(6))
    rows = [(i, f"http://b.example/{i}", f"<html><body><div class=top>{links}</div>{body}<div class=bottom><p>go on</p></div></body></html>") for i in range(5)]
    for r in run(spark, ws, rows):
        assert r.text == "\n".join(f"This is paragraph {i}, which has several words, marks; and an end." for i in range(6))


def test_broken_markup():
    text = lambda s: [t for _, t in hx.Page(s).candidates()]
    assert text("<article><p>a<p>b</article>after <p>c") == ["a", "b"]
    assert text("<p>cut <b>off") == ["cut off"]
    assert text("a < b <3 c") == ["a < b <3 c"]
    assert text("<p>x</p></p></b><p title=\"unclosed>y</p><p>z") == ["x", "y", "z"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert text("<b><p>one</b> two</p>three") == ["one two", "three"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert text("<script>never ends <p>x") == []
    assert text("x&am; &amp y &amp;lt;") == ["x&am; & y &lt;"]
    assert len(text("<p>w" * 20_000)) == 20_000
    assert text("<div>" * 3000 + "deep") == ["deep"]


def test_short_blocks_of_the_article_stay(spark, ws):
    long = "<p>" + "This is a long paragraph, with several clauses, and it goes on. " * 5 + "</p>"
    short = "<ul><li>milk</li><li>bread</li></ul><table><tr><td>one</td><td>2</td></tr></table><h2>Next</h2>"
    marked = f"<article><header><h1>Title</h1></header>{long * 3}{short}<div class=text>{long}</div></article>"
    inner = f"<main><div class=top><h1>Title</h1></div><div class=text>{long * 3}{short}</div></main>"
    plain = f"<body><h1>Title</h1><div class=text>{long * 3}{short}</div><div class=links><div><a>go</a></div></div></body>"
    for name, page in (("m", marked), ("i", inner), ("p", plain)):
        got = run(spark, ws, [(i, f"http://{name}.example/{i}", page) for i in range(4)])
        for r in got:
            lines = r.text.split("\n")
            assert [t for t in lines if len(t) < 100] == ["Title", "milk", "bread", "one", "2", "Next"]
            assert len(lines) - 6 == page.count("This is a long paragraph") // 5


def test_class_tokens_of_wrappers_do_not_remove_the_article():
    text = lambda s: [t for _, t in hx.Page(s).candidates()]
    side = "<div class=related>See also</div>"
    for body in ("<main class=has-sidebar><p>Long story.</p>{}</main>", "<article class='post comment-open has-header'><p>Long story.</p>{}</article>",
                 "<div id=content class=with-sidebar><p>Long story, told in full.</p>{}</div><p>end</p>", "<div class=widget><article><p>Long story.</p>{}</article></div>"):
        want = [t for t in ("Long story.", "Long story, told in full.", "end") if t in body]
        assert text(f"<body>{body.format(side)}</body>") == want
    assert text("<main><p>One story.</p><div class=comments><article class=comment><p>Hm.</p></article></div></main>") == ["One story."]


def test_query_reads_the_articles(spark):
    import html
    import re

    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in hx.op6_html_extraction(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        assert got[p.page_id] == "\n".join(b for b in blocks if b)


def test_ids_of_headings_and_formulas_stay(spark, ws):
    page = """<body><article><h1 id=top>Sorting</h1><p>Long first paragraph, with words, marks and an end.</p>
<h2 id='search-algorithms'>Search algorithms</h2><p class=market-share>The share of x<math><mi>y</mi><mo>=</mo><mn>2</mn></math> is large, they say.</p>
<h2 id=related-work>Related work</h2><ul><li id="login">Item one, of the list.</li></ul><p class="share">Tell your friends!</p>
<div class=related>More of this, and that.</div><p>Last paragraph, with words, marks and an end.</p></article></body>"""
    want = ("Sorting\nLong first paragraph, with words, marks and an end.\nSearch algorithms\nThe share of xy=2 is large, they say.\n"
            "Related work\nItem one, of the list.\nLast paragraph, with words, marks and an end.")
    assert [r.text for r in run(spark, ws, [(1, "http://b.example/1", page)])] == [want]
