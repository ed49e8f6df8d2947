import re
from html import unescape

from faultline.llm import html_extract as H

ARTICLE = "<p>A first paragraph, with commas, that is long enough to count as text.</p><p>And a second one, also long enough, of the same article.</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS host", "html AS path", "url AS text")


def extracted(spark, rows):
    return {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}


def test_boilerplate_goes_and_text_stays():
    page = H.Page(
        "<html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>';</script></head><body class='has-sidebar'>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id=sideBar>side</div><div class='cookie-notice'>We use cookies, many of them.</div>"
        f"<div class='post'><h2>Head &amp; line&nbsp;</h2>{ARTICLE}<ul><li>one<li>two</ul><table><tr><td>cell<td>next</table>text <b>bold</b>\n\n more<br>line"
        "<div class=ad>Buy this now, it is very good.</div><form>Name <input><button>Go</button></form></div>"
        "<section class='comments'><p>I liked this a lot, thank you very much, all of you.</p></section><footer>&copy; us</footer></body></html>"
    )
    assert page.text(None).split("\n") == [
        "Head & line", "A first paragraph, with commas, that is long enough to count as text.", "And a second one, also long enough, of the same article.",
        "one", "two", "cell", "next", "text bold more line",
    ]


def test_broken_markup():
    assert H.Page("<article><p>cut &am").text(None) == "cut &am"
    assert H.Page("<p>one<p>two <a href='x'>link").text(None) == "one\ntwo link"
    assert H.Page("<article>x<div class=\"a").text(None) == "x"
    assert H.Page("a < b and <!-- gone --> c <!-- open").text(None) == "a < b and c"
    assert H.Page("</div></p><b>only").text(None) == "only"
    assert H.Page("<script>never closed <p>x").text(None) == ""
    assert H.Page("<div class=menu><article>" * 50_000 + "deep" + "</i></ul>" * 50_000).text(None) == "deep"
    assert len(H.Page("<div>" * 50_000 + "deep").ballot()) == H.BALLOT - 1


def test_the_host_decides(spark):
    story = f"<div class=story1>{ARTICLE}</div>"
    odd = "<div class=links><p>A long list of words, with commas, commas, commas, and more of the same, that would win on its own page alone by far.</p><p>More, more, more, and more, of such words as nobody wants to read in this place.</p></div>"
    rows = [(i, "http://h.org/a", f"<body>{story}</body>") for i in range(5)]
    rows += [(9, "http://h.org/b", f"<body><div class=story2><p>Short.</p></div>{odd}</body>"), (10, "http://other.org/", f"<body>{odd}</body>"), (11, None, f"<body>{story}</body>")]
    got = extracted(spark, rows)
    assert got[9] == "Short."  # alone it would have been the links
    assert got[10].startswith("A long list") and got[11].startswith("A first paragraph")
    frame = pages(spark, rows).select("page_id", "url", "html", H.host_of(H.F.coalesce("url", H.F.lit(""))).alias("host"))
    salted = H._with_path(frame, H.winning_paths(frame), n_hosts=10, broadcast_hosts=1)
    plain = H._with_path(frame, H.winning_paths(frame), n_hosts=10)
    assert sorted(map(str, salted.select("page_id", "path").collect())) == sorted(map(str, plain.select("page_id", "path").collect()))


def test_odd_rows(spark):
    big = "<article>" + "<p>paragraph of some length, with a comma.</p>" * 20_000 + "</article>"
    rows = [(1, "http://a/", None), (1, "http://a/", ""), (None, None, None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "http://a/", big), (4, "http://a/", "\x00 \x1f")]
    got = H.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2] == ["x", "x"]
    assert [r.text.count("\n") for r in got if r.page_id == 3] == [19_999]
    assert H.extract(pages(spark, rows).limit(0)).count() == 0


def test_given_pages_against_their_template(spark):
    """Every given page is one template, so its article can be cut out by text search."""
    from faultline.llm.catalog import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op10_html_extract"](spark, "/root/testdata/sf0.001").collect()}
    for row in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        want = [" ".join(unescape(re.sub(r"<[^>]*(>|\Z)", " ", b)).split()) for b in blocks]
        assert got[row.page_id] == "\n".join(filter(None, want))


def prose(name, n):
    return "".join(f"<p>{name} {i}, a long paragraph, with commas, and {'words ' * 60}</p>" for i in range(n))


def test_what_is_kept_does_not_depend_on_length():
    for n in (1, 5, 40):
        lead = "<h1>Headline</h1><p>The lead of the story, which is a sentence of its own.</p>"
        for page in (f"<article>{lead}<div class=body>{prose('b', n)}</div></article>", f"<div class=page>{lead}<div class=body>{prose('b', n)}</div></div>",
                     f"<div class=page>{lead}<div><div class=body>{prose('b', n)}</div></div></div>"):
            got = H.Page(f"<body><div class=menu>Menu of this page, with words</div>{page}<div class=other><a href=/>Links that go elsewhere, as many do</a></div></body>").text(None).split("\n")
            assert got[:2] == ["Headline", "The lead of the story, which is a sentence of its own."] and len(got) == n + 2
    parts = f"<div class=part-a>{prose('a', 20)}</div><div class=part-b>{prose('b', 4)}</div>"
    for page in (f"<article>{parts}</article>", f"<main>{parts}</main>", f"<div id=page>{parts}</div>"):
        assert H.Page(f"<body>{page}</body>").text(None).count("\n") == 23


def test_several_templates_of_a_host(spark):
    one = f"<body><article><h1>One</h1><p>The lead of the first, a sentence of its own.</p><div class=body>{prose('b', 30)}</div></article></body>"
    two = f"<body><article><h1>Two</h1><div class=part-a>{prose('a', 20)}</div><div class=part-b>{prose('b', 4)}</div></article></body>"
    short = "<body><article><h1>Three</h1><p>The lead of the third, a sentence of its own.</p><div class=body><p>Short.</p></div></article></body>"
    got = extracted(spark, [(i, "http://h.org/a", one) for i in range(4)] + [(8, "http://h.org/b", two), (9, "http://h.org/c", short)])
    assert got[0].startswith("One\nThe lead") and got[0].count("\n") == 31
    assert got[8].startswith("Two\n") and got[8].count("\n") == 24
    assert got[9] == "Three\nThe lead of the third, a sentence of its own.\nShort."
