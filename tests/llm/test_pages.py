from sensorloom.llm import pages


def test_blocks_entities_and_left_out_parts():
    source = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><p>Site</p></header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="layout no-sidebar"><article><header><h1>Title &amp; more</h1><span>By me</span></header>
    <p>First <b>bold<br>line&nbsp;here &lt;x&gt; &am<p>Second \n  para <a href="a>b">link</a>.<script>var t = "</p>";</script><ul><li>one<li>two</ul>
    <div class="ad-box">Buy</div><form><p>Mail</p></form><aside>Side</aside><table><tr><td>c1<td>c2</table></article>
    <section id="comments"><article class="comment"><p>A very long comment of a reader that says a lot of things indeed</p></article></section></div>
    <div role="alert">Notice</div><footer>&copy; F</footer></body></html>"""
    text = pages.extract(source, None)
    assert text == "Title & more\nFirst bold line here <x> &am\nSecond para link.\none\ntwo\nc1\nc2"


def test_consensus_path_wins_over_a_page_s_own(spark):
    usual = "<body><div class='c1'><p>%s</p></div><div class='x'><p>short</p></div></body>"
    odd = "<body><div class='c2'><p>main words</p></div><div class='x'><p>a long box that is the longest part of this page only here</p></div></body>"
    rows = [(k, f"http://h.example/{k}", usual % (f"page {k} " * 20)) for k in range(5)] + [(9, "http://h.example/9", odd)]
    rows += [(10, "http://other.example/", "<body><main><p>own</p></main></body>"), (11, None, None), (None, "http://h.example/e", ""), (12, "http://h.example/p", "plain &amp; text")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_texts(docs).collect()}
    assert got[9] == ("main words", 10) and got[10] == ("own", 3) and got[11] == ("", 0) and got[None] == ("", 0)
    assert got[12] == ("plain & text", 12) and got[1][0] == ("page 1 " * 20).strip()
    assert pages.main_texts(docs.limit(0)).count() == 0


def test_unclosed_and_stray_tags():
    assert pages.extract("<article><p>a</b></i>b</section>c<p>d<td>e", None) == "ab\nc\nd\ne"
    assert pages.extract("no tags < at all", None) == "no tags < at all"
    assert pages.extract("<p>x<!-- y --><!-- never closed <p>z", None) == "x"


def test_title_and_lead_outside_the_content_div(spark):
    inner = "<h1>Title</h1><p>A lead.</p><div class='entry-content'><p>%s</p></div>" % ("body text " * 40).strip()
    whole = "Title\nA lead.\n" + ("body text " * 40).strip()
    outer = {"a": f"<article>{inner}</article>", "b": f"<div class='page'>{inner}</div><div><p>other box</p></div>", "c": f"<main><article>{inner}</article></main>"}
    outer["d"] = f"<main><h1>Title</h1><p>A lead.</p><article>{inner.split('</p>', 1)[1]}</article></main>"
    rows = [(k, f"http://{h}.example/{k}", f"<body><nav><a>Home</a></nav>{source}<footer>F</footer></body>") for h, source in outer.items() for k in range(2)]
    got = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["url"][7], r["text"]) for r in got} == {(h, whole) for h in outer}


def test_titles_as_ids_math_and_names_inside_an_article():
    source = """<body><div id="site-nav">Menu</div><article><h1>Title</h1><h2 id="related-work">Related work</h2><p id="comments">First.</p>
    <h2 id="search-algorithms">Search</h2><section id="comments-on-the-theory"><p>Theory with <math><mi>x</mi></math> kept.</p></section>
    <div class="story-form"><p>A form of story.</p></div><div class="post-comments"><p>Reader.</p></div><div class="cookie-banner box2">Cookies</div>
    <div class="main-navigation"><p>Go</p></div><p>Last <span class="text-promotion-law" id="ad">words</span>.</p></article><div class="sidebar-left"><p>Side</p></div></body>"""
    assert pages.extract(source, None) == "Title\nRelated work\nFirst.\nSearch\nTheory with x kept.\nA form of story.\nLast words."


def test_names_of_parts_beside_the_text():
    beside = "sidebar ad-box site-header main-menu comment-list comment-body post-comments entry-footer nav2 cookie_banner widget footer-links article-share"
    inside = "no-sidebar with-sidebar story-form related-work comments-on-the-theory article content post-title adventure search-algorithms entry-header text-promotion"
    assert all(map(pages.is_apart, beside.split())) and not any(map(pages.is_apart, inside.split()))


def test_two_templates_on_one_host(spark):
    shape = {"a": "<div class='wrap'><article class='t1'><h1>%s</h1><p>%s</p></article><div class='x'><p>box</p></div></div>",
             "b": "<main><h1>%s</h1><div class='entry-content'><p>%s</p></div></main><div class='sidebar'><p>box</p></div>"}
    rows = [(k, f"http://one.example/{k}", f"<body>{shape['ab'[k % 3 == 0]]}</body>" % (f"Title {k}", f"page {k} words " * 15)) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\n" + (f"page {k} words " * 15).strip() for k in range(12)}


def test_a_very_long_page():
    text = pages.extract("<article>" + "<p>words of a paragraph</p>" * 60_000 + "</article>", None)
    assert text.count("\n") == 59_999
