import html
import re

from folioflow.llm import pagetext
from folioflow.llm.pagetext import main_text

LONG = "The end of the day was on us, and it is said that the rest of them had to be there with all of the others for a while. "


def article_of(page):
    """What the test tables' template holds: the blocks of its article element."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    out = []
    for p in parts:
        t = " ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", p) if "<br>" in p else re.sub(r"</?b>", "", p)).split())
        out += [t] * bool(t)
    return "\n\n".join(out)


def test_the_tables_articles(spark):
    for folder in ("sf0.01", "sf0.001"):
        pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
        want = {r.page_id: article_of(r.html) for r in pages.collect()}
        got = {r.page_id: (r.text, r.n_chars) for r in pagetext.op8_html_extract(spark, f"/root/testdata/{folder}").collect()}
        assert {k: v[0] for k, v in got.items()} == want
        assert all(len(t) == n for t, n in got.values())


def test_boilerplate_of_all_kinds_goes():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1><p>{LONG}</p></header><nav><a href=x>Home</a></nav>
    <div id="cookie-notice"><p>{LONG}</p></div><main><article><header><h1>Title &amp; more</h1><span class="share">Share</span></header>
    <p>{LONG}<b>bold</b>&nbsp;x &lt;tag&gt;</p><p>Short one.</p><div class="ad"><p>{LONG}</p></div><form><p>{LONG}</p></form>
    <aside><p>{LONG}</p></aside><ul><li>First point</li><li>Second point</li></ul><p>{LONG}</p>
    <section class="comments"><article><p>Reader: {LONG}</p></article></section></article></main>
    <div class="sidebar"><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>"""
    clean = " ".join(LONG.split())
    assert main_text(page) == "\n\n".join(["Title & more", clean + " bold x <tag>", "Short one.", "First point", "Second point", clean])


def test_without_an_article_element():
    page = f"""<body><div><a href=a>Home</a> <a href=b>News</a> <a href=c>About the site</a></div><h2>A heading</h2><p>{LONG * 2}</p><p>Tiny.</p><p>{LONG * 2}</p>
    <div>© 2020 all rights</div><div><a href=a>More</a></div></body>"""
    clean = " ".join((LONG * 2).split())
    assert main_text(page) == "\n\n".join(["A heading", clean, "Tiny.", clean])


def test_links_and_named_containers():
    links = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(4))
    clean = " ".join(LONG.split())
    assert main_text(f"<article><p>{LONG}</p><p><a href=x>Read all of it.</a></p><ul>{links}</ul></article>") == clean + "\n\nRead all of it."
    page = f"<body><div class='top'><a href=a>Home</a></div><div id='main-content'><h2>Head</h2><p>Short.</p><p>{LONG}</p></div><div class='widget'><p>{LONG}</p></div><p>Tail</p></body>"
    assert main_text(page) == f"Head\n\nShort.\n\n{clean}"
    assert main_text("<div role=main><p>One.</p></div><p>Two.</p>") == "One."


def test_the_five_pages_that_names_and_tags_misread():
    clean = " ".join(LONG.split())
    assert main_text(f"<article><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>") == f"{clean}\n\nDiscussion\n\n{clean}"
    assert main_text(f"<article><p>{LONG}</p><p class='related-work'>{LONG}</p></article>") == f"{clean}\n\n{clean}"
    assert main_text(f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article>") == f"Title\n\n{clean}"
    assert main_text(f"<body><form action=x><nav><a href=y>Home</a></nav><article><h1>Title</h1><p>{LONG}</p></article></form></body>") == f"Title\n\n{clean}"
    assert main_text(f"<body><form><p>{LONG}</p><p>{LONG}</p></form></body>") == f"{clean}\n\n{clean}"
    assert main_text(f"<body><main><p>teaser</p></main><div><p>{LONG * 2}</p><p>{LONG * 2}</p></div></body>").endswith("\n\n".join([" ".join((LONG * 2).split())] * 2))


def test_each_evidence_counts(monkeypatch):
    menu = "<p><a href=a>Home</a> <a href=b>News</a></p>"
    page = f"<article><p>{LONG}</p>{menu}<p><a href=x>Read all of it here.</a></p><p>{LONG}</p></article>"
    bare = f"<body><div>{menu}</div><h2>Head</h2><p>{LONG * 2}</p><p>Tiny.</p><p>{LONG * 2}</p><div>{menu}<p>Imprint</p></div></body>"
    clean, double = " ".join(LONG.split()), " ".join((LONG * 2).split())
    assert main_text(page) == f"{clean}\n\nRead all of it here.\n\n{clean}"
    assert main_text(bare) == f"Head\n\n{double}\n\nTiny.\n\n{double}"
    labelled = f"<article><p>{LONG}</p><p>Also read</p><p><a href=a>One</a></p><p><a href=b>Two</a></p><p>{LONG}</p></article>"
    assert main_text(labelled) == f"{clean}\n\nAlso read\n\n{clean}"
    monkeypatch.setattr(pagetext, "STOP_WORDS", frozenset())
    assert main_text(page) == f"{clean}\n\n{clean}" and main_text(bare) == ""
    monkeypatch.undo()
    monkeypatch.setattr(pagetext, "LINKS_MOST", 2.0)
    assert "Home News" in main_text(page)
    monkeypatch.undo()
    monkeypatch.setattr(pagetext, "SHORT", 10**6)
    assert main_text(bare) == ""


def test_names_inside_an_article():
    clean = " ".join(LONG.split())
    drop = ["ad", "ad-box", "comments-section", "shareButtons", "cookie_notice", "newsletter-signup"]
    keep = ["article-comments-policy", "social-history", "trending-up", "search-results", "widget-theory"]
    for name in drop:
        assert main_text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article>") == clean, name
    for name in keep:
        assert main_text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article>") == f"{clean}\n\n{clean}", name
    refs = "".join(f"<li><a href={i}>The history of the town and of its people, part {i}</a></li>" for i in range(4))
    assert main_text(f"<article><p>{LONG}</p><ul>{refs}</ul></article>").count("history") == 4


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""
    assert main_text(f"<article><p>{LONG}<b>x<p>1 < 2 & 3 &am") == " ".join(LONG.split()) + " x\n\n1 < 2 & 3 &am"
    assert main_text("<article><p>only</p>") == "only"
    assert main_text("<article><p>a<script>if (a</p>") == "a"
    deep = "<div>" * 20000 + "<article><p>" + LONG + "</article>" + "</x>" * 20000
    assert main_text(deep) == " ".join(LONG.split())
    assert main_text("<article><p>" + LONG * 5000 + "</article>") == " ".join((LONG * 5000).split())


def test_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, "<article>x y", "old", 5)] * 2, "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in pagetext.extract(df).collect()] == [(None, None, "x y", 3)] * 2
    assert pagetext.extract(df.limit(0)).count() == 0
