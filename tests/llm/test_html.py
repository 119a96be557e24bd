import html as std
import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq

from tidemark.llm import html

RICH = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="page-12"><header><a href=/>Site</a></header>
<div id="cookie-banner">We use cookies</div><div class="wrap w3"><aside class=sidebar><p>Side words here</p></aside>
<div class="story-body s77"><h1>Head &amp; line</h1><p>First   para<br>graph &lt;b&gt; with <a href="x">a link</a>.
<p>Second &eacute;&#233;&#x20AC; <b>bold</b></p><ul><li>one<li>two</ul><div class="ad-slot">Buy now</div>
<form><input value=x><button>Send</button></form><blockquote>Quoted <p>inner</p></blockquote><script>if (a < b) document.write("</p><p>bad</p>")</script>
<table><tr><td>c1<td>c2</table></div><section class="comments"><p>Reader: nice nice nice nice nice nice nice</p></section></div>
<footer>&copy; us</footer></body></html>"""
TEXT = "Head & line\nFirst para graph <b> with a link.\nSecond éé€ bold\none\ntwo\nQuoted\ninner\nc1\nc2"


def test_pages_of_the_table(spark):
    rows = {r["page_id"]: r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()}
    got = html.op3_html(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", rows[r.page_id], re.S)[1]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_boilerplate_stays_out():
    assert html.extract(RICH, None) == TEXT
    assert html.extract(RICH, "body.page-#>div.w#.wrap>div.s#.story-body"[4:]) == TEXT  # an unknown path falls back


def test_consensus_of_a_host(spark):
    """A page with a long other box is read by the path that its host's other pages chose."""
    page = '<body><div class="c{0}"><p>{1}</p></div><div class="x"><p>{2}</p></div></body>'
    rows = [(i, "http://h.example/" + str(i), page.format(i, "body text " * 20, "more")) for i in range(6)]
    rows += [(6, "http://H.example:80/odd", page.format(6, "short story", "link list " * 40)), (7, None, None), (8, "", ""), (9, "::", "<p>only <i>this"), (9, "::", "<p>only <i>this")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    for bound in (0, 100):
        got = [(r.page_id, r.text_, r.text) for r in html.extracted(df, hosts_broadcast=bound).collect()]
        assert len(got) == len(rows) and all(t == "old" for *_, t in got)
        found = {i: t for i, t, _ in got}
        assert found[6] == "short story" and found[0] == ("body text " * 20).strip()
        assert found[7] == found[8] == "" and found[9] == "only this"
    assert html.extracted(df.limit(0)).count() == 0


def test_long_and_broken_pages():
    assert html.extract("<p>" + "word " * 200_000, None) == ("word " * 200_000).strip()
    assert html.extract("<div>" * 3000 + "deep" + "</div>" * 10, None) == "deep"
    for broken in ("<", "<p", "<!--", "<p>a<!-- b", "<script>x", "&#xZZ;", "<a href='", "</p></p>", "<p>1 < 2 and 3 > 2</p>"):
        html.extract(broken, None)
    assert html.extract("<p>1 < 2 and 3 > 2</p>", None) == "1 < 2 and 3 > 2"


def test_raw_elements_hide_all_of_their_content():
    """Quotes and tags inside of scripts and styles do not reach the markup after them."""
    for raw in ("<script>for(i=0;i<n;i++){} // don't stop</script>", "<style>/* a<b \" */</style>", "<textarea><b '</textarea>"):
        page = f"<body>{raw}<nav>It's a menu</nav><article><p>One isn't</p><p>Two</p></article><footer>end</footer></body>"
        assert html.extract(page, None) == "One isn't\nTwo"
        assert html.extract(page.replace("'s", "s").replace("isn't", "is"), None) == "One is\nTwo"


def test_deep_pages_are_whole():
    """Boilerplate below thousands of open elements stays out, and what follows them stays inside its container."""
    deep = "<div>" * 20_000 + "<nav>menu words</nav><p>deep</p><div class=ads>buy</div>" + "</div>" * 20_000
    assert html.extract(f"<article><p>first</p>{deep}<p>after</p></article><p>outside</p>", None) == "first\ndeep\nafter"
    paths = [path for path, *_ in html.blocks(deep)[1] if path]
    assert len(set(paths)) == len(paths) == 20_001 and max(map(len, paths)) < 1_000


def test_all_classes_tell_boxes_apart():
    page = '<body><div class="a b c d z1"><p>wanted text</p></div><div class="a b c d y"><p>other text, and longer</p></div></body>'
    wanted = next(path for path, *_ in html.blocks(page)[1] if "z#" in path)
    assert html.extract(page, wanted) == "wanted text"


CASES = [
    ('<p>one <svg class="i"/> two</p><p>three</p>', "one two\nthree"),
    ('<p>a <svg><path d="x"/><title>t</title></svg>b</p><p>c</p>', "a b\nc"),
    ("<svg><p>after</p>", "after"),
    ("<noscript><p>x</p><p>after</p>", "x\nafter"),
    ("<object data=x>a<p>after</p>", "a\nafter"),
    ('<div class="site has-sidebar">article</div>', "article"),
    ('<div class="post tag-news">article</div>', "article"),
    ('<div class="hentry post comments-open">article</div>', "article"),
    ("<p title=it's>lost</p><p>more don't</p><p>end</p>", "lost\nmore don't\nend"),
    ("<article><p>Use <label>this</label> word</p></article>", "Use this word"),
    ('<article><p>A <span class="ad">buy</span>b</p></article>', "A b"),
    ('<form id=whole><div class="menu"><a>m</a></div><div class="text"><p>Long text of the page here</p></div><input><button>b</button></form>', "Long text of the page here"),
    ('<div class="sidebar-left"><article><p>x y</p></article></div>', "x y"),
    ('<div class="post"><p>short</p></div><div id=comments><article class="comment"><p>' + "nice " * 50 + "</p></article></div>", "short"),
    ("<div class=cookie-notice>c</div><div class=comments><p>r</p></div>", ""),
    ("<p>a<!-->b--></p>", "ab-->"),
    ("<p>1 </> 2</p>", "1 2"),
    ("<div hidden>x</div><p>y</p>", "y"),
    ('<div class="widget"><p>all</p></div>', "all"),
    ("<p>a</p><iframe src=x></iframe ><p>b</p>", "a\nb"),
    ('<body class="right-sidebar"><div id="content"><p>t</p></div><div id="sidebar"><p>' + "s " * 100 + "</p></div></body>", "t"),
    ("<nav><a>m</a></nav><div class=post><h1>Head</h1><div class=body><p>" + "long " * 99 + "</p></div></div><div class=more><p>other</p></div>", "Head\n" + ("long " * 99).strip()),
    ("<article>" + "<div>" * 600 + "<p>deep text</p>" + "</div>" * 600 + "<p>after</p></article>", "deep text\nafter"),
]


def test_markup_that_loses_no_text():
    for page, expected in CASES:
        assert html.extract(page, None) == expected, page[:90]


STYLES = [
    '<body><nav><a href=/>Home</a></nav><article>{}</article><aside><p>more here</p></aside></body>',
    '<body class="single no-js"><div id="page" class="site has-sidebar"><div id="primary" class="content-area"><main id="main">{}</main></div><div id="secondary" class="widget-area sidebar"><p>links to read</p></div></div></body>',
    '<form method=post><div id="wrapper"><div id="header"><h2>Site</h2></div><div id="mainContent">{}</div><div id="footer">legal words</div></div></form>',
    '<table width=100%><tr><td class="nav"><a href=a>one</a><a href=b>two</a><td class=text>{}<tr><td colspan=2 class="footer">small print</table>',
    '<div class="l-grid"><div class="l-col l-col--8"><div class="c-article">{}</div></div><div class="l-col"><div class="ad-slot">BUY</div></div></div>',
    '<div class="hentry post type-post tag-news comments-open category-x">{}<div class="sharedaddy share-buttons"><a>tweet</a></div></div><div id="comments" class="comments-area"><ol><li><article class="comment"><p>a reader says it is very good</p></article></ol></div>',
    '<div data-x=\'{{"a":"<b>"}}\' title="a > b"><section>{}</section></div><script>if (a<b) x = "</div>" + \'</p>\'</script><div role=contentinfo>imprint</div>',
    "<div id=cookieBanner>We use cookies on this site</div><center><font>{}</font></center>",
    '<svg><defs/><title>logo</title></svg><div class="story">{}<svg class=icon/></div><noscript><img src=x></noscript>',
    '<div class="post-content"><template><p>not shown</p></template>{}<div style="display: none">hidden words</div></div><div class="related-posts"><a>other</a></div>',
]


def test_styles_of_markup_against_what_was_written():
    paragraphs = ["The first words of it, and some more of them for length", "Then it&#39;s a <b>second</b>, with <a href='/x'>one link</a> inside", "A third &lt;one&gt; that ends the whole"]
    plain = ["The first words of it, and some more of them for length", "Then it's a second, with one link inside", "A third <one> that ends the whole"]
    inner = "\n".join(f"<p>{p}</p>" for p in paragraphs)
    for style in STYLES:
        assert html.extract(style.format(inner), None) == "\n".join(plain), style
        assert html.extract(style.format(inner.replace("</p>", "")), None) == "\n".join(plain), style


class Tree(HTMLParser):
    """A plain reader of well-formed pages: blocks of text below an element of the class `story`."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.inside, self.parts = 0, None, [""]
        self.feed(page)
        self.text = "\n".join(t for t in (" ".join(p.split()) for p in self.parts) if t)

    def handle_starttag(self, tag, attrs):
        self.depth += 1
        if self.inside is None and dict(attrs).get("class") == "story":
            self.inside = self.depth
        if tag in ("div", "p", "ul", "li", "blockquote", "h2"):
            self.parts.append("")

    def handle_endtag(self, tag):
        if self.inside == self.depth:
            self.inside = None
        self.depth -= 1
        if tag in ("div", "p", "ul", "li", "blockquote", "h2"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside is not None:
            self.parts[-1] += data


def test_random_pages_against_a_tree_reader():
    rng = random.Random(3)

    def words():
        return "".join(rng.choice(["word ", "it&amp;s ", "<b>bold</b> ", "<i>x</i>", "\n tab\t ", "&eacute; "]) for _ in range(rng.randint(3, 9)))

    def block(depth):
        tag = rng.choice(["p", "p", "div", "ul", "blockquote", "h2"])
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if tag in ("div", "blockquote") and depth < 4:
            return f"<{tag}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 3))) + f"{words() if rng.random() < 0.4 else ''}</{tag}>"
        return f"<p>{words()}</p>"

    for _ in range(200):
        page = f'<div class="top"><nav><a href="/">go</a></nav></div><div class="story">{"".join(block(0) for _ in range(rng.randint(2, 6)))}</div><footer>end</footer>'
        assert html.extract(page, ">div.story") == Tree(page).text
