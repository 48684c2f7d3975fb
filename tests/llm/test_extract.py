from html.parser import HTMLParser

from quillion.llm import extract

ARTICLE = ["A title", "The first paragraph, with commas, is long enough to count as prose on any page.", "The second one & its entity, <b>, tells more of the same story, at some length too.", "A third closes the piece, with a link inside, and nothing more to say about it."]
PAGE = f"""<!doctype html><html><head><title>t</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, and you have to agree before you read on here.</div>
<div id="content"><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><div class="ad-box"><p>Buy, buy, buy: the best advert that was ever put between two paragraphs.</p></div>
<p>The   second one &amp; its entity, &lt;b&gt;,
 tells more of the same story, at some length too.</p><p>A third closes the piece, with a <a href="/y">link inside</a>, and nothing more to say about it.</p></div>
<aside><p>Related, read this as well, it is a long teaser text for another page of ours.</p></aside>
<div class="comments"><p>I, as a reader, disagree with all of it, and I say so at great length here.</p></div>
<form><label>Name</label><input><button>Send</button></form><footer>Imprint, privacy, and all rights reserved, for ever and ever, we say.</footer></body></html>"""


def test_article_without_furniture():
    assert extract.main_text(PAGE) == "\n".join(ARTICLE)


def test_plain_and_broken_pages():
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav><a href=x>y</a></nav>") == ""
    assert extract.main_text("<p>one<p>two &eacute;") == "one\ntwo é"
    assert extract.main_text("<article><p>a<br>b</p><script>x</article>") == "a b"
    deep = "<div>" * 5000 + "deep text, that is long enough to have some points, lies here" + "</div>" * 5000
    assert extract.main_text(deep) == "deep text, that is long enough to have some points, lies here"


def test_table(spark):
    rows = [(1, "u", PAGE, 5, "x"), (1, "u", PAGE, 5, "x"), (2, None, None, 5, "x"), (None, "v", "", 5, "x")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, extra string"))
    assert got.columns == ["page_id", "url", "extra", "text", "n_chars"]
    text = "\n".join(ARTICLE)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "A long paragraph of the article, with commas, that says a good deal more than any menu would, number {}."


def article(inner: str, before: str = "", after: str = "") -> str:
    return f"<html><body>{before}<nav><a href=/>Home</a></nav><article><h1>Headline</h1><p>{BODY.format(1)}</p>{inner}<p>{BODY.format(2)}</p></article>{after}</body></html>"


KEPT = [
    ("<div class='article-header'><h2>Sub</h2><p>The lead.</p></div>", ["Sub", "The lead."]),
    ("<div class='market-share'><p>Shares rose.</p></div>", ["Shares rose."]),
    ("<section id='side-effects'><p>Few are known.</p></section>", ["Few are known."]),
    ("<div class='content has-sidebar'><p>Part of it.</p></div>", ["Part of it."]),
    ("<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li><li><a href=3>Source three</a></li></ul>", ["Source one", "Source two", "Source three"]),
    ("<p>a<svg/>b</p>", ["ab"]),
    ("<p>x<svg><text>no</text></svg>y</p>", ["xy"]),
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["where x=2 holds"]),
    ("<select><option>no<p>after</p>", ["after"]),
    ("<div>loose <b>bold</b> words<div>inner</div></div>", ["loose bold words", "inner"]),
    ("<pre>code <span class='comment'># kept</span></pre>", ["code # kept"]),
    ("<blockquote>Said.<footer>An author</footer></blockquote>", ["Said.", "An author"]),
    ("<p>1 &lt; 2 &am<b>p;</b> 3</p>", ["1 < 2 &amp; 3"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
]
CUT = [
    "<div class='ad-box'><p>Buy, buy, buy: the best advert that was ever put between two paragraphs.</p></div>", "<aside>Teaser</aside>", "<div id=cookieNotice>Cookies</div>", "<div class='comments'><p>I disagree.</p></div>",
    "<ul class='share-buttons'><li>Tweet</ul>", "<div class='newsletter-signup'>Subscribe</div>", "<form><input><label>Name</label></form>", "<script>var a = '<p>x</p>'</script>", "<style>p{}</style>", "<!-- <p>x</p> -->", "<div role=navigation>menu</div>",
    "<nav class=breadcrumbs><a href=/>x</a></nav>", "<footer>By</footer>", "<section id='related-posts'><p>More, more, more of this, and of that, and what else there is to read.</p></section>", "<textarea>x</textarea>", "<div hidden>x</div>",
]


def test_what_stays_and_what_goes_inside_an_article():
    """The expected blocks are stated by hand, part by part, and then all parts in one page."""
    first, last = ["Headline", BODY.format(1)], [BODY.format(2)]
    for inner, blocks in KEPT:
        assert extract.main_text(article(inner)).split("\n") == first + blocks + last, inner
    for inner in CUT:
        assert extract.main_text(article(inner)).split("\n") == first + last, inner
        assert extract.main_text(article("", before=inner, after=inner)).split("\n") == first + last, inner
    every = "".join(inner + cut for (inner, _), cut in zip(KEPT, CUT, strict=False) if "<select>" not in inner)
    want = [b for inner, blocks in KEPT[: len(CUT)] if "<select>" not in inner for b in blocks]
    assert extract.main_text(article(every)).split("\n") == first + want + last


def test_pages_without_an_article_element():
    head = "<div class='site-header'>Site</div><div class=menu><a href=1>a</a></div>"
    body = f"<div><p>{BODY.format(1)}</p><p>{BODY.format(2)}</p></div>"
    short = "<div><p>A short one.</p></div>"
    text = [BODY.format(1), BODY.format(2)]
    assert extract.main_text(f"<body>{head}{body}{short}</body>").split("\n") == [*text, "A short one."]
    assert extract.main_text(f"<body>{head}<h2>Part</h2>{body}<ul><li>x<li>y</ul></body>").split("\n") == ["Part", *text, "x", "y"]
    assert extract.main_text(f"<body><form id=aspnet>{head}{body}</form></body>").split("\n") == text
    assert extract.main_text(f"<body><div class='page-with-comments'>{body}<div class=comments><p>{BODY.format(3)}</p></div></div></body>").split("\n") == text
    assert extract.main_text(f"<body><div class='sidebar'>{body}</div></body>").split("\n") == text
    assert extract.main_text(f"<body><div id=content><header><h1>T</h1></header><p>{BODY.format(1)}</p></div></body>").split("\n") == ["T", BODY.format(1)]


def test_very_long_page():
    parts = [BODY.format(k) for k in range(40_000)]
    assert extract.main_text(article("".join(f"<p>{p}</p>" for p in parts))).split("\n")[2:-1] == parts


def paragraphs(*numbers: int) -> tuple[str, list[str]]:
    return "".join(f"<p>{BODY.format(n)}</p>" for n in numbers), [BODY.format(n) for n in numbers]


def text_of(body: str) -> list[str]:
    return extract.main_text(f"<html><body><nav><a href=/>Home</a><a href=/x>More</a></nav>{body}<footer>Imprint</footer></body></html>").split("\n")


def test_articles_in_several_parts():
    one, a = paragraphs(1, 2, 3)
    two, b = paragraphs(4, 5)
    three, c = paragraphs(6)
    part = "<div class=part><div class=inner>{}</div></div>"
    assert text_of(f"<div id=content>{part.format(one)}{part.format(two)}</div>") == a + b
    assert text_of(f"<div id=content>{part.format(two)}{part.format(one)}</div>") == b + a
    assert text_of(f"<div id=content>{part.format(one)}{part.format(one)}</div>") == a + a
    for wrap in ("<main>{}</main>", "{}", "<div>{}</div>"):
        assert text_of(wrap.format(f"<article>{one}</article><article><p>Short.</p></article>")) == [*a, "Short."]
        assert text_of(wrap.format(f"<article>{three}</article><article>{one}</article>")) == c + a
    cards = "<article><a href=/1>A card, with a teaser of another story</a></article>" * 3
    assert text_of(f"<article>{one}</article>{cards}") == a


def test_headline_and_lead_in_their_own_box():
    one, a = paragraphs(1, 2, 3)
    hero = "<div class=hero><div><h1>Head</h1><p>The lead.</p></div></div>"
    assert text_of(f"{hero}<div class=body><div>{one}</div></div>") == ["Head", "The lead.", *a]
    assert text_of(f"<div id=page>{hero}<div class=body><div>{one}</div></div></div>") == ["Head", "The lead.", *a]
    assert text_of(f"<main>{hero}<article>{one}</article></main>") == ["Head", "The lead.", *a]
    assert text_of(f"<h1>Head</h1><div><div>{one}</div></div>") == ["Head", *a]


def test_anchors_without_href_and_links_without_end():
    one, a = paragraphs(1, 2, 3)
    assert text_of(f"<div><a name=top>{one}</div>") == a
    assert text_of(f"<a id=top>{one}") == a
    assert text_of(f"<div><p>See <a href=/x>this</p>{one}</div>") == ["See this", *a]
    assert text_of(f"<div><a href=/x>Top{one}</div>")[-3:] == a
    assert text_of(f"<article><p><a href=/a>one<a href=/b>two</a> {BODY.format(9)}</p>{one}</article>") == [f"onetwo {BODY.format(9)}", *a]


def test_names_are_a_weight_inside_the_article():
    one, a = paragraphs(1, 2)
    long = f"{BODY.format(7)} {BODY.format(8)}"
    for opened, closed in (("<section id=search>", "</section>"), ("<div class=form>", "</div>"), ("<div class='related'>", "</div>"), ("<div class=banner>", "</div>"), ("<section class=login>", "</section>")):
        assert text_of(f"<article>{one}{opened}<p>{long}</p>{closed}</article>") == [*a, long], opened
        assert text_of(f"<article>{one}{opened}<p>Short, too.</p>{closed}</article>") == a, opened
    assert text_of(f"<article>{one}<p id=login>{long}</p></article>") == [*a, long]
    for name in ("comments", "ad-box", "newsletter", "cookie-notice"):
        assert text_of(f"<article>{one}<div class={name}><p>{long}</p></div></article>") == a, name


def test_tag_soup_takes_linear_time():
    import time

    soups = [
        lambda n: "<span>" * n + "</p>" * n + "text", lambda n: "<b><div>" + "<span>" * n + "</b>" * n + "text", lambda n: "<div class=x>" * n + "text" + "</div>" * n, lambda n: "<div class=ad-slot><span>x" * n,
        lambda n: "<a href=1><p>x" * n, lambda n: "<li>x" * n, lambda n: "<table><tr><td>x" * n, lambda n: "<span>y" * n, lambda n: "<p " + "'" * n, lambda n: "<select><option>" * n, lambda n: "</div></b>" * n,
    ]
    for k, soup in enumerate(soups):
        seconds = []
        for n in (5_000, 40_000):
            began = time.process_time()
            extract.main_text(soup(n))
            seconds.append(time.process_time() - began)
        assert seconds[1] < 24 * max(seconds[0], 0.02), k


class PlainReader(HTMLParser):
    """The blocks of a page's article element by the standard library's parser; enough for the driver's pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.parts = False, False, [], []

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip = tag in ("script", "style")
        if tag == "br":
            self.parts.append(" ")
        elif tag in extract.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        self.skip = False
        if tag in extract.BLOCK:
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_driver_pages_match_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    for page in pages.collect():
        reader = PlainReader()
        reader.feed(page.html or "")
        reader.close()
        reader.flush()
        assert got[page.page_id].split("\n") == (reader.blocks or [""]), page.page_id
