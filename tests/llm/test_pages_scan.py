"""Page extraction: what goes and what stays by names, malformed and long markup, copies, and an independent extractor."""

import random
import time
from html.parser import HTMLParser

import pytest

from hotzone.llm.html_extract import blocks_of, extract_text, main_lines

GOES = [
    '<div class="ad-box">x</div>', '<div class="advert-inline">x</div>', '<div class="newsletter-signup">x</div>',
    '<div class="related-posts">x</div>', '<ul class="share-buttons"><li>x</li></ul>', '<div class="notice">x</div>',
    '<div class="user-comments">x</div>', '<ol class="comment-list"><li>x</li></ol>', '<div id="disqus_thread">x</div>',
    '<div id="comments">x</div>', '<section id="comments-section">x</section>', '<section class="comments">x</section>',
    '<div hidden="">x</div>', '<div hidden>x</div>', "<p hidden='hidden'>x</p>", '<div class="comment__body">x</div>',
    '<p style="DISPLAY : none">x</p>', '<form>x</form>', '<nav>x</nav>', '<footer>x</footer>', '<aside>x</aside>',
    '<div role="alert">x</div>', '<div class="cookie-notice">x</div>', '<div class="search-form">x</div>',
    '<script>x</script>', '<style>x</style>', '<!-- x -->', '<p class="advert">x</p>',
]
STAYS = [
    '<h2 id="related-work">x</h2>', '<section id="search-methods"><p>x</p></section>', '<p id="notice-period">x</p>',
    '<h2 class="section-header">x</h2>', '<div id="share-capital">x</div>', '<section class="search"><p>x</p></section>',
    '<section id="advertising">x</section>', '<h3 id="comments">x</h3>', '<h2 class="comment-list">x</h2>',
    '<div class="main-content">x</div>', '<div id="promotion-criteria">x</div>', '<div class="header">x</div>',
    '<p data-x="hidden">x</p>', '<div title="hidden ad">x</div>', '<p title="a > b">x</p>', "<p title='a \" > b'>x</p>",
    '<div class="comment-on-kant">x</div>', '<blockquote>x</blockquote>',
]


@pytest.mark.parametrize("region", ["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>'])
def test_names_both_ways(region):
    for part in GOES:
        assert main_lines("<body>" + region.format(f"<p>a</p>{part}<p>b</p>") + "</body>") == (True, ["a", "b"]), part
    for part in STAYS:
        assert main_lines("<body>" + region.format(f"<p>a</p>{part}<p>b</p>") + "</body>") == (True, ["a", "x", "b"]), part


def test_attributes_of_any_length_are_read_alike():
    for n in (0, 10, 500, 60_000):
        extra = " ".join(f'data-{k}="{k}"' for k in range(n))
        assert main_lines(f'<article><p {extra} title="a > b">text</p></article>') == (True, ["text"])


def test_malformed_markup():
    assert main_lines('<article><p title="open>text</p><p>more</p></article>') == (True, ["text", "more"])
    assert main_lines("<article><p>a < b</p><p>1 <2</p></article>") == (True, ["a < b", "1 <2"])
    assert main_lines("<article><p>text</p><p class=x") == (True, ["text"])
    assert main_lines("<article>text<!-- open") == (True, ["text"])
    assert main_lines("") == main_lines(None) == (False, [])


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<a", "<!", "<!--", "<a b=\"", "<a b='\"", "</", "<div>", "<div></p>", "<a  ", "a=", "/",
                                   "<article></div>", "<![CDATA["])
def test_a_megabyte_takes_linear_time(piece):
    began = time.perf_counter()
    blocks_of("<body><article>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 6


class Plain(HTMLParser):
    """An independent reading of well-formed pages: text of the marked region, block by block."""

    DROP = ("nav", "aside", "footer", "form", "script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.depth, self.main = [], [], 0, 0

    def flush(self):
        line = " ".join("".join(self.now).split())
        self.now = []
        if line:
            self.out.append(line)

    def off(self, tag, attrs):
        return tag in self.DROP or ("class", "ad-box") in attrs or any(k == "hidden" for k, _ in attrs)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
            return
        if tag not in ("b", "i", "span", "a"):
            self.flush()
        self.main += tag == "article"
        self.depth += bool(self.depth) or self.off(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "span", "a"):
            self.flush()
        self.main -= tag == "article"
        self.depth -= bool(self.depth)

    def handle_data(self, data):
        if self.main and not self.depth:
            self.now.append(data)


def test_random_pages_equal_an_independent_extractor():
    rng = random.Random(7)
    names = ["p", "div", "section", "b", "i", "span", "blockquote", "nav", "aside", "footer", "form", "h2", "table"]
    extra = ["", "", ' class="ad-box"', ' hidden=""', ' id="related-work"', ' title="a > b"', " data-a='<p>'"]

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["one ", " two", "a &amp; b", "&#8364;5", "x<br>y", "\n  wide \t space ", "1 < 2 "])
        name = rng.choice(names[3:6] if depth == 1 else names)
        inside = "".join(node(depth - 1) for _ in range(rng.randint(0, 3)))
        return f"<{name}{rng.choice(extra) if name == 'div' else ''}>{inside}</{name}>"

    for _ in range(800):
        page = ("<html><body><nav>menu</nav><article>" + "".join(node(4) for _ in range(rng.randint(1, 5)))
                + "</article><footer>end</footer></body></html>")
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.flush()
        assert [t for m, t in blocks_of(page) if m] == plain.out, page


def test_copies_of_unmarked_pages_keep_their_text(spark):
    def page(*lines):
        return "<body>" + "".join(f"<p>{x}</p>" for x in ("menu here", *lines, "all rights reserved")) + "</body>"

    rows = [(k, f"http://a.org/p/{k:02}", page("the same story", "told twice")) for k in range(6)]
    rows += [(10 + k, f"http://a.org/q/{k}", page(f"story {k}", f"end {k}")) for k in range(3)]
    rows += [(20, "http://a.org/p/00", rows[0][2]), (21, "http://b.org/x", rows[0][2]), (22, "http://b.org/y", rows[0][2]),
             (30, None, page("no url")), (31, "http://c.org/1", page("cut story").replace("<p>all rights reserved</p></body>", "")), (32, "http://c.org/2", page("cut story"))]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in (*range(6), 20):
        assert got[k] == "the same story\ntold twice"
    assert [got[10 + k] for k in range(3)] == [f"story {k}\nend {k}" for k in range(3)]
    assert got[21] == got[22] == "menu here\nthe same story\ntold twice\nall rights reserved"  # alone on their host
    assert got[30].split("\n")[1] == "no url"
    assert "cut story" in got[31] and "cut story" in got[32]
