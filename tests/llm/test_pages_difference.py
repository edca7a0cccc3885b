"""Page differencing inside marked main regions."""

from hotzone.llm.html_extract import extract_text, main_blocks

SITE_LINE, NOTICE, PASSAGE = "Subscribe to our letter for more.", "Prices may change.", "A passage that two articles quote."


def page(k: int, own_notice: str = NOTICE) -> str:
    body = "".join(f"<p>Own text {k}, paragraph {j}.</p>" for j in range(8))
    quote = f"<p>{PASSAGE}</p>" if k in (2, 3) else ""
    return (f"<nav>menu</nav><article><h1>Title {k}</h1><h2>Introduction</h2>{body}{quote}"
            f'<p class="notice">{own_notice}</p><p>{SITE_LINE}</p></article><footer>end</footer>')


def test_shared_lines_of_main_regions_go_if_confirmed(spark):
    rows = [(k, f"http://a.example/p{k}", page(k)) for k in range(6)]
    rows.append((6, "http://a.example/p2/copy", page(2)))
    rows.append((7, "http://a.example/p7", page(7, "Only here.")))
    rows += [(10 + k, f"http://b.example/{k}", f"<article><p>{'abc'[k]} one.</p><p>{'abc'[k]} two.</p><p>{PASSAGE}</p></article>") for k in range(3)]
    rows.append((20, None, page(0)))
    got = {r.page_id: r.text.split("\n") for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (0, 1, 4, 5):
        assert got[k] == [f"Title {k}", "Introduction", *[f"Own text {k}, paragraph {j}." for j in range(8)]]
    for k in (2, 3):  # a passage of two articles is no line of the site
        assert got[k][-1] == PASSAGE and len(got[k]) == 11
    assert got[6] == got[2]  # copies lose the same lines
    assert got[7][-1] == "Only here."  # a doubtful class alone deletes nothing
    assert all(PASSAGE in got[10 + k] for k in range(3))  # three pages are too few to tell
    assert got[20][-2:] == [NOTICE, SITE_LINE]  # no host: not paired


def test_near_copies_tell_nothing(spark):
    text = "".join(f"<p>Line {j} of one article.</p>" for j in range(10))
    rows = [(k, f"http://a.example/v{k}", f"<article><p>Version {k}.</p>{text}</article>") for k in range(5)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(len(r.text.split("\n")) == 11 for r in got)


def test_kinds_of_lines():
    marked, lines, kinds = main_blocks('<article><h1>t</h1><p>a</p><p class="promotion-box">b</p>c<div class="site-notice-text"><p>d</p></div>'
                                       '<ul><li>e</li></ul><p id="notice">f</p><p>g</p></article>')
    assert (marked, lines, kinds) == (True, list("tabcdefg"), [0, 1, 2, 1, 2, 0, 1, 1])
