"""Page extraction: ids and hyphenated names in a marked main region are no boilerplate."""

from hotzone.llm.html_extract import main_lines


def test_slugs_and_hyphenated_names_in_an_article_stay():
    body = ('<h2 id="related-work">Related work</h2><section id="search-methods"><p>We search.</p></section>'
            '<p id="notice-period">Three months.</p><h2 class="section-header">Heads</h2>'
            '<div id="share-capital"><p>One million.</p></div><section id="comments"><h2>Comments on Kant</h2></section>'
            '<p class="notice">Mind the gap.</p><div class="header"><p>Part two</p></div>')
    want = ["Related work", "We search.", "Three months.", "Heads", "One million.", "Comments on Kant", "Mind the gap.", "Part two"]
    for page in (f"<article>{body}</article>", f"<main>{body}</main>", f'<div role="main">{body}</div>'):
        assert main_lines(f"<body>{page}</body>") == (True, want)


def test_whole_tokens_still_mark_boilerplate():
    body = ('<p>text</p><div class="ad big">buy</div><p class="Advert">buy</p><section class="newsletter"><p>join</p></section>'
            '<ol><li class="comment even">me too</li></ol><div role="search">find</div><article class="comment">reader</article>'
            '<p hidden>no</p><p style="display: none">no</p><aside>side</aside>')
    assert main_lines(f'<body><div id="comments-box">out</div><div class="site-header">out</div><article>{body}</article></body>') == (True, ["text"])
    assert main_lines('<body><div id="cookie-box">out</div><p>in</p></body>') == (False, ["in"])
