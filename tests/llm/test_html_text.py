import time

import duckdb

from tesselon.llm import html_text
from tests.llm.conftest import SF

TREE = html_text.trained()


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    expected = sorted(con.execute(html_text.EXTRACT_SQL).fetchall())
    assert sorted(map(tuple, html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect())) == expected


def test_article_with_everything_around():
    page = """<html><head><title>T</title></head><body><header><a href=x>Logo</a></header><nav><ul><li>One</ul></nav>
    <article><h1>T&eacute;st &#233; &lt;b&gt;</h1><p>One<p>Two <script>if(a<b){}</script> three<aside>Side note</aside>
    <p>Last <a href=y>link</a><div class="comments"><p>I liked this very much</div></article><div class="ad">Buy now</div><footer>&copy; us</footer>"""
    assert html_text.main_text(page, TREE) == "Tést é <b>\nOne\nTwo three\nLast link"


def test_page_without_article():
    words = " ".join(["word"] * 40)
    page = f"<body><div id=menu><a href=1>A</a> <a href=2>B</a></div><div><h1>A long enough title of it</h1><p>{words}</p><p>{words}</p></div><p><a href=3>more of this</a></p>"
    assert html_text.main_text(page, TREE) == f"A long enough title of it\n{words}\n{words}"


def test_tree_fits_its_table():
    lines = [[float(v) for v in line.split()] for line in html_text.LABELLED.strip().splitlines()]
    assert all(TREE(tuple(x[:8])) == x[8] for x in lines)


def test_broken_markup_does_not_crash():
    for page in ("", "<", "<p", "<!--", "<a href='x", "</", "<script>", "a<b c", "<p>&am", "<div" * 2000, "\x00<p>\x00"):
        html_text.main_text(page, TREE)


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, "u", "", 2), (None, "u", "<article><p>x \n y</article>", 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), ("", 0), ("x y", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_words_and_density_decide_inside_and_outside_articles():
    words = " ".join(["word"] * 70)
    listed = "<ul><li><a href=1>Some other story</a></li><li><a href=2>One more of these</a></li><li><a href=3>And a third</a></li></ul>"
    assert html_text.main_text(f"<article><h1>Title</h1><p>{words}</p>{listed}<p>{words}</p></article>", TREE) == f"Title\n{words}\n{words}"
    assert html_text.main_text(f"<article><p>{words}</p><p><a href=1>See this one</a></p><p>{words}</p></article>", TREE) == f"{words}\nSee this one\n{words}"
    body = "".join(f"<p>{words}</p>" for _ in range(5))
    assert html_text.main_text(f"<article><p>A teaser of it</p></article><div>{body}</div>", TREE).count(words) >= 3


def test_hints_on_articles_and_short_paragraphs():
    words = " ".join(["word"] * 40)
    assert html_text.main_text(f'<article class="post has-comments"><p>{words}</p></article><article class="comment" id=c1><p>{words} mine</p></article>', TREE) == words
    assert html_text.main_text("<body><p>It was late that night.</p><p>Nobody came to the door.</p><p>She went to bed.</p>", TREE).count("\n") == 2


LONG = " ".join(f"word{i}" for i in range(60))


def inside(markup):
    return html_text.main_text(f"<body><article><p>{LONG}</p>{markup}<p>{LONG}</p></article></body>", TREE).split("\n")[1:-1]


def test_adverts_inside_a_paragraph_go_and_the_paragraph_stays():
    assert inside('<p>Text <span class="ad">BUY NOW</span> more</p>') == ["Text more"]
    assert inside('<p>Text <span class="ad">Buy <span>this</span> now</span> more</p>') == ["Text more"]
    assert inside('<p>Text <b class="ad"><i>Buy</b> now</i> more</p>') == ["Text now more"]
    assert inside('<p>The <span class="search-term">word</span> stays</p>') == ["The word stays"]


def test_words_in_names_do_not_decide_alone():
    for markup in ('<section id="discussion"><p>{}</p></section>', '<p class="related">{}</p>', '<div class="notice">{}</div>', '<div class="post-comments-open"><p>{}</p></div>'):
        assert inside(markup.format(LONG)) == [LONG]
    assert inside('<h2 id="search">Search</h2>') == ["Search"]
    assert inside('<div class="notice">We use cookies here</div>') == [] == inside(f'<div class="comments"><p>{LONG}</p></div>')
    for name in ("post-comments-open", "search-page", "has-sidebar"):
        assert html_text.main_text(f'<body class="{name}"><div class="{name}"><article><h1>Title</h1><p>{LONG}</p></article></div>', TREE) == f"Title\n{LONG}"


def test_adverts_and_comments_by_joined_names_and_attributes():
    for markup in ('<ol class="commentlist"><li>Nice one</li><li>{}</li></ol>', '<div class="postcomments"><p>{}</p></div>', '<ins class="adsbygoogle">Ad text here</ins>', '<div data-ad="1">Sponsored: buy these shoes today</div>', "<div data-ad-slot=7><p>{}</p></div>", '<div class="adbox">{}</div>'):
        assert inside(markup.format(LONG)) == [], markup
    assert inside('<p title="see data-ad here">Text of some kind</p>') == ["Text of some kind"]


def test_article_text_does_not_go_for_a_name():
    words = " ".join(["alpha"] * 21)
    for markup in ('<section id="discussion"><p>{}</p></section>', '<div class="search-tips"><p>{}</p></div>', '<p class="related">{}</p>', '<div class="alerting"><p>{}</p></div>'):
        assert inside(markup.format(words)) == [words], markup


def test_only_raw_text_hides_markup():
    assert inside("<p>so <math><mi>x</mi></math> holds</p>") == ["so x holds"]
    for tag in ("svg", "object", "button", "noscript", "select", "audio", "canvas"):
        assert inside(f"<p>before <{tag}> after</p>") == ["before after"]
        assert inside(f"<p>before <{tag}><b>not this</b></{tag}> after</p>") == ["before after"]
    assert inside("<p>a <textarea><p>no</p></textarea> b</p>") == ["a b"]


def test_open_elements_end_where_html_ends_them():
    assert inside(f"<ul><li>one two three<li class=ad>Buy now<li>{LONG}</ul>")[-1] == LONG
    assert inside("<p>a <b>bold</p><p>not bold</b> text</p>") == ["a bold", "not bold text"]
    assert inside("<div><span class=ad>Buy</div><p>Kept text</p>") == ["Kept text"]
    assert inside("<table><tr><td>cell one</div><td>cell two</table><p>after it</p>") == ["cell one", "cell two", "after it"]


def test_many_open_and_unmatched_tags_take_linear_time():
    for page in ("<div>" * 40_000 + "</p>" * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "<svg>" * 40_000, "<li>" * 40_000, "<span class=ad>" * 40_000, "<table><td>" * 20_000 + "</div>" * 20_000):
        begin = time.monotonic()
        html_text.main_text(page, TREE)
        assert time.monotonic() - begin < 8


def test_the_tree_splits_on_neighbours():
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(TREE.root)
    assert {0, 1, 2, 4} < used and used & {3, 5}


# Pages laid out otherwise than those the table's rows come from; "+" marks the blocks of the article.
PAGES = [
    '<div id="page"><div class="top-bar"><a href=1>Home</a> <a href=2>About</a></div><div class="story"><h1>+ A short title</h1><p>+ {l}</p><p>+ {l} <a href=3>with a link</a></p><blockquote>+ {m}</blockquote><p>+ {l}</p></div><div class="side-bar"><p>{m}</p></div></div>',
    '<main><h1>+ Headline</h1><p>+ {m}</p><figure><img src=x><figcaption>+ A picture of {s}</figcaption></figure><p>+ {l}</p><ul><li>+ {s}</li><li>+ {s}</li></ul></main><footer><p>{m}</p></footer>',
    '<article><header><h1>+ Title</h1><p>+ {s}</p></header><p>+ {l}</p><div class="share"><a href=1>Post this</a></div><h2>+ {s}</h2><p>+ {m}</p><section class="comments"><p>{m}</p><p>{l}</p></section></article>',
    '<body><p>+ {l}</p><p>+ {l}</p><p>+ {m}</p><p><a href=1>{s}</a></p><p><a href=2>{s}</a></p></body>',
    '<div class="newsletter"><p>{s}</p><form>{s}<input></form></div><article><p>+ {l}</p><pre>+ code {s}</pre><p>+ {l}</p></article><div class="related-posts"><h3>More</h3><a href=1>{s}</a></div>',
    '<table><tr><td><a href=1>A</a><td><a href=2>B</a></table><h1>+ {s}</h1><p>+ {l}<p>+ {m}<p>+ {l}<hr><p><a href=1>back</a>',
    '<nav>{s}</nav><article><h1>+ {s}</h1><div class="notice">Please read our terms</div><p>+ {m}</p><p>+ {m}</p><div class="ad-slot">{m}</div><p>+ {s}</p></article>',
    '<div role="banner">{s}</div><div role="main"><h1>+ {s}</h1><p>+ {l}</p><p>+ {l}</p></div><div role="contentinfo">{m}</div>',
    '<article class="post has-comments"><h1>+ {s}</h1><p>+ {l}</p></article><div id="disqus"><article class="comment"><p>{l}</p></article></div>',
    '<body class="search-page"><main><p>+ {l}</p><dl><dt>+ {s}<dd>+ {m}<dt>+ {s}<dd>+ {m}</dl></main><aside><p>{l}</p></aside>',
]


def test_blocks_of_other_layouts():
    texts, hit, kept, wanted = {"s": "some four words here", "m": " ".join(["middling"] * 22), "l": LONG}, 0, 0, 0
    for page in PAGES:
        found = html_text.main_text(page.format(**texts), TREE).split("\n")
        every = [b.text for b in html_text.blocks(page.format(**texts))]
        good = sum(t.startswith("+ ") for t in found)
        hit, kept, wanted = hit + good, kept + len(found), wanted + sum(t.startswith("+ ") for t in every)
    assert 2 * hit / (kept + wanted) >= 0.95, (hit, kept, wanted)
