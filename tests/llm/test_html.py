"""Pages whose text the block rules must not lose."""

import pytest

from varileaf.llm import html

LONG = "This is the story of the town and of the people who lived in it for a long time, and it was told by all of them to each other. " * 3


@pytest.mark.parametrize("around", ['<main class="with-sidebar">', '<div id="content" class="no-sidebar">', '<article class="post has-comments">', '<article class="post-share-enabled">', '<div class="site-banner">', '<article class="sidebar">'])
def test_names_around_the_article(around):
    name = around[1:].split()[0]
    page = f'<body><div class="cookie-notice">We use cookies for all of the things that you do on this site, and it is said that you like it.</div>{around}<p>{LONG}</p><p>{LONG}</p><div class="post-comments"><p>It was the best of all that I have read in this town.</p></div></{name}></body>'
    text = html.main_text(page)
    assert text.count("story of the town") == 6 and "cookies" not in text and "best of all" not in text


def test_named_parts_go():
    for name in ("ad", "sidebar", "post-comments", "pageFooter", "social share"):
        text = html.main_text(f'<body><p>{LONG}</p><div class="{name}"><p>{LONG[:127]}</p></div><p>{LONG}</p></body>')
        assert text.count("story of the town") == 6


@pytest.mark.parametrize(
    "sentence",
    [
        "Старый город стоял у реки, и люди жили там много лет, рассказывая друг другу истории о войне и мире. ",
        "Stare miasto stało nad rzeką, a ludzie mieszkali tam przez wiele lat, opowiadając sobie historie. ",
        "Eski şehir nehrin kıyısında duruyordu ve insanlar orada uzun yıllar birbirlerine hikâyeler anlatarak yaşadı. ",
        "古老的城市坐落在河边，人们在那里生活了许多年，互相讲述关于战争与和平的故事，孩子们在街上玩耍，老人们坐在门前看着过往的行人。",
    ],
)
def test_other_languages(sentence):
    menu = "<div>" + "".join(f"<a href='/{i}'>{sentence[:12]}</a> " for i in range(9)) + "</div>"
    text = html.main_text(f"<body>{menu}<div><p>{sentence * 5}</p><p>{sentence}</p><p>{sentence * 4}</p></div>{menu}</body>")
    assert text.count(sentence.strip()) == 10 and len(text.split("\n")) == 3


def test_low_density_goes_where_the_language_is_known():
    words = "Alpha Beta Gamma Delta Epsilon Zeta Theta Kappa Lambda Sigma Omega Phi Chi Psi Rho Tau " * 2
    assert "Gamma" not in html.main_text(f"<body><p>{LONG}</p><p>{LONG}</p><div>{words}</div></body>")


def test_quotes_count_only_where_a_value_begins():
    page = "<article><p class=don't>Hello this is the first text of the article</p><p>It is here</p></article>"
    assert html.main_text(page) == "Hello this is the first text of the article\nIt is here"
    for attributes in ["title=\"a > b\"", "title = 'a > b'", "a='x'b=\"y>\"", "title=\"it's > that\"", "o'clock", 'x"y', "data-x=5'6\"", "a= b='>'", "="]:
        assert html.main_text(f"<article><p {attributes}>{LONG}</p><p>It's here</p></article>").endswith("each other.\nIt's here")
    assert html.main_text(f"<article><p>{LONG}</p><p title=\"never closed>{LONG}</p></article>").count("story") == 3


def test_broken_pages_end():
    """Whatever stands between the tags: no exception, the same each time, and text of an article that is whole stays."""
    import random

    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class='ad'>", "</div>", "<", ">", "'", '"', "=", "<!--", "-->", "<![CDATA[", "]]>", "<script>", "</script>", "<a href=x'y>", "</a>", "&amp", "&#x41;", "&#0;", " text ", "<svg/>", "<article", "</", "<td>", "<br/>"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert html.main_text(page) == html.main_text(page)
        assert html.main_text(f"<article><p>{LONG}</p></article>{page}").startswith(LONG.strip())


def test_repeated_and_long_pages(spark):
    page = f"<article>{'<p>' + LONG + '</p>'}</article>"
    long = f"<article>{('<p>' + LONG + '</p>') * 5000}</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (3, "v", "", "y"), (4, "w", long, "z")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in out) == [(1, len(LONG.strip())), (1, len(LONG.strip())), (2, 0), (3, 0), (4, 5000 * (len(LONG.strip()) + 1) - 1)]
