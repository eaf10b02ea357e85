import html
import re
import time

from lambertlake.llm import html_text as ht

LONG = "This is the text of the article and it is long enough to be taken for what it is. " * 4


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
    <div class="cookie-notice">We use cookies on this site to make it better for you and all others.</div>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div id='sidebar'><p>{LONG}</p></div><!-- <p>no</p> -->
    <article><header><h1>The &lt;Title&gt;</h1></header><p><b>Bold.<br><p>One&nbsp; two
    three</p><p>Be.</p><div class="ad">Buy this now</div><p>{LONG}</p><form><label>Name</label><input></form>
    <ul><li>A point</li><li><a href=x>Link only</a></li></ul>
    <section id="comments"><p>{LONG}</p></section></article><aside>{LONG}</aside><footer>&copy; me</footer>"""
    assert ht.main_text(page).split("\n") == ["The <Title>", "Bold.", "One two three", "Be.", LONG.strip(), "A point"]


def test_names_of_furniture():
    kept = "<article><div class='entry-header'><h1>Title</h1></div><p>Text.</p>"
    for name in ("siteFooter", "user-comments", "cookie_bar", "ad ad-1", "newsletter-signup", "siteHeader"):
        page = f"<div class='{name}'><p>{LONG}</p></div>{kept}<div id={name}>no</div></article>" if name != "siteHeader" else f"<div class='{name}'><p>{LONG}</p></div>{kept}</article>"
        assert ht.main_text(page) == "Title\nText.", name
    assert ht.main_text(f"<article><p class='inside-addition'>{LONG}</p></article>") == LONG.strip()


def test_page_without_article():
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><h1>Heading</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div><a>x</a></div><p>Imprint</p>"
    assert ht.main_text(page).split("\n") == ["Heading", LONG.strip(), "Short one.", LONG.strip()]


def test_densities_decide_inside_articles():
    links = "".join(f"<li><a href={i}>Another page that is of some interest to you {i}</a></li>" for i in range(5))
    page = f"<article><h1>Heading</h1><p>{LONG}</p><ul>{links}<li>Between links</li>{links}</ul><p>{LONG}</p><p><a href=x>All of it a link</a></p><p>Be.</p></article><p>Imprint</p>"
    assert ht.main_text(page).split("\n") == ["Heading", LONG.strip(), LONG.strip(), "All of it a link", "Be."]
    first = [ht.first_pass(b) for b in ht.blocks(page)]
    assert first == [ht.OPEN, ht.GOOD, *[ht.BAD] * 5, ht.OPEN, *[ht.BAD] * 5, ht.GOOD, ht.OPEN, ht.OPEN, ht.OPEN]
    # Without anything decided the element itself counts as a good neighbour.
    assert ht.main_text("<main><p>Žádné časté slovo</p><pre>x = 1</pre></main>") == "Žádné časté slovo\nx = 1"


def test_whole_names_inside_articles():
    for attrs in ("class='notice-board'", "id=side-note", "class=share-price", "class='form-factor x'", "class='reply-rate'", "class='article-header'"):
        assert ht.main_text(f"<article><p {attrs}>Text of it.</p><section {attrs}><p>More</p></section></article>") == "Text of it.\nMore", attrs
    for attrs in ("class='notice'", "class='cookie-notice x'", "id=ad-slot-3", "class='x share-buttons'", "class=relatedPosts", "role=navigation", "hidden"):
        assert ht.main_text(f"<article><p>Text.</p><p {attrs}>no</p><section {attrs}><p>no</p></section></article>") == "Text.", attrs


def test_deep_elements_are_closed():
    for n in (3, 9, 60, 3000):
        deep = "".join(f"<div><em class=x{i}>" for i in range(n))
        page = f"<article><p>One.</p><div class=ad>no{deep}no</div><p>Two.</p>"
        assert ht.main_text(page.replace("</div>", "</em></div>" * n + "</div>")) == "One.\nTwo.", n
        inline = f"<article><p>One.<span class=ad>no{'<div>' * n}no<span>no</span>no{'</div>' * n}</span></p><p>Two.</p>"
        assert ht.main_text(inline) == "One.\nTwo.", n
        item = f"<article><p>{LONG}</p><ul><li>{'<section>' * n}<a href=x>Link only</a></ul><p>{LONG}</p>"
        assert ht.main_text(item) == LONG.strip() + "\n" + LONG.strip(), n
    began = time.process_time()
    ht.main_text("<article>" + "<div>" * 30_000 + "</p></section>" * 30_000 + "<aside>" + "<article>" * 30_000)
    assert time.process_time() - began < 5


def test_formulas_and_noscript():
    assert ht.main_text("<noscript>Turn it on</noscript><article><p>Mass <math><mi>m</mi><mo>=</mo><mn>1</mn></math> g</p><noscript>Still here</noscript><svg><text>no</text></svg></article>") == "Mass m=1 g\nStill here"


def test_malformed_pages():
    assert ht.main_text("<article><p>a < b & c &am<p>x</b></div> y <p title='") == "a < b & c &am\nx\ny"
    assert ht.main_text("<nav><ul><li>no<article><p>yes") == "yes"
    assert ht.main_text(None) == ht.main_text("") == ht.main_text("<p>") == ""
    assert ht.main_text("<article>" + "<p" * 20000) != ""  # no tag ever ends, so it is text
    assert ht.main_text("<article><p>" + 'x "' * 50000 + "<b \"" * 2000) != ""


def test_values_of_any_length():
    for n in (10, 4096, 5000, 300_000):
        for q, other in ("\"'", "'\""):
            value = f"{q}{'x' * n}<p class={other}ad{other}> hidden > {q}"
            page = f"<article><p data-a={value}>One.</p><div data-b = {value} class='ad'>no</div><x-frame srcdoc={value}/><p>Two.</article>"
            assert ht.main_text(page) == "One.\nTwo.", n
    assert ht.main_text("<article><p title=it's>One.</p><p a='>Two.</p>" + "x" * 5000) == "One.\nTwo.\n" + "x" * 5000


def test_quotes_take_linear_time():
    for unit in ('<b a="', "<b a='<b a=\"", "<b a=\"'>", "<b ='=\"", "'= = ='<b ", '="<b "= = ', '<b =" ="', "<b = "):
        began = time.process_time()
        ht.main_text("<article><b =\"" + unit * 40_000 + "<")
        assert time.process_time() - began < 10, unit


def test_names_around_the_text_do_not_remove_it():
    article = f"<article><h1>Title</h1><p>{LONG}</p></article>"
    for around in ("<html class='no-js nav-open'>", "<html class=nav><body class='sidebar header'>", "<body class='home blog no-sidebar'>", "<div class='content-sidebar-wrap'>", "<div class='sidebar-left'>", "<div id=header-main>", "<form action=x>", "<form class=search><div class=menu>", "<div class=menu><main class=sidebar><div class='content-wrap'>"):
        page = f"{around}<div class='top-menu'><a href=1>one</a> and more</div>{article}<div class=sidebar><p>{LONG}</p></div>"
        assert ht.main_text(page) == "Title\n" + LONG.strip(), around
    # On pages without an article or main element, around most of the text.
    for around in ("<div class='has-header'>", "<body class='nav'>", "<form id=aspnetForm>", "<div class='sidebar-left'><form class=page>", "<div id=header-main>"):
        page = f"<div class=menu>{'Menu ' * 9}</div>{around}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><form>Send it</form><div class=sidebar><p>{LONG}</p></div>"
        assert ht.main_text(page) == "\n".join(["Title", LONG.strip(), LONG.strip()]), around


def test_comments_stay_out_whatever_their_share():
    comments = "".join(f"<article class=comment><p>{LONG * 4}</p></article>" for _ in range(5))
    for around in ("<div id=comments>", "<section class='comments-area'>", "<div class='related posts'>"):
        assert ht.main_text(f"<main><p>{LONG * 4}</p></main>{around}{comments}") == (LONG * 4).strip(), around


def test_hidden_as_an_attribute_of_its_own():
    for attrs in ("aria-hidden='false'", "data-hidden-on='print'", "class=hidden-xs", "data-class='ad'", "data-id=nav", "title='hidden'", "x-hidden"):
        assert ht.main_text(f"<article><p {attrs}>Text.</p></article>") == "Text.", attrs
    for attrs in ("hidden", "HIDDEN=''", "class=x hidden id=y", "hidden=until-found"):
        assert ht.main_text(f"<article><p>Text.</p><p {attrs}>no</p></article>") == "Text.", attrs


def test_other_languages_and_undecided_pages():
    han = "\u6c49\u5b57\u7684\u6587\u7ae0" * 24
    menu = "<ul><li><a href=1>\u4e00</a><li><a href=2>\u4e8c</a></ul>"
    assert ht.main_text(f"<body>{menu}<h1>\u9898</h1><p>{han}</p><p>{han}</p><div class=footer>{han}</div>") == f"\u9898\n{han}\n{han}"
    assert ht.main_text("<body><p>Dobry</p><p>den</p>") == "Dobry\nden"


def test_raw_elements_take_linear_time():
    for unit in ("<title ", "<script>", "<svg>x", "<style </style", "<title><script "):
        began = time.process_time()
        assert ht.main_text(f"<article><p>{LONG}</p>" + unit * 100_000).startswith(LONG.strip())
        assert time.process_time() - began < 10, unit
    assert ht.main_text("<article><script a='>'>no</SCRIPT ><p>yes<title>no</title></p><textarea>no</article>") == "yes"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in ht.op1_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", rows[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.url == rows[r.page_id].url and r.n_chars == len(r.text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "<article>x", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in ht.extract(df).collect()) == ["", "", "x"]
    assert ht.extract(df.limit(0)).count() == 0
