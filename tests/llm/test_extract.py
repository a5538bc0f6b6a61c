"""HTML extraction against a plain reader of article elements, and case by case."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from docloom.llm.extract import Page, extract_pages
from docloom.session import table

BODY = "<p>" + "Running text, of some length, that goes on. " * 5 + "</p>"
SCHEMA = "page_id long, url string, html string"


class Plain(HTMLParser):
    """All text inside article elements, a line a block."""

    def __init__(self):
        super().__init__()
        self.on = self.skip = 0
        self.out, self.line = [], []

    def cut(self):
        if text := " ".join("".join(self.line).split()):
            self.out.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in "p h1 h2 h3 div article section ul ol li table tr td".split():
            self.cut()
        elif tag == "br":
            self.line.append(" ")
        self.on += tag == "article"
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in "p h1 h2 h3 div article section ul ol li table tr td".split():
            self.cut()
        self.on -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.on and not self.skip:
            self.line.append(data)


def test_all_pages_equal_a_plain_reader(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    want = {}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.cut()
        want[r.page_id, r.url] = "\n".join(plain.out)
    got = {(r.page_id, r.url): r.text for r in extract_pages(pages).collect()}
    assert got == want and all(want.values())


@pytest.mark.parametrize("attrs", ['aria-hidden="false"', 'style="overflow:hidden"', 'title="the hidden rules"', 'data-id="ad-3"', 'data-role="form"', 'class="post-header"', 'class="entry-header"', 'class="share-price"', 'class="side-effects"', 'class="legal-analysis"', 'class="related-work"', 'class="form-factor"', 'class="search-theory"', 'class="notice"', 'class="header"'])
def test_article_parts_stay(attrs):
    assert "Kept" in Page(f"<article>{BODY}<div {attrs}><h2 class=header>Kept</h2></div></article>").main_text()


@pytest.mark.parametrize("attrs", ["hidden", 'style="color:red; display: none"', 'class="ad"', "class=ad-slot", 'id="comments"', 'class="comment-list"', 'class="cookie-notice"', 'role="navigation"', 'class="newsletter-signup box"', 'class="sidebar-left"'])
def test_other_parts_go(attrs):
    assert Page(f"<article>{BODY}<div {attrs}><p>Gone</div>after</article>").main_text().split("\n")[1:] == ["after"]


def test_inline_parts_links_and_names_around_the_article():
    page = Page(f'<article>{BODY}line <span class="ad">x<span>y</span>z</span> on <a href=x>link</a><div class="related"><a href=1>one</a> <a href=2>two</a></div></article>')
    assert page.main_text().split("\n")[1:] == ["line on link"]
    assert "Running" in Page(f'<body><div class="content sidebar"><h1>T</h1>{BODY}</div>').main_text()
    threads = f'<body><article>{BODY}</article><div id="comments"><article class="comment-body">{BODY * 3}</article></div>'
    assert Page(threads).main_text() == BODY[3:-4].strip()


def test_pages_vote_out_repeated_notices(spark):
    say = lambda i: f"<article><h1>Title {i}</h1><p>{f'Own words {i} of this page, and more. ' * 9}</p>"
    pages = [(i, f"http://a.x/{i}", say(i) + '<div class="notice">We use a new site.</div></article>') for i in range(4)]
    pages += [(10 + i, f"http://b.x/{i}", say(i) + f'<div class="notice">Mind step {i}.</div></article>') for i in range(4)]
    # copies of one page are one vote
    pages += [(20 + i, f"http://c.x/{i}", say(0) + '<div class="notice">Careful.</div></article>') for i in range(4)]
    got = {r.page_id: r.text.split("\n")[-1] for r in extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(got[i].startswith("Own words") and got[10 + i] == f"Mind step {i}." and got[20 + i] == "Careful." for i in range(4))


def test_ties_clashing_columns_and_long_pages(spark):
    text = "word, " * 100
    # two paths with a vote each: the first in order goes on, where it holds a page's text
    pages = [(1, "http://t.x/1", f"<body><div class=b><p>{text}</div>"), (2, "http://t.x/2", f"<body><div class=a><p>{text}</div>"), (3, "http://l.x", "<article>" + "<p>some words.</p>" * 100_000), (None, None, None)]
    df = spark.createDataFrame(pages, SCHEMA)
    for c in ("path", "votes", "voted", "host", "text", "n_chars"):
        df = df.withColumn(c, F.lit("x"))
    got = {r.page_id: r for r in extract_pages(df).collect()}
    assert got[1].text == got[2].text == text.strip() and got[1].path_votes == 1 and got[3].n_chars == 12 * 100_000 - 1 and got[None].text == ""


@pytest.mark.parametrize("piece", ["<a ", '<a x="', "<![CDATA[", "<div>", "<div class=notice>x", "</span>", "<!-", "<p>x", "<script ", "</", '<a x="\'>', '<div class="a b"><p>t'])
def test_broken_markup_takes_linear_time(piece):
    began = time.process_time()
    Page(piece * 50_000).main_text()
    assert time.process_time() - began < 5


TEXT = "Running text, of some length, that goes on. " * 5
SAID = "A comment, with its own words, that is as long as any text here. " * 9


@pytest.mark.parametrize(
    "html",
    [
        f"<body><form action=x><div class=page>{BODY}<input><select><option>No</select><button>Go</button></div></form></body>",
        f"<body><dialog open>{BODY}</dialog><nav><a href=x>No</a></nav></body>",
        f"<article>{BODY}<section><article><p>{SAID}</article><article><p>{SAID}</article></section></article>",
        f"<article>{BODY}<article><p>{SAID}</p></article></article>",
        f"<body><div class=story>{BODY}</div><div class=talk>" + f"<div class=post><span class=author>Ann</span><time>1 May</time><p>{SAID}</div>" * 4 + "</div>",
        f"<body><div class=story>{BODY}</div><section>" + f"<article><p>{SAID}<a href=x class=reply-link>Reply</a></article>" * 3 + "</section>",
        f'<article><p title={" " * 300}"b>x">{TEXT}</article>',
        f"<body><div class=masthead><h1>Site</h1><p>Since 1990</div><header class=site-header>Site</header><div class=story>{BODY}</div>",
        f"<article>{BODY}<div aria-hidden=true><p>{TEXT}</div><div style='visibility: hidden'><p>{TEXT}</div><div class=user-comments><p>{SAID}</div></article>",
    ],
)
def test_frames_comments_and_hidden_parts(html):
    assert Page(html).main_text() == TEXT.strip()


@pytest.mark.parametrize("part", ["<div class=commercial>Kept</div>", f"<div class=content-navigation><p>Kept {TEXT}</div>", "<table><tr><td class=login>Kept</td></tr></table>", "<div class=entry><time>1 May</time><p>Kept</div>"])
def test_parts_of_an_article_stay_in_spite_of_names(part):
    assert "Kept" in Page(f"<article>{BODY}{part}</article>").main_text()


def test_lists_of_posts_are_no_comments():
    post = f"<article><span class=author>Ann</span><time>1 May</time>{BODY}</article>"
    assert Page(f"<body><div><p>{TEXT}</p>{post * 3}</div>").main_text().count(TEXT.strip()) >= 3
    entry = f"<div class=entry><span class=author>Ann</span><time>1 May</time>{BODY}</div>"
    assert Page(f"<body><main>{entry * 3}</main>").main_text().count(TEXT.strip()) == 3


def made_page(host, n):
    """(html, article) of a made page: ten hosts, two templates each, with menus, notices, comments of any number and forms around all."""
    rng = random.Random(f"{host}/{n}")
    say = lambda least: " ".join(f"{rng.choice('abcdefgh')}word{rng.randrange(900)}," for _ in range(rng.randrange(least, 3 * least)))
    paragraphs = [say(40) for _ in range(rng.randrange(2, 6))]
    second = rng.random() < 0.3 and host % 3 == 0
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    story = {0: f"<article><h1>Title {n}</h1>{inner}</article>", 1: f"<div class='story s{n}'><h1>Title {n}</h1>{inner}</div>", 2: f"<div id=x><section class=txt><h1>Title {n}</h1>{inner}</section></div>", 3: f"<main><h1>Title {n}</h1>{inner}</main>"}[(host + second) % 4]
    one = {0: "<li class=c><b class=user>u</b> <time>now</time><p>{}</p></li>", 1: "<div class=talk><span class=byline>u</span><span class=when>now</span><p>{}</p></div>", 2: "<div class=msg><p>{}</p><a class=reply href=x>Reply</a></div>"}[host % 3]
    comments = "".join(one.format(say(30)) for _ in range(rng.choice([0, 1, 2, 5, 12])))
    menu = "<div class=top-menu><a href=1>Home</a> <a href=2>News</a></div><nav><ul><li><a href=3>More</a></ul></nav>"
    body = f"<header>Site {host}</header>{menu}{story}<div class=lower>{comments}</div><div class=notice>Host {host} has a notice for all.</div><footer>End of {host}</footer>"
    return f"<html><body>{f'<form method=post>{body}<button>Send</button></form>' if host % 5 == 4 else body}</body></html>", "\n".join([f"Title {n}", *paragraphs])


def test_made_pages_of_ten_hosts(spark):
    """Scoring, votes and extraction again give the article that each page was made of."""
    made = {(h, n): made_page(h, n) for h in range(10) for n in range(30)}
    rows = [(100 * h + n, f"http://h{h}.x/{n}", html) for (h, n), (html, _) in made.items()]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = [k for k, (_, text) in made.items() if got[100 * k[0] + k[1]] != text]
    assert wrong == []
