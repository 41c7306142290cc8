import random

import pytest

from tallyframe.llm.html_text import Page, extract, main_text
from tests.llm.brute import with_clash

PAGES = "page_id long, url string, html string"
BOILER = ('<header><h2>Site</h2></header><nav><ul><li><a href="/a">menu one</a></ul></nav><div class="cookie-notice">We use cookies</div>'
          '<aside>side</aside><form><label>mail</label><input><button>go</button></form><div class="ad">Buy</div><script>var a="<p>no</p>";</script>')
TAIL = '<div id="comments"><p>nice post, reader says with many words in it</p></div><footer>&copy; site</footer>'


@pytest.mark.parametrize(("article", "text"), [
    ("<article><h1>Title</h1><p>One &amp; <b>t</b>wo.</p><p>Three<br>four &nbsp; five</p></article>", "Title One & two. Three four five"),
    ("<article><h1>A<p>un<i>closed<p>para &eacute;&#x41;", "A unclosed para éA"),
    ('<div class="post-12"><p>long main text of the page</p><ul><li>x<li>y</ul></div>', "long main text of the page x y"),
    ("<main><!-- <p>gone</p> --><p>kept text</p><style>p{}</style><section class=comments><p>reader</p></section></main>", "kept text"),
    ('<div class="content with-sidebar"><p>the text of the page</p><div class="adbox">Buy</div></div>', "the text of the page"),
    ("<table><tr><td>left cell text of the page that is long enough<td>right</table>", "left cell text of the page that is long enough"),
])
def test_page_shapes(article, text):
    for html in (BOILER + article + TAIL, article):
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{html}"
        got = extract(page, None)
        assert got == text
        assert not any(x in got for x in ("cookies", "reader says", "menu one", "Buy", "mail", "gone"))


def test_broken_markup():
    for html in ("", "<", "<p", "plain text", "</div></p>text", "<div" * 500, "<a href='x>y'>z</a>", "<p>" * 3000 + "x", "<script>never closed", "a < b > c"):
        assert isinstance(extract(html, "html>body>article"), str)
    assert extract("plain text", None) == "plain text"
    assert Page("<div><p>a</div>").best().path == "div"


def test_hosts_agree(spark):
    good = '<html><body><div class="content-{}"><p>{}</p></div><div class="teaser"><p>{}</p></div></body></html>'
    rows = [(i, f"http://x.example/{i}", good.format(i, "main words " * 9, "teaser words " * (5 if i else 12))) for i in range(6)]
    rows += [(7, None, None), (8, "http://x.example/8", ""), (None, "HTTP://X.example:80/9?q", good.format(9, "again main " * 9, "t")), (1, rows[1][1], rows[1][2]),
             (10, "http://y.example", "<article>" + "<p>long words</p>" * 20_000 + "</article>")]
    got = sorted((str(r.page_id), r.text) for r in main_text(with_clash(spark.createDataFrame(rows, PAGES))).collect())
    assert len(got) == len(rows)
    want = {str(i): " ".join(["main words"] * 9) for i in range(6)}  # page 0 as well, though its teaser is longer
    assert all(t == want[i] for i, t in got if i in want)
    assert dict(got)["None"] == " ".join(["again main"] * 9) and dict(got)["7"] == "" and dict(got)["8"] == ""
    assert len(dict(got)["10"]) == 20_000 * 11 - 1
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_no_part_of_an_article_is_lost():
    rng = random.Random(7)
    for _ in range(300):
        parts, want = [], []
        for i in range(rng.randrange(1, 5)):
            text = " ".join(f"w{i}x{j}" for j in range(rng.randrange(1, 60)))
            shape = rng.choice(["<p>{}</p>", "<h1>{}</h1>", '<section class="part-{i}"><p>{}</p></section>', "<section class=body><p>{}</p></section>",
                                "<div class=body>{}</div>", "<blockquote>{}</blockquote>", "<div><div><p>{}</p></div></div>"])
            parts.append(shape.format(text, i=i) + rng.choice(["", '<div class="ad">Buy</div>', "<nav><a href=x>go</a></nav>"]))
            want.append(text)
        tag = rng.choice(["article", "main", 'div class="post-7"'])
        page = f"<html><body>{BOILER}<{tag}>{''.join(parts)}</{tag.split()[0]}>{TAIL}</body></html>"
        outer = "html>body>" + ("div.post-#" if " " in tag else tag)
        for path in (None, outer, outer + ">section.body", outer + ">section.part-#", outer + ">div.body", "html>body>gone"):
            assert extract(page, path) == " ".join(want), (page, path)


def test_lead_and_sections_without_an_article():
    lead, body = "lead words " * 9, "body words " * 11
    want = " ".join((lead + body).split())
    for html in (f"<body><section class=intro>{lead}</section><section class=body>{body}</section>", f"<body><h1>{lead}</h1><div class=body>{body}</div>",
                 f"<section>{lead}</section><section>{body}</section>", f"<article>{lead}</article><article class=x>{body}</article>",
                 f"<body><main><h1>{lead}</h1><article>{body}</article></main>"):
        for path in (None, "body>section.body", "body>div.body", "section", "article.x"):
            assert extract(html, path) == want, (html, path)


def test_lead_and_section_on_a_host_whose_pages_have_the_section(spark):
    section = "<article><section class=body><p>" + "body text " * 11 + "</p></section></article>"
    rows = [(i, f"http://z.example/{i}", section) for i in range(5)] + [(5, "http://z.example/5", section.replace("<section", "<p>" + "lead text " * 9 + "</p><section"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[5] == " ".join(["lead text"] * 9 + ["body text"] * 11) and got[0] == " ".join(["body text"] * 11)


def test_what_an_author_names_stays():
    from tallyframe.llm.html_text import BOILERPLATE
    for word in sorted(BOILERPLATE):
        article = (f'<article><h2 id="{word}-work">head</h2><p id="{word}">one</p><section id="{word}"><p data-role="{word}">two</p></section>'
                   f'<blockquote class="{word}-xyz" data-class="{word}">three</blockquote><ul class="{word}-of-restaurant" id={word}s><li>four</ul></article>')
        for html in (article, BOILER + article + TAIL):
            assert extract(html, None) == "head one two three four", word


def test_whole_classes_and_roles_go():
    for token in ("ad", "site-nav", "comment-list", "post-comments", "sidebar-left", "share-buttons", "cookie_banner", "related-posts"):
        assert extract(f'<article><p>kept</p><div class="x {token}">gone</div><p>too</p></article>', None) == "kept too", token
    assert extract('<article><p>kept</p><div role="complementary">gone</div></article>', None) == "kept"
    assert extract('<div id="sidebar">gone</div><div class="text"><p>kept</p></div><div id=comments>gone</div>', None) == "kept"


def test_attribute_values_as_in_the_standard():
    assert extract("<p title=it's>Hello world</p><p>don't stop</p>", None) == "Hello world don't stop"
    assert extract('<p title="a>b" class=\'x">\'>one</p><p a=b"c>two</p><a href=/x/>three</a>', None) == "one two three"
    assert extract('<p title="never closed>one</p><p>two', None) == "one two"
    assert extract("<p>a</p><script>no</script ><p>c<style>no</style x>d", None) == "a cd"


@pytest.mark.parametrize("html", [
    "<div>" * 66_666 + "text", "<p title=\"a'b>text" * 18_333, "<p title='x\">t" * 23_333, ("<p title='x>t") * 26_666, "<b><div>" + "<i>" * 46_666 + "</b>" * 46_666,
    "<i>" * 46_666 + "<p>a" * 46_666, "<" * 333_333, "<!--" * 83_333, "<!" * 133_333, "<a " + "=" * 300_000, "<a " + "b " * 150_000 + ">x", "<script>" * 40_000,
    "<ul><li>" * 40_000 + "x", '<div class="a b">' * 20_000 + "text"], ids=lambda h: h[:12])
def test_long_pages_take_linear_time(html):
    import time
    start = time.process_time()
    extract(html, "html>body>article")
    assert time.process_time() - start < 6  # seconds for a third of a megabyte; quadratic steps take minutes
