"""Main text on probes, on held-out pages and on very long pages."""

import time

import numpy as np
import pytest

from orrery.llm import html_text

TREE = html_text.trained()
HELD_OUT = [
    '<html><body><div id="menu"><a href=x>Home</a><a href=x>Blog</a></div><div id="main-content"><h1>+Cooking rice</h1><p>+Rinse it.</p><p>+Then put it into a pot with twice as much water as there is rice, and a pinch of salt.</p><p>+Wait.</p></div><div id="footer">Powered by a blog engine</div></body></html>',
    "<div class=navbar><ul><li><a href=x>Docs</a></li><li><a href=x>API</a></li></ul></div><main><h1>+Install</h1><p>+Run this:</p><pre>+make install</pre><p>+See the <a href=x>guide</a> for more.</p></main><footer><p>Built with care</p></footer>",
    '<div class="advertisement">The best shoes of the year are here, buy two and pay for one only</div><article><h2>+Match report</h2><p>+They won.</p><aside>Related: they lost last week against the same team at home</aside><p>+It was the third time in a row that they did so, and the crowd was happy about it.</p></article><div class="comments-list"><p>What a match that was, I have never seen the like of it before</p></div>',
    "<center><a href=x>Index</a> <a href=x>Mail</a></center><h2>+My trip</h2><p>+We went to the lake in the early morning, when there was still fog over the water and nobody else about.</p><p>+We stayed there until the evening and then went home by the same road that we had come on.</p><center><a href=x>Back to the index</a></center>",
    '<nav>Menu <a href=x>A</a></nav><div role="main"><p>+One short line.</p><p>+Another one.</p></div><div class="social-links"><a href=x>Follow us</a></div><form>Search this site<input></form>',
]


@pytest.mark.parametrize("page", HELD_OUT)
def test_pages_that_the_tree_was_not_trained_on(page):
    found = html_text.blocks(page)
    assert html_text.main_text(page, TREE).split("\n") == [b[0] for b in found if b[0].startswith("+")]


def test_lengths_drawn_anew():
    wrong = total = 0
    for page in html_text.labelled_pages(99):
        found = html_text.blocks(page)
        for block, keep in zip(found, html_text.decide(TREE, html_text.features(found))):
            wrong += bool(keep) != block[0].startswith("+")
            total += 1
    assert total > 1000 and wrong <= 0.01 * total


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title=it's>Hello there, you</p><p>I don't know</p>", "Hello there, you\nI don't know"),
        ("<article><section id='social-history'><p>One.</section><div class='grid side-by-side'>Two.</div></article>", "One.\nTwo."),
        ("<article><p>Area <math><mi>x</mi></math>.<figure><figcaption>A caption</figcaption></figure></article>", "Area x.\nA caption"),
        ("<nav><a href=x>Home</a><article><h1>Head</h1><p>Text.</article>", "Head\nText."),
        ("<a href=x><div>All of it linked</div></a><article><p>Text.</article>", "Text."),
        ("<article><p>a < b, 5 <6 &amp; &lt;p&gt;<p>c</article>", "a < b, 5 <6 & <p>\nc"),
        ('<article><p data-x="</article>">In.<p>  Two\n\t words </article><div class="ad-slot">Buy</div>', "In.\nTwo words"),
        (None, ""),
        ("", ""),
    ],
)
def test_probes(page, text):
    assert html_text.main_text(page, TREE) == text


def test_class_words_stand_alone_or_beside_neutral_ones():
    assert html_text.named('class="site-footer"') == (True, False) and html_text.named("id=cookieNotice") == (True, False)
    assert html_text.named("class='social-history side-by-side reply2015-study'") == (False, False)
    assert html_text.named('class="post-content"') == (False, True) and html_text.named('data-class="ad"') == (False, False)


@pytest.mark.parametrize("page", ["<a " * 300_000 + "'", "<div>" * 200_000, "<" * 1_000_000, "<a href='" * 100_000, "</div>" * 200_000, "<svg><foreignobject>" + "<div>" * 200_000, "<p>a " * 100_000, "<title>x</title>" * 60_000])
def test_a_page_of_a_megabyte_takes_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page, TREE)
    assert time.perf_counter() - start < 5


def test_tables_without_rows_repeated_rows_and_other_columns(spark):
    rows = [(1, "u", "<article><p>a</article>", "x"), (1, "u", "<article><p>a</article>", "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.extract(df.where("false")).count() == 0


class Plain:
    """A second reader of simple, well-formed pages: blocks by a stack over html.parser, then the trained tree by hand."""

    def __init__(self, page):
        from html.parser import HTMLParser

        blocks, open_, buffer = [], [], {"text": "", "linked": 0}

        def close():
            words = buffer["text"].split()
            if words:
                blocks.append((" ".join(words), len(words), min(buffer["linked"], len(words)), open_[-1][0] in ("h1", "h2", "h3") if open_ else False, any(t in html_text._FURNITURE for t, _ in open_), any(bad for _, bad in open_), any(t == "article" for t, _ in open_) and not any(t == "nav" for t, _ in open_)))
            buffer.update(text="", linked=0)

        class Reader(HTMLParser):
            links = 0

            def handle_starttag(self, tag, attributes):
                if tag == "a":
                    self.links += 1
                else:
                    close()
                    open_.append((tag, any(k == "class" and v in ("ad", "comments", "sidebar") for k, v in attributes)))

            def handle_endtag(self, tag):
                if tag == "a":
                    self.links -= 1
                else:
                    close()
                    open_.pop()

            def handle_data(self, data):
                buffer["text"] += data
                buffer["linked"] += len(data.split()) if self.links else 0

        Reader().feed(page)
        close()
        self.blocks = blocks

    def text(self, tree):
        kept = []
        for i, (text, words, linked, *hints) in enumerate(self.blocks):
            near = [self.blocks[j] if 0 <= j < len(self.blocks) else ("", 0, 0) for j in (i - 1, i + 1)]
            row = [words, linked / max(words, 1), near[0][1], near[0][2] / max(near[0][1], 1), near[1][1], near[1][2] / max(near[1][1], 1), *hints]
            node = tree
            while len(node) > 1:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            kept += [text] if node[0] else []
        return "\n".join(kept)


def test_generated_pages_equal_a_plain_second_reader():
    draw = np.random.default_rng(11)
    words = lambda most: " ".join(f"w{x}" for x in draw.integers(0, 99, draw.integers(1, most)))
    for _ in range(300):
        parts = []
        for _ in range(draw.integers(1, 9)):
            body = [words(30), f"<a>{words(5)}</a>", f"{words(20)} <a>{words(5)}</a> {words(20)}"][draw.integers(0, 3)]
            tag = ["p", "div", "h1", "h2", "li"][draw.integers(0, 5)]
            block = f"<{tag}>{body}</{tag}>"
            around = [None, None, "article", "nav", "footer", "aside", 'div class="ad"', 'div class="comments"', "section"][draw.integers(0, 9)]
            parts.append(f"<{around}>{block}{block}</{around.split()[0]}>" if around else block)
        page = "".join(parts)
        assert html_text.main_text(page, TREE) == Plain(page).text(TREE), page


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Text one here.</p><div class='user-comments'><p>I liked it.</p></div></article>", "Text one here."),
        ("<article><p>Text <span class='ad'>Buy now</span> goes on.</p></article>", "Text goes on."),
        ("<article><p>Text of it.</p><p hidden>secret</p><div style='display: none'>more</div></article>", "Text of it."),
        ("<article><h1>A head</h1><nav><a href=x>One</a><a href=x>Two</a></nav><p>Some text of a page that goes on.<p><a href=x>A link of it</a></article>", "A head\nSome text of a page that goes on.\nA link of it"),
    ],
)
def test_furniture_inside_an_article(page, text):
    assert html_text.main_text(page, TREE) == text


def test_words_and_links_decide():
    page = "<nav><ul><li><a href=x>Home</a><li><a href=x>Blog</a><li><a href=x>About us</a></ul></nav><article><h1>Head line</h1><p>Text of the page with a few words.<p>More of it.</article>"
    found = html_text.blocks(page)
    x = html_text.features(found)
    assert html_text.main_text(page, TREE) == "Head line\nText of the page with a few words.\nMore of it."
    x[:, [1, 3, 5]] = 0
    assert html_text.decide(TREE, x)[:3].all()
    assert TREE[0] not in html_text.HINTS
