import pytest

from orrery.llm import html_text


@pytest.mark.parametrize("part", ["<svg width='1'/>", "<svg><path d=x/><title/></svg>", "<svg><g><text>drawn</text>", "<math/>", "<noscript>", "<object data=x>", "<select><option>One", "<svg><style/></svg>"])
def test_text_after_an_element_without_end_is_kept(part):
    page = f"<nav><a href=x>n</a></nav><article><h1>Head</h1><div>{part}<p>First words.</div><p>Last words.</article><footer>f</footer><svg></svg>"
    assert html_text.main_text(page, html_text.trained()) == "Head\nFirst words.\nLast words."


def test_formulas_objects_and_captions_are_text():
    page = "<article><h1>Head</h1><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.<noscript><p>No script here.</noscript><object data=x>An object.</object><figure><img src=x><figcaption>A caption.</figcaption></figure><p>Last.</article><select><option>One</select>"
    assert html_text.main_text(page, html_text.trained()) == "Head\nIf x=2 holds.\nNo script here.\nAn object.\nA caption.\nLast."


def test_link_words_after_a_drawing_stay_link_words():
    assert [b[1:3] for b in html_text.blocks("<p><a href=x><svg><path/></svg>Home page</a>")] == [(2, 2)]
