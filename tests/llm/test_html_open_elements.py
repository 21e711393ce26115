"""Elements without an end tag, and formulas, leave the article whole."""

from __future__ import annotations

import pytest

from tidewell.llm import html_extract


def texts(html):
    return " ".join(" ".join(t for t in html_extract.parse(html).text if t).split())


@pytest.mark.parametrize("name", ["noscript", "template", "iframe", "svg", "object", "select", "canvas", "audio", "video"])
def test_missing_end_tag_loses_nothing(name):
    page = "<body><article><p>One first.</p>{}<p>Two then.</p><p>Three last.</p></article></body>"
    assert texts(page.format(f"<{name}>")) == texts(page.format(f"<{name}><{name} class=x>")) == "One first. Two then. Three last."
    assert texts(page.format(f"<{name}>gone</{name}>")) == "One first. Two then. Three last."


def test_scripts_still_take_the_rest_and_formulas_are_text():
    assert texts("<p>One.</p><script>var a = '<p>two</p>'") == "One."
    formula = "<math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding=tex>x+1</annotation></semantics></math>"
    assert texts(f"<p>Let {formula} be odd.</p>") == "Let x+1 be odd."
