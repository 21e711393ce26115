"""Reading a page takes time in proportion to its length, and references of any length are read."""

from __future__ import annotations

import time

import pytest

from tidewell.llm import html_extract


@pytest.mark.parametrize(
    "part",
    ['<a "x ', "<div ", '<p a=">" ', "<!-- ", "</div>", "<head>", "<svg>", "<script ", "<p class='", "&#", "<"],
)
@pytest.mark.parametrize("end", ["", '">', "-->'"])
def test_hostile_pages_take_linear_time(part, end):
    html = "<article><p>Words.</p>" + part * (300_000 // len(part)) + end
    start = time.process_time()
    html_extract.parse(html)
    assert time.process_time() - start < 10


def test_deep_nesting_with_stray_end_tags():
    html = "<div>" * 60_000 + "text" + "</p></section>" * 60_000
    start = time.process_time()
    assert [t for t in html_extract.parse(html).text if t] == ["text"]
    assert time.process_time() - start < 10


def test_ends_of_tags_and_comments():
    read = lambda html: [t for t in html_extract.parse(html).text if t]
    assert read("<p>a</p><!-- no end > here") == ["a"]
    assert read("<p>a</p><!-- ended --> b") == ["a", "b"]
    assert read('<p title="1 > 0">a</p>') == ["a"]
    assert read('<p title="open>a</p>') == ["a"]
    assert read("<head><p>a</p>") == ["a"]
    assert read("a < b and <c") == ["a < b and <c"]


def test_references_of_any_length():
    assert html_extract.decoded("&#" + "9" * 9000 + ";x") == "�x"
    assert html_extract.decoded("&#" + "0" * 9000 + "65;&#x" + "0" * 9000 + "41;&amp;&#65;&#x41;&#233;") == "AA&AAé"
    assert html_extract.decoded("&#x" + "f" * 9000 + "; &#; &#x;") == "� &#; &#x;"


def test_tags_of_any_number_of_attributes():
    from tidewell.llm.html_extract import parse

    page = "<p " + 'a="1" ' * 5_000 + 'title="x > y">Some text here.</p>'
    assert [t for t in parse(page).text if t] == ["Some text here."]
    assert [t for t in parse(("<p title='>'> a " * 30_000) + '"').text if t][:2] == ["a", "a"]
