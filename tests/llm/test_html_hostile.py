"""Pages made to be slow or to end a tag early are read in linear time and whole."""

import time

from tessera.llm import html

WORDS = "The council met on Monday to talk about the new bridge over the river, which will cost more than was planned last year."


def timed(page):
    start = time.perf_counter()
    blocks = html.leaf_blocks(page, html.trained().index.__contains__)
    assert time.perf_counter() - start < 10
    return blocks


def test_quotes_in_an_unclosed_tag():
    timed("<a " + "\"'" * 100_000)
    timed("<a x=" + "\"'" * 100_000 + ">")
    timed('<a x="' * 100_000)
    timed("<a " * 100_000)
    timed("<a x='>" * 100_000)


def test_deep_nesting():
    blocks = timed("<div>x" * 100_000 + "</span></div>" * 100_000)
    assert len(blocks) == 100_000 and blocks[-1].leaf == "div"
    timed("".join(f'<d{i} class="c{"abcdefghij"[i % 10] * (i % 50)}">x' for i in range(50_000)))
    timed("<i><div>" + "<b>x" * 50_000 + "</i>" * 50_000)
    timed("<h1>x" * 50_000 + "<p>x" * 50_000 + "<svg>" * 50_000)


def test_long_attribute_is_one_value():
    for quote in "\"'":
        page = f"<article><p title={quote}{'a > b ' * 2000}{quote}>{WORDS}</p><p alt=it's>{WORDS} Again.</p></article>"
        assert [b.text for b in html.leaf_blocks(page)] == [WORDS, f"{WORDS} Again."]


def test_unclosed_quote_ends_at_the_next_bracket():
    assert [b.text for b in html.leaf_blocks(f'<p title="x>{WORDS}</p><p>More.</p>')] == [WORDS, "More."]
    assert [b.text for b in html.leaf_blocks("1 < 2 <3 <")] == ["1 < 2 <3 <"]
