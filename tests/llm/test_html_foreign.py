"""Tags whose content is skipped do not take the article with them."""

import pytest

from tessera.llm import html

FIELD = html.trained()
WORDS = "The council met on Monday to talk about the new bridge over the river, which will cost more than was planned last year."


@pytest.mark.parametrize("tag", ['<svg width="1"/>', "<math/>", "<noscript>", "<template>", "<svg>", "<math>"])
def test_text_after_the_tag_stays(tag):
    page = f"<html><body><article><h1>A new bridge</h1><p>{WORDS}</p>{tag}<p>{WORDS} Again.</p></article></body></html>"
    assert html.main_text(page, FIELD).endswith("Again.")


def test_closed_ones_are_still_skipped():
    page = f"<html><body><article><p>{WORDS}</p><svg><text>no</text></svg><noscript>no</noscript><p>{WORDS} Again.</p></article></body></html>"
    text = html.main_text(page, FIELD)
    assert text.endswith("Again.") and " no " not in text
