"""Which parts of a page are its main text."""

import pytest

from plumbline.llm import html_text

STORY = [f"Paragraph {k} of the story has a good number of plain words, and it goes on for a while." for k in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in STORY)


def test_story_beside_article_cards():
    cards = "".join(f"<article><h3><a href=x>Card {k}</a></h3><p>Short teaser.</p></article>" for k in range(4))
    text = html_text.main_text(f"<body><div class=page><div class=story>{BODY}</div><div class=cards>{cards}</div></div></body>")
    assert text.split("\n")[: len(STORY)] == STORY


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "content-with-sidebar", "site-content share-enabled", "widget"])
def test_wrappers_keep_the_article(name):
    page = f"<body><div class='{name}'><article>{BODY}</article></div><div class='sidebar'><p>Other things</p></div></body>"
    assert html_text.main_text(page).split("\n") == STORY


@pytest.mark.parametrize("attributes", ["class='x ad'", "id=ad-banner", "role='navigation'", "hidden", "class=x hidden=''", "style='display: none'", "aria-hidden=true"])
def test_parts_that_go(attributes):
    assert html_text.main_text(f"<article>{BODY}<div {attributes}>Buy this</div></article>").split("\n") == STORY


@pytest.mark.parametrize("attributes", ["title='the hidden city'", "data-x='a hidden b'", "title='display:none'", "class='add'"])
def test_values_are_not_names(attributes):
    assert html_text.main_text(f"<article>{BODY}<p {attributes}>More text</p></article>").split("\n") == [*STORY, "More text"]


@pytest.mark.parametrize(
    "name",
    "post-comments comment-list comments-area comments-section user-comments comment-body reader-comments commentThread comments "
    "sidebar-left site-footer cookie-bar ad-wrapper related-posts newsletter-box".split(),
)
@pytest.mark.parametrize("around", ["main", "div"])
def test_names_of_other_parts(name, around):
    other = f"<div class='{name}'><p>A reader says something here.</p></div>"
    assert html_text.main_text(f"<body><{around}>{BODY}{other}</{around}></body>").split("\n") == STORY


@pytest.mark.parametrize("name", ["post-content", "main-content", "article-body", "story", "entry-content left", "content-section", "commentary"])
def test_names_of_the_article(name):
    assert html_text.main_text(f"<body><main><div class='{name}'>{BODY}</div></main></body>").split("\n") == STORY
