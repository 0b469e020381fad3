"""Odd pages: quotes, unclosed tags, comments and notices inside an article."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheetloom.llm import html

BODY = " ".join(f"Sentence number {i} tells the reader something new." for i in range(12))
REMARKS = " ".join(f"I do not agree with point {i} at all." for i in range(60))


def texts(page):
    return " ".join(v for kind, v, role, _ in html.items(page) if kind == "text" and role != "never")


@pytest.mark.parametrize("mark", ['class="comments"', 'class="comment-list"', 'id="comment_section"', "class=cookie-banner",
                                  'id="gdpr"', 'class="box advert-top"'])
def test_comments_notices_and_adverts_are_no_text(mark):
    for page in (f"<article><p>{BODY}</p><div {mark}><p>{REMARKS}</p></div></article>",
                 f"<body><article><p>{BODY}</p></article><section {mark}><p>{REMARKS}</p></section></body>",
                 f"<body><div><p>{BODY}</p></div><div {mark}><p>{REMARKS}</p></div></body>"):
        assert "Sentence" in texts(page) and "agree" not in texts(page)


@pytest.mark.parametrize("mark", ['class="has-comments"', 'class="no-advert page"', 'class="no-ads"', 'id="with_cookie"'])
def test_wrappers_that_only_say_what_a_page_has(mark):
    assert "Sentence" in texts(f"<body><div {mark}><p>{BODY}</p></div></body>")
    assert "Sentence" in texts(f"<body><div class='comments-page'><article><p>{BODY}</p></article></div></body>")


@pytest.mark.parametrize("tag", ["<p title=Bob's>", '<p title=5">', "<p title='a > b'>", '<p title="x>y" class=k>', "<p data-x=' '>"])
def test_odd_quotes_lose_nothing(tag):
    page = f"<article>{tag}{BODY}</p><p>Last one.</p></article>"
    assert texts(page).split() == (BODY + " Last one.").split()


def test_the_scan_is_linear():
    for piece in ("<a ", "<a b=\"", "<", "<!--", "<script>", "<!x", "<a b='>", "</p ", "<a b=\"'", "&"):
        page = piece * (1_000_000 // len(piece))
        start = time.perf_counter()
        for _ in html.tags(page):
            pass
        assert time.perf_counter() - start < 5, piece


@given(st.text(alphabet="<>/!-= \"'abp", max_size=60))
def test_tags_are_in_order_and_within_the_page(page):
    at = 0
    for start, end, name, closing, attributes in html.tags(page):
        assert at <= start < end <= len(page) and page[start] == "<"
        assert not name or page[end - 1] == ">" and attributes in page[start:end]
        at = end
