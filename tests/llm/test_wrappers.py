"""Pages whose layout wrappers carry words of adverts or menus in their names."""

from sheetloom.llm import html

BODY = "<p>" + "</p><p>".join(f"Sentence {i} of the story is here to be read." for i in range(12)) + "</p>"


def main_text(page):
    return html.main_text(page, html.Weights({}))[0]


def test_wrappers_do_not_hide_the_article():
    for mark in ('class="content has-sidebar"', 'id="page" class="no-ads"', 'class="search-results-article"',
                 'class="related-to-notices"', 'class="widget"'):
        for inner in (BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>"):
            page = f"<html><body><nav>Home News</nav><div {mark}>{inner}</div></body></html>"
            assert "Sentence 0 of" in main_text(page) and "Sentence 11 of" in main_text(page), (mark, inner[:9])
            assert "Home" not in main_text(page)


def test_adverts_inside_stay_out():
    page = f'<html><body><article>{BODY}<div class="ad">Buy now</div>{BODY}</article></body></html>'
    assert "Buy" not in main_text(page) and main_text(page).count("Sentence 11") == 2
    page = f'<html><body>{BODY}<div class="box sidebar">Other things to see</div></body></html>'
    assert "Other" not in main_text(page) and "Sentence 11" in main_text(page)
