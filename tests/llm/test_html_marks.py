"""Pages whose template classes hold words that mark menus and adverts."""

import pytest

from tracelantern.llm import html_text

TEXT = ("plain words of an article " * 20).strip()


@pytest.mark.parametrize("page", [
    "<nav>menu</nav><article class='post category-social'><p>{}</p></article>",
    "<article class='post tag-promo'><p>{}</p></article>",
    "<main class='no-sidebar'><p>{}</p></main>",
    "<main class='promo'><p>{}</p></main>",
    "<article class='promo'><p>{}</p></article>",
    "<div class='content has-sidebar'><p>{}</p><div class='sidebar'><p>aside</p></div></div>",
    "<div class='content sidebar-left'><p>{}</p><div class='main-sidebar'><p>aside</p></div></div>",
])
def test_template_classes_keep_the_article(page):
    assert html_text.main_text(page.format(TEXT)) == TEXT


def test_marked_parts_still_go():
    page = f"<article><p>{TEXT}</p><div class='related-posts'><p>more</p></div><div id='commentList'>nice</div></article><article class='teaser'><p>x</p></article>"
    assert html_text.main_text(page) == TEXT
