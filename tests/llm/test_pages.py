"""Comments, several articles and parts named by compounds."""

import pytest

from siftline.llm.linedist import main_text

LONG = "The harbour was closed to all ships for most of the winter, and the town lived on what it had stored. " * 6
LONG = LONG.strip()
SAID = "I lived there as a child and never saw the harbour closed for more than a week, whatever the winter was like."
TEXT = f"<p>{LONG}</p><p>Second, shorter.</p>"
WANT = f"{LONG}\nSecond, shorter."


@pytest.mark.parametrize(
    "page",
    [
        f'<main><article>{TEXT}</article><section id="comments"><h2>2 comments</h2><article class="comment-body"><p>{SAID}</p></article><article class="comment-body"><p>{SAID}</p></article></section></main>',
        f'<article>{TEXT}<div class="post-comments"><p>{SAID}</p></div></article>',
        f'<article>{TEXT}<div class="entry-comments"><p>{SAID}</p></div></article>',
        f'<article>{TEXT}<div class="comment-content"><p>{SAID}</p></div></article>',
        f'<article>{TEXT}<div class="story-ads"><p>{SAID}</p></div></article>',
        f'<article>{TEXT}<div class="content-sidebar"><p>{SAID}</p></div></article>',
        f'<article>{TEXT}<div class="article-related"><p>{SAID}</p></div></article>',
        f'<article>{TEXT}<footer class="entry-footer"><p>{SAID}</p></footer></article>',
        f'<div class="text">{TEXT}</div><ol class="commentlist"><li><p>{SAID}</p></li><li><p>{SAID}</p></li></ol>',
        f'<div class="text">{TEXT}</div><ol class="comment-list"><li id="comment-1"><p>{SAID}</p></li></ol>',
        f"<main><article>{TEXT}</article><article><h3>More</h3><p>Ice on the lake.</p></article><article><p>Snow in May.</p></article></main>",
        f'<article>{TEXT}</article><article class="related-story"><p>{SAID}</p><p>{SAID}</p><p>{SAID}</p></article>',
        f"<article>{TEXT}<article><p>{SAID}</p></article></article>",
        f'<aside><article><p>{SAID}</p></article></aside><article>{TEXT}</article>',
        # comments that are longer than what they are on
        f'<article>{TEXT}</article><div id="comments">' + f"<p>{SAID}</p>" * 60 + "</div>",
        f'<main><article>{TEXT}</article><div id="disqus">' + f"<article><p>{SAID}</p></article>" * 60 + "</div></main>",
    ],
)
def test_what_is_beside_goes(page):
    assert main_text(f"<html><body>{page}</body></html>") == WANT


@pytest.mark.parametrize(
    "page",
    [
        # what is called after the parts that it has, or has not
        f'<div class="with-comments">{TEXT}</div>',
        f'<article class="post comments-open">{TEXT}</article>',
        f'<article class="no-comments">{TEXT}</article>',
        f'<div class="comments-closed">{TEXT}</div>',
        f'<div class="sidebar-right"><main>{TEXT}</main></div>',
        f'<div class="comments"><article>{TEXT}</article></div>',
        f'<div class="related"><article>{TEXT}</article></div>',
        f'<article class="comment">{TEXT}</article>',
        f'<div class="commentary">{TEXT}</div>',
        f'<article class="article-commentary">{TEXT}</article>',
    ],
)
def test_what_holds_the_text_stays(page):
    assert main_text(f"<html><body>{page}</body></html>") == WANT


def test_articles_of_like_size_all_stay():
    page = f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p><p>{SAID}</p></article><article><p>{LONG}</p></article></main>"
    assert main_text(page) == f"{LONG}\n{LONG}\n{SAID}\n{LONG}"


def test_heads_of_articles_stay():
    assert main_text(f'<article><div class="entry-header"><h1>On harbours</h1></div>{TEXT}</article>') == f"On harbours\n{WANT}"
    assert main_text(f"<main><h1>On harbours</h1><article>{TEXT}</article></main>") == f"On harbours\n{WANT}"
