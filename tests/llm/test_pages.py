"""op9 on pages whose names and wrappers mislead, on unclosed elements, and its time on pages of open tags."""

import time

import pytest

from prosemill.llm import html_text

PART = "Paragraph of the article which tells a long story, with several words and a sentence at its end. " * 2
ARTICLE, TEXT = f"<p>{PART}</p>" * 5, "\n".join([PART.strip()] * 5)


def page(inside):
    return f"""<html><body><nav><a href=x>Home</a></nav><div class="newsletter-signup"><p>Sign up for our newsletter now, it is free and you will like it a lot.</p></div>
    {inside}<div class="comments"><p>{PART} I as a reader say so.</p></div><form><p>Search the site</p></form><footer>Copyright</footer></body></html>"""


@pytest.mark.parametrize("inside", [
    f'<article class="social-history">{ARTICLE}</article>', f'<main id="skip-target">{ARTICLE}</main>', f'<div class="post widget">{ARTICLE}</div>', f"<form><article>{ARTICLE}</article></form>",
    f"<form id=aspnet><div id=x>{ARTICLE}</div></form>", f'<article><p>{PART}</p><section class="related-work">{f"<p>{PART}</p>" * 4}</section></article>',
])
def test_names_and_wrappers_veto_nothing(inside):
    assert html_text.main_text(page(inside)) == TEXT


@pytest.mark.parametrize("tag", ["svg", "math", "select", "object", "video", "audio", "canvas", "noscript", "datalist"])
def test_an_unclosed_element_takes_no_text(tag):
    assert html_text.main_text(page(f"<article>{ARTICLE}<{tag}><p>{PART}</p></article>")) == f"{TEXT}\n{PART.strip()}"
    assert html_text.main_text(page(f"<article>{ARTICLE}<{tag}>drawn</{tag}></article>")) == TEXT


def test_what_is_never_content():
    for name in ("comments", "cookie-banner", "share-buttons", "related-posts", "sidebar"):
        assert html_text.main_text(page(f'<article>{ARTICLE}</article><div class="{name}"><p>{PART}</p></div>')) == TEXT


def test_open_tags_take_linear_time():
    start = time.time()
    for text in ("<div>x " * 50_000, "<div></p>x<li>" * 25_000, "<svg>x " * 50_000, "<a><b>" * 50_000):
        html_text.main_text(text)
    assert time.time() - start < 20
