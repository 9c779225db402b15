"""Pages that are legal or at least common, and markup that no parser likes."""

import random

import pytest

from postlens.llm.html_extraction import main_text

LONG = " ".join(["Some words of an article that goes on for a while."] * 6)


@pytest.mark.parametrize("html, text", [
    (f"<html><head><title>t</title><body><p>{LONG}</p></body></html>", LONG),
    (f"<head><meta charset=utf-8><title>t</title><h1>Head</h1><p>{LONG}</p>", f"Head\n{LONG}"),
    (f"<head><title>t</title>Text at once. {LONG}", f"Text at once. {LONG}"),
    (f"<body><form action=x><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></form></body>", f"Title\n{LONG}\n{LONG}"),
    (f'<body><div class="content with-sidebar"><p>{LONG}</p><div class="sidebar"><p>Links and more links</p></div></div></body>', LONG),
    (f'<body><nav><a href=x>Menu</a></nav><article class="post comments-open"><p>{LONG}</p></article></body>', LONG),
    (f"<body><article><p>{LONG}</p><button>Share<p>After it.</p></article></body>", f"{LONG}\nAfter it."),
    (f'<body><div class="comments"><div class="comment"><p>{LONG}</p></div></div><article><p>Short text of the page itself.</p></article></body>',
     "Short text of the page itself."),
])
def test_ordinary_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("odd", ["<![foo[x]]>", "<![ >", "<![", "<!x>", "<!>", "<![CDATA[x]]>", "<!DOCTYPE", "<?php x ?>", "<!--", "<!-- x --!>", "</>", "<!ELEMENT br EMPTY>", "<![if IE]>"])
def test_declarations_of_any_kind(odd):
    assert "Before it." in main_text(f"<p>Before it. {LONG}</p>{odd}")
    if odd.endswith(">"):
        assert main_text(f"<p>{LONG}</p>{odd}<p>b</p>") == f"{LONG}\nb"


def test_no_input_raises():
    r = random.Random(2)
    parts = ["<![", "<!", "]]>", ">", "<p>", "</p>", "<div class=x", "a", "&amp", "&#x110000;", "<head>", "</head>", "<form>", "<button>", "</form>", "--", "<!--", "\"", "'", "<script>", "</script>",
             "<svg>", "<br/>", "<a href=", "\u0000", "<table><tr><td>", "</html>", "[", "<nav>"]
    for _ in range(4000):
        assert isinstance(main_text("".join(r.choice(parts) for _ in range(r.randint(1, 25)))), str)
