"""Text blocks of pages: nothing lost behind open elements, no markup as text, inline marks, an independent parser."""

from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemill.llm import html

L = ("This is a paragraph of an article with many words in it, and it goes on, as articles do, for a while. " * 2).strip()
CASES = {
    "unclosed button": (f"<article><button>x<p>{L}</p><p>{L}</p></article><footer><button>ok</button></footer>", f"x\n{L}\n{L}"),
    "two buttons, one open": (f"<div><button>m<h1>Title of it</h1><p>{L}</p><button>b</button><p>{L}</p></div>", f"m\nTitle of it\n{L}\n{L}"),
    "self-closed svg": (f"<article><svg/><p>{L}</p><svg></svg></article>", L),
    "nested svg": (f"<article><svg><svg>x</svg>y</svg><p>{L}</p></article>", L),
    "open svg": (f"<article><svg><p>{L}</p></article><footer><svg></svg></footer>", L),
    "open canvas before another": (f"<article><canvas><p>{L}</p><canvas>x</canvas><p>{L}</p></article>", f"{L}\n{L}"),
    "textarea": (f"<article><p>{L}</p><textarea>typed</textarea><p>{L}</p></article>", f"{L}\n{L}"),
    "apostrophe in a value": (f"<article><p title=it's>{L}</p></article>", L),
    "apostrophe behind a quoted value": (f"<article><p data-x='a>b' title=it's>don't {L}</p></article>", f"don't {L}"),
    "inline advert": (f'<article><p>Start here. <span class="ad">Buy</span> and go on. {L}</p></article>', f"Start here. and go on. {L}"),
    "nested inline": (f'<article><p>A <ins class="ad">b <span>c</span> <span class="ad">d</span></ins> e. {L}</p></article>', f"A e. {L}"),
    "inline without an end": (f'<article><p>Start <span class="ad">and go on. {L}</p></article>', f"Start and go on. {L}"),
    "inline over blocks": (f'<article><p>A <span class="ad">b</p><p>{L}</p></span></article>', f"A\n{L}"),
    "discussion": (f'<article><p>{L}</p></article><div id="discussion"><p>{L} me too</p></div><section class="responses"><p>{L} I think</p></section>', L),
    "paragraph named story-links": (f'<article><p class="story-links">{L}</p></article>', L),
    "less than": (f"<article><p>if a < b and c > d. {L}</p></article>", f"if a < b and c > d. {L}"),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    page, want = CASES[case]
    assert html.main_text(page, np.array(list(html.PRIOR.values()))) == want


class _Seen(HTMLParser):
    """All text that is shown, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in html.SILENT or tag in ("head", "script", "style"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in html.SILENT or tag in ("head", "script", "style"):
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_blocks_hold_what_another_parser_sees():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist()
    assert len(pages) > 1000
    for page in pages:
        seen = _Seen()
        seen.feed(page or "")
        seen.close()
        assert "".join("".join(b.text for b in html.blocks(page or "")).split()) == "".join("".join(seen.out).split())


def test_long_unbalanced_page_stays_linear():
    for page in ("<button>" * 200_000, "<span class=ad>" * 200_000 + "</span>" * 100_000, "<p title='" * 100_000, "<svg" * 200_000):
        html.blocks(page)
