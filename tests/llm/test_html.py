"""HTML extraction on pages whose main text is known."""

from __future__ import annotations

import random

import pytest

from tallybar.llm import html_extract
from tallybar.llm.html_extract import composite, extract_text, measure, parse

LONG = "Some words that make a sentence of a good length, and then some more of them. "
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


def page(body, head="<title>T</title><style>p{}</style><script>var x = '</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(("body", "want"), [
    (f"{NAV}<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>", ["Head", LONG.strip(), "Short."]),
    (f"{NAV}<div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>Bold.<br><p>{LONG}</article><footer>f", ["A & B", "Bold.", LONG.strip()]),
    (f"<header>Site</header>{NAV}<div id=content><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>Last.</p></div><div class='sidebar widget'><p>{LONG}</p></div>", ["Head", LONG.strip(), LONG.strip(), "Last."]),
    (f"<main><article><p>{LONG}</p></article></main><section id='comments'><p>{LONG * 9}</p></section><aside>{LONG}</aside>", [LONG.strip()]),
    (f"<article><p>{LONG}</p><!-- <p>no</p> --><form><p>{LONG}</p></form><ul><li>one<li>two</ul><noscript><p>no</p></noscript></article>", [LONG.strip(), "one", "two"]),
    (f"<article><p>a&nbsp;&#98; \n\t c&lt;p&gt;</p><pre>x\n y</pre><table><tr><td>{LONG}<td>z</table></article>", ["a b c<p>", "x y", LONG.strip(), "z"]),
    (f"<div class='cookie-notice'><p>{LONG}</p></div><article><header><h1>In</h1></header><p>{LONG}</p><div hidden>{LONG}</div></article>", ["In", LONG.strip()]),
])
def test_known_pages(body, want):
    assert extract_text(page(body)) == "\n\n".join(want)


def test_cut_and_odd_pages():
    whole = page(f"{NAV}<article><h1>Head</h1><p>{LONG}</p></article>")
    cut = whole[: whole.index("sentence") + 8]
    assert extract_text(cut) == "Head\n\nSome words that make a sentence"
    assert [extract_text(x) for x in (None, "", "<", "<p", "<!--", "<script>x", page(""), "</p></div>")] == ["", "", "<", "", "", "", "", ""]
    assert extract_text("just text") == "just text"
    assert extract_text("<p>" * 20_000 + "x") == "x"
    assert extract_text("<b>" * 20_000 + "x" + "<div>y</div>" * 50) == "\n\n".join(["x", *["y"] * 50])
    assert extract_text("<article>" + "<div>" * 5_000 + LONG + "</span>" * 5_000 + "</article>") == LONG.strip()
    assert len(extract_text(page(f"<article>{'<p>' + LONG + '</p>'}</article>".replace(LONG, LONG * 20_000)))) == len(LONG) * 20_000 - 1


def test_densities():
    root = parse(page(f"<div><p>{LONG}</p></div><div><a href=x>{LONG}</a></div>"))
    nodes = {n.tag: n for n in measure(root)}
    assert nodes["p"].density > nodes["a"].density == 0
    assert composite(0, 1, 0, 0, 0.5) == 0 and composite(100, 1, 0, 0, 0.0) > composite(100, 10, 0, 0, 0.0) > composite(100, 10, 60, 5, 0.6)


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "clash"), (1, "u", page(f"<article><p>{LONG}</p></article>"), "clash"), (2, None, None, None), (None, "v", "", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(((r[0] or -1, r[1], r[2]) for r in got.collect()), key=str) == sorted([(1, "u", LONG.strip())] * 2 + [(2, None, ""), (-1, "v", "")], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PROSE = f"<h1>Head</h1><p>{LONG}</p><p>{LONG * 2}</p>"
WANT = "\n\n".join(["Head", LONG.strip(), (LONG * 2).strip()])
MENU = "<div>" + "".join(f'<a href="/{i}">Entry {i} of it</a> | ' for i in range(12)) + "</div>"


@pytest.mark.parametrize("around", [
    '<div class="content has-sidebar">%s</div>', '<div class="no-ads">%s</div>', '<div id="skip-target">%s</div>', '<div class="site-content no-sidebar search-enabled">%s</div>',
    '<div title="a hidden gem">%s</div>', '<p class="share">Share%s', '<ul><li class="ad">Buy</ul>%s', '<p class="share">Share<p hidden>x%s', "<article>%s</article><article><h2><a href=x>Teaser</a></h2><p>short</p></article>",
    "<article><div>%s</div>" + MENU + "</article>", "<div><section>%s</section></div>" + MENU,
])
def test_names_and_densities_that_mislead(around):
    assert extract_text(page(NAV + around % PROSE)) == WANT


def test_noise_in_lists_ends_with_its_item():
    assert extract_text(page("<article><ul><li class=ad>Buy<li>one</ul><p>two</article>")) == "one\n\ntwo"


def by_recursion(node, share):
    """(density, density sum, characters, tags, linked characters, links) by the definition, from a nested (tag, children)."""
    tag, items = node
    below = [by_recursion(x, share) for x in items if not isinstance(x, str)]
    chars = sum(len("".join(x.split())) for x in items if isinstance(x, str)) + sum(b[2] for b in below)
    tags = len(below) + sum(b[3] for b in below)
    linked = chars if tag == "a" else sum(b[4] for b in below)
    links = sum(b[5] for b in below) + sum(1 for x in items if not isinstance(x, str) and x[0] == "a")
    return composite(chars, tags, linked, links, share), sum(b[0] for b in below), chars, tags, linked, links


def written(node):
    return f"<{node[0]}>" + "".join(x if isinstance(x, str) else written(x) for x in node[1]) + f"</{node[0]}>"


def every(node):
    return [node, *[y for x in node[1] if not isinstance(x, str) for y in every(x)]]


def text_of(node):
    """Blocks of a nested node as their words."""
    return [w for x in node[1] for w in (x.split() if isinstance(x, str) else text_of(x))]


def test_menus_by_brute_force():
    """A body of sections, some of them menus without a name: what is left is told by the definition alone."""
    rng = random.Random(8)
    dropped = 0
    for _ in range(60):
        prose = lambda: ("section", [("p", [LONG * rng.randint(1, 3)]) for _ in range(rng.randint(1, 4))])
        menu = lambda: ("div", [("a", [f"entry {rng.randint(1, 99)} of it "]) for _ in range(rng.randint(2, 9))] + [LONG[: rng.randint(0, 60)]])
        body = ("html", [rng.choice((prose, prose, menu))() for _ in range(rng.randint(2, 5))])
        share = by_recursion(body, 0.0)[4] / max(by_recursion(body, 0.0)[2], 1)
        told = {id(x): by_recursion(x, share) for x in every(body)}
        best = max(every(body), key=lambda x: told[id(x)][1])
        path = [x for x in every(body) if any(y is best for y in every(x))]
        bound = min(told[id(x)][0] for x in path)
        menus = [x for p in path for x in p[1] if not isinstance(x, str) and x not in path and x[0] in ("div", "section") and told[id(x)][5] > 1 and 2 * told[id(x)][4] > told[id(x)][2] and told[id(x)][0] < bound]
        want = [w for x in body[1] if not any(x is m for m in menus) for w in text_of(x)]
        assert extract_text(written(body)).split() == want
        dropped += len(menus)
    assert dropped > 10


def test_density_decides(monkeypatch):
    pages = [page(PROSE.join(("<div>", "</div>")) + MENU), page("<article><div>%s</div>%s</article>" % (PROSE, MENU))]
    before = [extract_text(x) for x in pages]
    monkeypatch.setattr(html_extract, "composite", lambda *_: 1.0)
    assert before == [WANT, WANT] and all(extract_text(x) != b for x, b in zip(pages, before, strict=True))
