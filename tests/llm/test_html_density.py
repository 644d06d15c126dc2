"""What names, articles and densities decide about a page."""

import random
import re
from math import e, log

import pytest

from codeloom.llm import html_density as H

FULL = "Plain sentences that make up the article, one after the other, as long as need be. " * 3
SHOWN = FULL.strip()


def around(part):
    yield f"<body><article><p>{FULL}</p>{part}<p>{FULL}</p></article></body>"
    yield f"<body><div><p>{FULL}</p>{part}<p>{FULL}</p></div></body>"


@pytest.mark.parametrize("part", [
    '<h2 id="related-work">Related work</h2>', '<h2 id="copyright-law" class="search">Copyright law</h2>',
    f'<section id="search-algorithms"><p>{FULL}</p></section>', f'<section id="search"><p>{FULL}</p></section>',
    f'<p class="lead social-studies">{FULL}</p>', f'<div class="login-systems"><p>{FULL}</p></div>',
    "<p>one <label>two</label> three</p>", '<p>a <span class="share">shared</span> word</p>', f'<blockquote class="reply">{FULL}</blockquote>',
])
def test_names_do_not_overrule_text(part):
    want = " ".join(re.sub("<[^>]*>", "", part).split())
    for page in around(part):
        assert H.main_text(page).split("\n") == [SHOWN, want, SHOWN]


@pytest.mark.parametrize("part", [
    '<div class="ad">Buy now, it is cheap, and it is here today only!</div>', '<div id="cookie-notice">We use cookies on this site.</div>',
    f'<div class="comments"><p>{FULL}</p></div>', '<ul class="related-posts"><li><a href="x">One</a></li></ul>',
    '<div class="social-studies"><a href="1">Share</a> <a href="2">Tweet</a></div>',
    '<section class="newsletterSignup">Write us your name and we write you back.</section>',
    '<div class="search-algorithms"><span>a</span><span>b</span><i>c</i><b>d</b></div>',
])
def test_furniture_goes_by_name(part):
    for page in around(part):
        assert H.main_text(page) == f"{SHOWN}\n{SHOWN}"


def test_articles_beside_the_core_stay():
    page = (f"<body><nav>x</nav><main><article><p>{FULL}</p><p>{FULL}</p></article><article><p>{FULL}</p></article>"
            f"<article><a href='1'>Teaser</a></article></main><article><p>outside of main, {FULL}</p></article></body>")
    assert H.main_text(page) == f"{SHOWN}\n{SHOWN}\n{SHOWN}"


def random_page(rnd, depth=0):
    parts = []
    for _ in range(rnd.randrange(1, 4)):
        tag = rnd.choice(["div", "a", "span", "b", "section"])
        deeper = depth < 3 and tag != "a" and rnd.random() < 0.6
        inner = random_page(rnd, depth + 1) if deeper else "w" * rnd.randrange(0, 60)
        parts.append(f"<{tag}>{inner}</{tag}>" + "t" * rnd.choice([0, 0, 9]))
    return "".join(parts)


def facts(node):
    """Characters, tags, link characters and link tags, by recursion."""
    c, t, lc, lt = 0, 1, 0, 0
    for child in node.children:
        got = (len(child), 0, 0, 0) if isinstance(child, str) else facts(child)
        c, t, lc, lt = c + got[0], t + got[1], lc + got[2], lt + got[3]
    return (c, t, c, lt + 1) if node.tag == "a" else (c, t, lc, lt)


def test_densities_equal_their_definition():
    """C/T * log_b(C/LC * T/LT), b = ln(C/NLC * LC + LCb/Cb * C + e), at least e; an empty count is 1."""
    rnd = random.Random(3)
    for _ in range(80):
        nodes = H.parse(f"<body>{random_page(rnd)}</body>")
        body = H.measure(nodes)
        cb, _, lcb, _ = facts(body)
        want = {}
        for node in nodes:
            c, t, lc, lt = facts(node)
            if c:
                base = max(e, log(c / max(c - lc, 1) * lc + lcb / max(cb, 1) * c + e))
                want[id(node)] = c / t * max(0.0, log(c / max(lc, 1) * t / max(lt, 1), base))
        for node in nodes:
            assert node.density == pytest.approx(want.get(id(node), 0.0))
            assert node.total == pytest.approx(sum(want.get(id(n), 0.0) for n in node.children if not isinstance(n, str)))
        core = max((n for n in nodes if n.chars and H._within(n, body)), key=lambda n: n.total, default=None)
        if core is not None and core.total > 0:
            assert any(H._within(core, n) for n in H.article(nodes))
