"""The main text of pages without an article element, by density alone, and odd pages."""

import math
import random
import time

import pytest

from tilecairn.llm import html_text

LONG = ("A sentence of plain text that goes on for quite a while. " * 9).strip()


@pytest.mark.parametrize("wrapper", ["<div class='site-content no-sidebar'>", "<div class='post-with-comments'>", "<section class='entry share-enabled'>", "<form id='aspnetForm'>", "<div class='layout sidebar-right'>", "<table class='search'><tr><td>"])
def test_wrappers_of_the_main_text_stay(wrapper):
    tag = wrapper[1:].split()[0]
    page = f"<body><div><nav>menu</nav></div>{wrapper}<h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div></{tag}><footer>foot</footer></body>"
    assert html_text.main_text(page) == f"T\n{LONG}\n{LONG}"


def test_what_readers_wrote_goes():
    text = html_text.main_text
    main = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"T\n{LONG}\n{LONG}"
    signed = "".join(f"<div class=x><b class=author>{who}</b><p>nice post it is, says {who}</p></div>" for who in ("bob", "ann", "eve"))
    assert text(f"<body><article>{main}<article><p>nice post</p></article><article><p>no way</p></article></article></body>") == want
    assert text(f"<body><article>{main}<div class='user-remarks'><p>nice post</p><p>no way</p></div></article></body>") == want
    assert text(f"<body><div>{main}</div><div>{signed}</div></body>") == want
    assert text(f"<body><div class=post>{main}<ol><li><time>1</time><p>first!</p><li><time>2</time><p>second!</p></ol></div></body>") == want
    entries = "".join(f"<div class=post><h2>entry {i}</h2><span class=date>{i}</span><p>{LONG}</p></div>" for i in range(3))
    assert text(f"<body><div>{entries}</div></body>").count(LONG) == 3  # a list of entries is the main text


def test_what_lies_beyond_an_article_has_to_be_as_dense():
    text = html_text.main_text
    article = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>"
    assert text(f"<body>{article}<div>All rights reserved by nobody at all.</div></body>") == f"T\n{LONG}\n{LONG}"
    assert text(f"<body>{article}<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>").count(LONG) == 5


def brute_density(root):
    """Density sums by walking under each element anew."""

    def under(n):
        out = []
        for c in n.children:
            if not isinstance(c, str):
                out += [c, *under(c)]
        return out

    squeezed = lambda c: len(html_text.RUN.sub(" ", c).strip(html_text.SPACES))
    chars = lambda n: sum(squeezed(c) if isinstance(c, str) else chars(c) for c in n.children)
    links = lambda n: [c for c in n.children if not isinstance(c, str) and c.tag == "a"] + [y for c in n.children if not isinstance(c, str) and c.tag != "a" for y in links(c)]
    share = sum(chars(a) for a in links(root)) / max(chars(root), 1)

    def density(n):
        c, t = chars(n), max(len(under(n)), 1)
        lc = sum(chars(a) for a in links(n))
        lt = max(sum(x.tag == "a" for x in under(n)), 1)
        if not c:
            return 0.0
        base = math.log(math.log(c / max(c - lc, 1) * max(lc, 0) + share * c + math.e))
        return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / max(base, 0.1)

    nodes = [root, *under(root)]
    return nodes, [sum(density(c) for c in n.children if not isinstance(c, str)) for n in nodes]


def test_densities_against_brute_force():
    r = random.Random(11)

    def grow(depth):
        if depth == 0 or r.random() < 0.3:
            return "word " * r.randint(0, 30)
        tag = r.choice(["div", "p", "section", "a", "span", "ul"]) if depth > 1 else "p"
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(60):
        root = html_text.parse("<body>" + "".join(grow(5) for _ in range(4)) + "</body>")
        nodes, sums = brute_density(root)
        measured = html_text.measure(root)
        assert {id(x) for x in nodes} == {id(x) for x in measured}
        assert all(html_text.density_sum(x) == pytest.approx(s) for x, s in zip(nodes, sums, strict=True))
        assert html_text.density_sum(html_text.seed(measured)) == pytest.approx(max(sums))


@pytest.mark.parametrize("piece", ["<div>", "<span>", "<ul><li>", "<article>", "<table><tr><td>", "<p title='x>", "<article><div class=c><time>1</time>x"])
def test_deep_pages_take_linear_time(piece):
    began = time.time()
    assert html_text.main_text(piece * 20_000 + "deep' >deep").endswith("deep")
    assert time.time() - began < 5
