"""The density rule of the page extractor against a plain recursion, and pages on which it decides."""

import math
import random
import time

import pytest

from chronoloom.llm import htmltext

LONG = "Enough words follow here to make one paragraph as dense as any other of its kind."


class Node:
    def __init__(self, tag, parts):
        self.tag, self.parts = tag, parts

    def html(self):
        return f"<{self.tag}>" + "".join(p if isinstance(p, str) else p.html() for p in self.parts) + f"</{self.tag}>"

    def kids(self):
        return [p for p in self.parts if not isinstance(p, str)]

    def count(self, linked=False):
        """Characters, tags, link characters, link tags."""
        linked = linked or self.tag == "a"
        c = t = lc = lt = 0
        for p in self.parts:
            if isinstance(p, str):
                c += len(p.replace(" ", ""))
                lc += len(p.replace(" ", "")) * linked
            else:
                c2, t2, lc2, lt2 = p.count(linked)
                c, t, lc, lt = c + c2, t + t2 + 1, lc + lc2, lt + lt2 + (p.tag == "a")
        return c, t, lc, lt

    def walk(self):
        yield self
        for k in self.kids():
            yield from k.walk()


def density(node, share, linked):
    c, t, lc, lt = node.count(linked)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    return c / max(1, t) * max(0.0, math.log(c / max(1, lc) * max(1, t) / max(1, lt)) / max(1.0, math.log(base) + 1))


def blocks(node):
    """The nearest block elements below."""
    for k in node.kids():
        if k.tag in ("div", "p"):
            yield k
        else:
            yield from blocks(k)


def tree(r, depth):
    parts = []
    for _ in range(r.randrange(1, 5)):
        if depth and r.random() < 0.6:
            parts.append(tree(r, depth - 1))
        else:
            words = " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(1, 30)))
            parts.append(Node(r.choice("a p p b".split()), [words]))
    return Node("div", parts)


@pytest.mark.parametrize("seed", range(40))
def test_core_has_the_largest_density_sum(seed):
    body = Node("body", [tree(random.Random(seed), 3)])
    page = htmltext.Page(body.html())
    own, _ = page._lengths()
    gone = [False] * len(page.tag)
    got, total, _ = page.densities(own, gone)
    c, _, lc, _ = body.count()
    share = lc / c
    nodes = list(body.walk())
    assert page.tag[1:] == [x.tag for x in nodes]
    inside = {id(k): x.tag == "a" for x in nodes for k in x.kids()}
    want = [density(x, share, inside.get(id(x), False)) for x in nodes]
    assert got[1:] == pytest.approx(want)
    by = {id(x): d for x, d in zip(nodes, want, strict=True)}
    sums = [(sum(by[id(k)] for k in blocks(x)) or by[id(x)]) if x.tag in ("div", "p", "body") else 0.0 for x in nodes]
    assert total[1:] == pytest.approx(sums)
    assert total[page.core(gone, total)] == pytest.approx(max(sums))


def paragraphs(*names):
    return "".join(f"<p>{n} {LONG}</p>" for n in names)


def text(*names):
    return "\n".join(f"{n} {LONG}" for n in names)


def test_density_decides_without_any_names():
    menu = "<div>" + "".join(f'<div><a href="/{k}">Section {k}</a></div>' for k in range(8)) + "</div>"
    page = f"<body>{menu}<div><h2>Title</h2>{paragraphs('a', 'b', 'c')}</div>{menu}<div>foot <a href='/'>home</a> <a href='/x'>more</a></div></body>"
    assert htmltext.main_text(page) == "Title\n" + text("a", "b", "c")


def test_parts_beside_and_below():
    two = f"<body><main><article>{paragraphs('a', 'b')}</article><article>{paragraphs('c')}</article></main></body>"
    assert htmltext.main_text(two) == text("a", "b", "c")
    deep = f"<body><div><div><h1>Title</h1>{paragraphs('a')}</div><div><div><div>{paragraphs('b', 'c', 'd')}</div></div></div></div></body>"
    assert htmltext.main_text(deep) == "Title\n" + text("a", "b", "c", "d")
    short = f"<body><article>{paragraphs('a', 'b')}<p>Yes.</p><h2>Half</h2>{paragraphs('c')}<p>End.</p></article></body>"
    assert htmltext.main_text(short) == text("a", "b") + "\nYes.\nHalf\n" + text("c") + "\nEnd."


def test_names_yield_only_to_a_denser_wrapper():
    tiny = "<div><p>x</p></div>"
    assert htmltext.main_text(f'<body>{tiny}<div class="notice">{paragraphs("a", "b", "c")}</div></body>').endswith(text("a", "b", "c"))
    assert htmltext.main_text(f'<body><div class="notice"><p>{LONG}</p></div><div>{paragraphs("a", "b", "c")}</div></body>') == text("a", "b", "c")
    assert htmltext.main_text(f'<body><article><p>Short.</p></article><div class="ad">{LONG}</div></body>') == "Short."


@pytest.mark.parametrize("piece, rest", [("<div>", "</span>"), ("<article>", "</b>"), ("<a href='x>y ", ""), ('<p "', ""), ("<b><p>", "")])
def test_time_is_linear_in_stray_tags(piece, rest):
    def took(n):
        at = time.process_time()
        htmltext.main_text(piece * n + rest * n)
        return time.process_time() - at

    took(1000)
    assert took(40_000) < 20 * max(took(5_000), 0.02)


def test_long_page():
    many = [f"n{k}" for k in range(5000)]
    assert htmltext.main_text(f"<body><article>{paragraphs(*many)}</article></body>") == text(*many)
