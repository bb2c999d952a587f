"""Main text of pages against a naive tree, and pages on which the densities decide."""

import math
import random
import time

import pytest

from faultline.llm import html_text as H


class Tree:
    """An element: its parts are trees, texts and links ("a", text)."""

    def __init__(self, tag, parts):
        self.tag, self.parts = tag, parts

    def source(self):
        inner = "".join(p.source() if isinstance(p, Tree) else f'<a href="x">{p[1]}</a>' if isinstance(p, tuple) else p for p in self.parts)
        return f"<{self.tag}>{inner}</{self.tag}>"

    def below(self):
        yield self
        for p in self.parts:
            if isinstance(p, Tree):
                yield from p.below()

    def kids(self):
        return [p for p in self.parts if isinstance(p, Tree)]

    def own(self):
        return [p for p in self.parts if not isinstance(p, Tree)]

    def chars(self):
        return sum(len(p[1] if isinstance(p, tuple) else p) for t in self.below() for p in t.own())

    def link_chars(self):
        return sum(len(p[1]) for t in self.below() for p in t.own() if isinstance(p, tuple))

    def links(self):
        return sum(isinstance(p, tuple) for t in self.below() for p in t.own())

    def tags(self):
        return sum(1 for _ in self.below()) + self.links()

    def density(self, share):
        c, lc = self.chars(), self.link_chars()
        if not c:
            return 0.0
        up = math.log(math.e + c / max(1, lc) * self.tags() / max(1, self.links()))
        return c / self.tags() * up / math.log(math.e + c * lc / max(1, c - lc) + share * c)

    def total(self, share):
        with_text = [k for k in self.kids() if k.chars()]
        own = sum(len(p[1] if isinstance(p, tuple) else p) for p in self.own())
        return sum(k.density(share) for k in with_text) + (own if with_text else self.density(share))


def random_tree(rng, depth=0):
    words = lambda n: " ".join(rng.choice(("tin", "copper", "iron", "gold", "lead")) for _ in range(n))
    if depth > 3 or (depth > 1 and rng.random() < 0.5):
        n = rng.choice((1, 3, 8, 30, 80))
        return Tree("p", [("a", words(n))] if rng.random() < 0.35 else [words(n)])
    return Tree("div", [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))])


def test_best_node_and_threshold_against_a_naive_tree():
    rng = random.Random(7)
    for _ in range(300):
        body = Tree("body", [random_tree(rng, 1) for _ in range(rng.randrange(1, 5))])
        page = H.parse(f"<html>{body.source()}</html>")
        H.measure(page)
        share = body.link_chars() / body.chars()
        every = list(body.below())
        assert [n.tag for n in page.nodes[2:]] == [t.tag for t in every]
        for n, t in zip(page.nodes[2:], every, strict=True):
            assert n.density == pytest.approx(t.density(share)) and n.total == pytest.approx(t.total(share))
        open_ = [t for t in every if t.chars() and 2 * t.link_chars() <= t.chars()]
        path, thresholds = H.choose(page)
        if open_:
            assert page.nodes[path[0]].total == pytest.approx(max(t.total(share) for t in open_))
            mine = every[path[0] - 2]
            assert thresholds[-1] == pytest.approx(min(t.density(share) for t in every if any(x is mine for x in t.below())))


def paragraphs(name, n=3, words=60):
    return "".join(f"<p>{name}{k} {'word ' * words}</p>" for k in range(n))


def test_density_decides_where_names_say_nothing():
    menu = "<div>" + "".join(f"<div><a href=/{k}>Entry {k} of the menu</a></div>" for k in range(30)) + "</div>"
    text = H.main_text(f"<body><div>{menu}<div>Free today only.</div><div><h1>Title</h1>{paragraphs('part')}</div><div>All rights with us</div></div></body>")
    assert text.startswith("Title part0") and "part2" in text and not any(x in text for x in ("menu", "Free", "rights"))
    # the same words as links lose, as text they win
    words = [f"words of the entry number {k}" for k in range(8)]
    linked, plain = "".join(f"<p><a href=x>{w}</a></p>" for w in words), "".join(f"<p>{w}</p>" for w in words)
    other = "<p>some other text that is not long</p>"
    assert "entry" not in H.main_text(f"<body><div>{linked}</div><div>{other}</div></body>")
    assert "entry" in H.main_text(f"<body><div>{plain}</div><div>{other}</div></body>")
    # a list of links in an article goes, a list of text stays
    text = H.main_text(f"<body><article>{paragraphs('part')}<ul><li><a href=x>See here</a><li><a href=x>See there</a></ul><ul><li>One thing<li>Another thing</ul></article></body>")
    assert "See" not in text and text.endswith("One thing Another thing")


def test_an_article_in_several_parts():
    inner = f"<div>{paragraphs('one')}</div><div>{paragraphs('two', 2)}</div><p>Tail.</p>"
    for page in (f"<body><div>{inner}</div></body>", f"<body>{inner}<div>Copyright</div></body>", "<div><div>part one</div><div>part two</div><p>Tail.</p></div>"):
        text = H.main_text(page)
        assert "one" in text and "two" in text and text.endswith("Tail.")


@pytest.mark.parametrize("wrap", [
    '<div class="content no-sidebar">{}</div>', '<div id="page" class="site has-sidebar">{}</div>', '<div class="post-share-enabled">{}</div>', '<div class="main widget-free">{}</div>',
    '<main><section class="related-work">{}</section></main>', "<form>{}</form>", '<div class="sidebar">{}</div>', '<div class="comments">{}</div>', '<div class="elementor-widget">{}</div>', '<section class="discussion">{}</section>',
])
def test_no_name_loses_the_whole_text(wrap):
    text = H.main_text("<body><nav><a href=x>Home</a></nav>" + wrap.format("<h1>Title</h1>" + paragraphs("part")) + "<footer>Foot</footer></body>")
    assert text.startswith("Title part0") and "part2" in text and "Home" not in text and "Foot" not in text


def test_named_blocks_beside_the_text_go():
    for name in ("ad-slot", "cookie-notice", "sidebar", "comments", "newsletterBox"):
        box = f'<div class="{name}">{paragraphs("box", 1, 20)}</div>'
        for page in (f"<body><article><h1>Title</h1>{paragraphs('part')}{box}</article></body>", f"<body><div><h1>Title</h1>{paragraphs('part')}</div>{box}</body>"):
            text = H.main_text(page)
            assert text.startswith("Title part0") and "part2" in text and "box" not in text, name


def test_malformed_pages():
    assert H.main_text("<p>One <b>two</i> three<p>four</div> five") == "One two three four five"
    assert H.main_text('<p class="x>One</p><p>two') == "One two"
    assert H.main_text("<p>a < b and c <3 d</p>") == "a < b and c <3 d"
    assert H.main_text("<p>One</p><a href='x") == "One"
    assert H.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert H.main_text("text</ >more<!x>end<?y?>") == "textmoreend"
    assert H.main_text("<p>&amp;&lt;&#228;&nbsp;x&unknown;</p>") == "&<ä x&unknown;"
    assert H.main_text("\0<p>퟿ a b\n\tc") == "\0 ퟿ a b c"


@pytest.mark.parametrize("unit", ["<a", '<a "><a" ', "<b>", "<div>", "</p>", "<div>x</b>", "<!--", "<![CDATA[", "</ ", "<script>", "<li>", "&amp", "<p><button><fieldset>", "<x y='", "<td><h1>"])
def test_time_is_in_proportion_to_the_length(unit):
    began = time.time()
    for close in ("", "'", "</b>"):
        H.main_text("text " + unit * (100_000 // len(unit)) + close)
    assert time.time() - began < 12
