"""Page extraction against a plain recursive form of composite text density, and against hand-labelled pages."""

import math
import random
from html.parser import HTMLParser

import pytest

from slotwise.llm import html_text

PROSE = " ".join(f"This is sentence {i} of a paragraph that says something at a fair length, with a comma in it." for i in range(6))
ONE, TWO, THREE, FOUR = (f"{word} {PROSE}" for word in ("First", "Second", "Third", "Fourth"))


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


class Tree(HTMLParser):
    """Nested lists of [tag, children], strings for text."""

    def __init__(self, page):
        super().__init__()
        self.top = ["#", []]
        self.open = [self.top]
        self.feed(page)

    def handle_starttag(self, tag, attrs):  # noqa: ARG002
        node = [tag, []]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):  # noqa: ARG002
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def counted(node, linked=False):
    """Characters, linked characters, tags and links of a subtree; a block's own tag counts for its parent, as do inline ones."""
    total = [0, 0, 0, 0]
    for child in node[1]:
        if isinstance(child, str):
            n = len("".join(child.split()))
            total[0] += n
            total[1] += n * linked
        else:
            below = counted(child, linked or child[0] == "a")
            total = [x + y for x, y in zip(total, below, strict=True)]
            total[2] += 1
            total[3] += child[0] == "a"
    return total


def plain(page):
    """The text that composite text density selects in a page of divs, paragraphs and links, by definition."""
    body = next(c for c in Tree(page).top[1][0][1] if c[0] == "body")
    chars, linked, *_ = counted(body)
    ratio = linked / max(chars, 1)

    def density(node):
        c, lc, t, lt = counted(node)
        t = max(t, 1)
        scale = math.log(max(c, 1) / max(c - lc, 1) * lc + ratio * c + math.e)
        return c / t * math.log(1 + max(c, 1) / max(lc, 1) * t / max(lt, 1)) / math.log(1 + scale)

    def kids(node):
        return [c for c in node[1] if not isinstance(c, str) and c[0] != "a"]

    def total(node):
        return sum(map(density, kids(node))) if kids(node) else density(node)

    def below(node):
        return [node, *(x for c in kids(node) for x in below(c))]

    def largest(node):
        return max(below(node), key=total)

    up = {id(c): n for n in below(body) for c in kids(n)}
    best = max(below(body)[1:], key=total)
    while id(best) in up and up[id(best)] is not body and density(up[id(best)]) >= density(body):
        best = up[id(best)]
    path = [best]
    while path[-1] is not body:
        path.append(up[id(path[-1])])
    threshold = min(map(density, path))

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node[1])

    def inside(node, start):
        if start[1] is not node[1] and node[0] == "div":
            c, lc, _, lt = counted(node)
            s = counted(start)
            if 5 * s[1] < 4 * s[0] and lt > 1 and 5 * lc >= 4 * c and density(node) < threshold:
                return []
        if not kids(node):
            return [" ".join(text(node).split())]
        return [x for c in kids(node) for x in inside(c, start)]

    def walk(node, marked):
        if node is best:
            return inside(node, node)
        if not any(node is n for n in path) and not any(node is n for n in marked):
            c, lc, *_ = counted(node)
            if density(node) < threshold or 2 * lc >= c:
                return []
            marked = [*marked, largest(node)]
        if any(node is n for n in marked):
            return inside(node, node)
        return [x for c in kids(node) for x in walk(c, marked)]

    return " ".join(x for x in walk(body, []) if x)


def made(rng, depth):
    """A div of divs, or of paragraphs with some links."""
    if depth and rng.random() < 0.7:
        return f"<div>{''.join(made(rng, depth - 1) for _ in range(rng.randint(1, 3)))}</div>"
    out = []
    for _ in range(rng.randint(1, 4)):
        words = [f"w{rng.randint(0, 999)}" for _ in range(rng.choice([2, 5, 40, 120]))]
        k = rng.choice([0, 0, 0, 1, len(words)])
        out.append(f"<p>{' '.join(f'<a>{w}</a>' if i < k else w for i, w in enumerate(words))}</p>")
    return f"<div>{''.join(out)}</div>"


@pytest.mark.parametrize("seed", range(300))
def test_density_against_its_definition(seed):
    rng = random.Random(seed)
    page = f"<html><body>{''.join(made(rng, 3) for _ in range(rng.randint(1, 4)))}</body></html>"
    assert html_text.main_text(page) == plain(page)


def test_blocks_beside_the_densest_stay():
    page = f"<body><div class=a>{p(ONE, TWO)}</div><div class=b>{p(THREE)}</div><div class=c>{p(FOUR)}</div><div class=d><a href=/>Imprint</a></div></body>"
    assert html_text.main_text(page) == " ".join((ONE, TWO, THREE, FOUR))


@pytest.mark.parametrize(
    "part",
    [
        f'<section id="discussion">{p(THREE)}</section>', f'<div class="related-work">{p(THREE)}</div>', f'<div class="share-price-form">{p(THREE)}</div>',
        f'<p class="notice-period">{THREE}</p>', f'<div class="article-header"><h2>{THREE}</h2></div>', f'<div class="menu-of-the-week">{p(THREE)}</div>',
    ],
)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_names_with_words_of_their_own_take_out_no_prose(part, around):
    page = f"<body><div class=sidebar><a href=/>Home</a></div><{around}>{p(ONE)}{part}{p(TWO)}</{around}></body>"
    assert html_text.main_text(page) == " ".join((ONE, THREE, TWO))


@pytest.mark.parametrize("name", ["td-sidebar", "site-footer", "cookie-banner", "comments-area", "related-posts", "mw-nav", "share-buttons", "post-comments", "newsletter signup", "ad-slot-2", "adBox", "reader-comments", "social-links"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_whole_names_take_out_prose(name, around):
    page = f"<body><{around}>{p(ONE)}<div class='{name}'><p>Not of the article.</p></div>{p(TWO)}</{around}></body>"
    assert html_text.main_text(page) == f"{ONE} {TWO}"


@pytest.mark.parametrize("rail", ['<div class="z"><a>link one</a> <a>link two three</a></div>', '<div class="q1"><ul><li><a>one</a></li><li><a>two</a></li></ul></div>', "<ul><li><a>one</a></li><li><a>two</a></li></ul>", '<div class="related-reading-tips"><a>one</a></div>'])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_lists_of_links_within_the_content_go(rail, around):
    page = f"<body><{around}>{p(ONE)}{rail}{p(TWO)}</{around}></body>"
    assert html_text.main_text(page) == f"{ONE} {TWO}"


def test_links_that_belong_to_the_text_stay():
    cited = "<ol><li><a>A work</a>, by someone, of a year, with pages and a note</li><li><a>Another</a>, by others, likewise long enough</li></ol>"
    page = f"<body><div><h1><a>Title</a></h1>{p(ONE)}<p><a>All of this</a> <a>paragraph is linked</a></p>{cited}<ul><li><a>x</a></li></ul></div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title First") and "All of this paragraph is linked" in got and "Another, by others" in got and got.endswith(" x")
    links = f"<body><div>{'<p><a>One link of a page of links</a></p>' * 9}</div></body>"
    assert html_text.main_text(links).count("One link") == 9


def test_text_around_what_goes_is_not_joined():
    page = f"<body><article>{p(ONE)}before<div class=ad>Buy</div>after</article></body>"
    assert html_text.main_text(page) == f"{ONE} before after"


#: Pages with the text that a reader would call the article.
LABELLED = [
    (f"<body><div id=top><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div id=story><h1>Head</h1>{p(ONE, TWO)}</div><div id=low>Copyright</div></body>", f"Head {ONE} {TWO}"),
    (f"<body><table><tr><td><a>Home</a> <a>News</a></td><td>{p(ONE, TWO)}</td></tr></table></body>", f"{ONE} {TWO}"),
    (f"<body><div><div>{p(ONE)}</div><div>{p(TWO)}</div></div><div><a>x</a><a>y</a></div></body>", f"{ONE} {TWO}"),
    (f"<body><header><h2>Site</h2></header><main><h1>Head</h1>{p(ONE)}<blockquote>{TWO}</blockquote></main><footer>{THREE}</footer></body>", f"Head {ONE} {TWO}"),
    (f"<body><div class=post><h1>Head</h1><div class=post-body>{p(ONE, TWO)}</div></div><div class=comments>{p(THREE, FOUR)}</div></body>", f"Head {ONE} {TWO}"),
    (f"<body><div class=wrap><div class=sidebar>{p(FOUR)}</div><div class=content>{p(ONE)}<pre>{TWO}</pre></div></div></body>", f"{ONE} {TWO}"),
    (f"<body><p>{ONE}</p><p>{TWO}</p><div class=newsletter-signup><p>Get our letters.</p></div></body>", f"{ONE} {TWO}"),
    (f"<body><article><h1>Head</h1>{p(ONE)}<div class='share-buttons'><a>f</a><a>t</a></div>{p(TWO)}</article><div class=related-posts>{p(THREE)}</div></body>", f"Head {ONE} {TWO}"),
]


@pytest.mark.parametrize("k", range(len(LABELLED)))
def test_labelled_pages(k):
    page, wanted = LABELLED[k]
    assert html_text.main_text(page) == wanted
