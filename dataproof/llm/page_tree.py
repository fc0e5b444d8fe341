"""Block trees of web pages: a tolerant reader, folded skeletons, and simple tree matching.

Only block elements become nodes; inline elements belong to the text of their block. A run of text between block
boundaries is a leaf. Elements that can only be page furniture by their name, role or class become nodes without text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element names of HTML and words that sites use in class names and ids.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
FURNITURE = set("aside dialog footer form menu nav".split())
MUTE = set("applet audio button canvas datalist map meter object output progress select svg template video".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words for parts around an article, which may wrongly name a frame that holds it.
AROUND = set("aside banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation sidebar toolbar topbar widget".split())
#: Words for parts that no article lies in.
APART = set(
    "ad ads advert advertisement adverts comment comments consent cookie cookies copyright disqus gdpr login modal newsletter notice"
    " pager pagination popup promo promoted promotion recommended related replies reply respond share sharing signup skip social"
    " sponsor sponsored subscribe subscription teaser".split()
)
#: With one of these, a class tells of the state of a frame.
STATES = set("has is no not with without".split())
#: What an open element of the first name ends at when another of its kind starts, and what it does not look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Deeper elements belong to their ancestor at this depth; their texts are blocks all the same.
DEPTH = 48

_TAIL = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+(?:>|\Z)"""
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)"
    rf"|<(?P<raw>script|style|title|textarea|iframe|noembed|noframes|noscript|xmp)(?=[\s/>]){_TAIL}(?:.*?</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|.*+)"
    rf"|<(?P<open>[a-z][^\s/>]*+)(?P<tail>{_TAIL})"
    r"|</(?P<close>[a-z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An element: its label, child nodes and leaves in page order, and what was known when it was opened."""

    name: str
    label: str
    depth: int
    level: int = 0
    dropped: str = ""
    headings_only: bool = False
    children: list = field(default_factory=list)


@dataclass
class Leaf:
    """A block of text; ``level`` is 2 inside an article, 1 inside the main part, else 0; ``links`` are code points in links;
    ``place`` counts the blocks of the page."""

    text: str
    links: int
    level: int
    place: int


def _named(tail: str) -> tuple[str, set[str], str]:
    """The class names without digits, the words in class names and ids, and the role of a start tag."""
    if "=" not in tail:
        return "", set(), ""
    label, words, role = [], set(), ""
    for key, *values in _ATTRIBUTE.findall(tail):
        value = unescape("".join(values))
        if key.lower() == "role":
            role = value.strip().lower()
            continue
        for name in value.split():
            parts = {x.lower() for x in _WORDS.findall(name)}
            if key.lower() == "class":
                label.append("-".join(x.lower() for x in _WORDS.findall(name)))
            if not parts & STATES:
                words |= parts
    return ".".join(sorted(set(filter(None, label)))), words, role


def _why_dropped(name: str, words: set[str], role: str) -> str:
    """``apart``, ``around``, or nothing for an element that may hold content."""
    if name in ("html", "body", "main") or role in ("main", "article"):
        return ""
    if name in FURNITURE or role in ROLES:
        return "apart"
    if words & APART:
        return "apart"
    return "around" if name == "header" or (words & AROUND and name != "article") else ""


def read_page(html: str) -> Node:
    """The block tree of a page. Never fails: what is not markup is text, and what is left open ends with the page."""
    root = Node("html", "html", 0)
    stack, run, mute = [root], [], []
    links = in_link = blocks = 0

    def flush() -> None:
        nonlocal links, blocks
        if run:
            text = " ".join(unescape("".join(run)).split())
            top = stack[-1]
            if text and (not top.headings_only or top.name in HEADINGS):
                top.children.append(Leaf(text, min(links, len(text)), top.level, blocks))
                blocks += 1
            run.clear()
        links = 0

    def pop_to(place: int) -> None:
        flush()
        del stack[place:]
        while mute and mute[-1][1] > place:
            mute.pop()

    for token in _TOKEN.finditer(html):
        kind = token.lastgroup
        if kind == "text":
            if not mute and not stack[-1].dropped:
                run.append(token["text"])
                if in_link:
                    links += len(token["text"].strip())
        elif kind == "tail":
            name = token["open"].lower()
            if name == "br" or name == "wbr":
                run.append(" " if name == "br" else "")
                continue
            if name not in BLOCKS:
                if name == "a":
                    in_link = 1
                if name in VOID or token["tail"].endswith("/>"):
                    continue
                if any(name == known for known, _ in mute):
                    mute.append((name, len(stack)))
                elif not mute and (name in MUTE or ("=" in token["tail"] and _named(token["tail"])[1] & APART)):
                    mute.append((name, len(stack)))
                continue
            if name in ("html", "body"):
                continue
            if mute:
                # Blocks inside of a button or the like end nothing outside of it.
                mute.append((name, len(stack)))
                continue
            flush()
            if stack[-1].name == "p" or (name in HEADINGS and stack[-1].name in HEADINGS):
                pop_to(len(stack) - 1)
            if name in CLOSES:
                ends, beyond = CLOSES[name]
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].name in ends:
                        pop_to(place)
                        break
                    if stack[place].name in beyond:
                        break
            if name == "hr":
                continue
            top = stack[-1]
            label, words, role = _named(token["tail"])
            why = _why_dropped(name, words, role)
            level = 2 if name == "article" or role == "article" else 1 if name == "main" or role == "main" else 0
            if level and not why and top.dropped == "around":
                # A frame that is named after a part around the article is none.
                first = next(i for i, node in enumerate(stack) if node.dropped)
                stack[first].label = stack[first].label.removesuffix("!")
                for i in range(first, len(stack)):
                    stack[i].dropped = ""
                    if i > first:
                        stack[i - 1].children.append(stack[i])
            node = Node(name, f"{name}.{label}" if label else name, top.depth + 1, max(level, top.level))
            node.headings_only = top.headings_only
            if why == "around" and top.level:
                node.headings_only, why = True, ""
            node.dropped = "apart" if "apart" in (top.dropped, why) else top.dropped or why
            if not top.dropped and top.depth < DEPTH:
                if node.dropped:
                    node.label += "!"
                top.children.append(node)
            elif not node.dropped:
                # Too deep for a node of its own: its texts go to the ancestor.
                node.children, node.depth = top.children, top.depth
            stack.append(node)
        elif kind == "close":
            name = token["close"].lower()
            if name == "a":
                in_link = 0
            if any(name == known for known, _ in mute):
                while mute.pop()[0] != name:
                    pass
            elif name in BLOCKS:
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].name == name:
                        pop_to(place)
                        break
                else:
                    flush()
    flush()
    return root


def fold(node: Node) -> tuple[str, list[list[Leaf]]]:
    """The skeleton of a tree and, for each of its leaves, the texts that stand there.

    Children of one shape are one child of the skeleton, however many there are and whatever stands between them.
    """
    shapes: dict[str, list[list[Leaf]]] = {}
    for child in node.children:
        shape, places = ("#", [[child]]) if isinstance(child, Leaf) else fold(child)
        if shape not in shapes:
            shapes[shape] = places
        else:
            for known, new in zip(shapes[shape], places):
                known.extend(new)
    return f"{node.label}({' '.join(shapes)})", [place for places in shapes.values() for place in places]


@dataclass
class Shape:
    """A node of a skeleton or of several aligned ones: how many pages have it, and its number in page order."""

    label: str
    pages: int
    children: list = field(default_factory=list)
    number: int = -1


_PART = re.compile(r"[()]|[^\s():]+(?::\d+)?")


def read_shape(text: str, pages: int) -> Shape:
    """The tree of a skeleton; nodes that state no number of pages have ``pages``. Leaves are numbered in page order."""
    top = Shape("", pages)
    stack, last, number = [top], top, 0
    for part in _PART.findall(text):
        if part == "(":
            stack.append(last)
        elif part == ")":
            stack.pop()
        else:
            label, _, count = part.partition(":")
            last = Shape(label, int(count) if count else pages)
            if label == "#":
                last.number, number = number, number + 1
            stack[-1].children.append(last)
    return top.children[0]


def write_shape(shape: Shape) -> str:
    own = f"{shape.label}:{shape.pages}"
    return own if shape.label == "#" else f"{own}({' '.join(map(write_shape, shape.children))})"


def match(left: Shape, right: Shape) -> tuple[int, list]:
    """Simple tree matching of two nodes with one label: how many nodes match, and the matched pairs of children
    in order, each with its own matched pairs."""
    rows, columns = left.children, right.children
    best = [[0] * (len(columns) + 1)]
    found = {}
    for i, a in enumerate(rows):
        above, line = best[-1], [0]
        for j, b in enumerate(columns):
            value = max(above[j + 1], line[j])
            if a.label == b.label:
                found[i, j] = match(a, b)
                value = max(value, above[j] + found[i, j][0])
            line.append(value)
        best.append(line)
    pairs, i, j = [], len(rows), len(columns)
    while i and j:
        if (i - 1, j - 1) in found and best[i][j] == best[i - 1][j - 1] + found[i - 1, j - 1][0]:
            i, j = i - 1, j - 1
            pairs.append((i, j, found[i, j][1]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], pairs[::-1]


def align_into(seed: Shape, tree: Shape, pairs: list | None = None) -> None:
    """Partial tree alignment: what ``tree`` has beyond ``seed`` is inserted behind its last matched neighbour."""
    if pairs is None:
        pairs = match(seed, tree)[1]
    seed.pages += tree.pages
    partner = {j: (i, deeper) for i, j, deeper in pairs}
    grown, taken = [], 0
    for j, child in enumerate(tree.children):
        if j in partner:
            i, deeper = partner[j]
            grown.extend(seed.children[taken : i + 1])
            taken = i + 1
            align_into(seed.children[i], child, deeper)
        else:
            grown.append(child)
    seed.children = grown + seed.children[taken:]


def prune(seed: Shape, least: float) -> None:
    """Without the nodes that fewer than ``least`` pages have."""
    seed.children = [child for child in seed.children if child.pages >= least]
    for child in seed.children:
        prune(child, least)


def places(seed: Shape, tree: Shape) -> list[int]:
    """For each leaf of ``tree``, the number of the leaf of ``seed`` that it is aligned with, or -1."""
    leaves = _count(tree)
    out = [-1] * leaves

    def go(a: Shape, b: Shape, pairs: list) -> None:
        for i, j, deeper in pairs:
            if b.children[j].label == "#":
                out[b.children[j].number] = a.children[i].number
            go(a.children[i], b.children[j], deeper)

    go(seed, tree, match(seed, tree)[1])
    return out


def _count(shape: Shape) -> int:
    return (shape.label == "#") + sum(map(_count, shape.children))
