"""Main text of web pages by a graphical model on the tree of their blocks."""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of

# Elements by how they take part in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style noscript template iframe svg textarea title object select canvas math head".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(r"""<!--(?:-?>|.*?--!?>|.*)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^>]*+>)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Of RAW, those whose inside is text up to their own end, or the page's; the others nest, and one without an end is but a tag.
PLAIN = frozenset("script style textarea title iframe noscript".split())
_RAW_TAG = {name: re.compile(rf"""<(/?){name}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""" if name not in PLAIN else rf"<(/){name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}

# Stems of names that sites give to blocks, by what the blocks hold.
NAMES = {
    "content": "article content post entry story main text body page-text prose",
    "menu": "nav menu breadcrumb tabs pager pagination toc",
    "header": "header masthead topbar branding logo hero-bar",
    "footer": "footer copyright legal colophon imprint",
    "side": "side aside widget related recommend popular trending more-from rail",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner dfp adsense",
    "notice": "cookie notice consent gdpr alert popup modal overlay disclaimer paywall",
    "comment": "comment comments reply respond disqus discussion reviews",
    "form": "form subscribe newsletter login search signup poll",
    "share": "share social follow tags metadata byline toolbar",
}
_NAMES = {kind: frozenset(words.split()) for kind, words in NAMES.items()}
_GROUPS = {t: g for g, ts in {
    "article": "article main", "box": "div section center", "p": "p blockquote pre", "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd menu", "nav": "nav", "header": "header hgroup", "footer": "footer",
    "aside": "aside", "form": "form fieldset button legend input", "table": "table tbody thead tr td th caption", "figure": "figure figcaption", "root": "html body #page", "dialog": "dialog", "details": "details summary",
}.items() for t in ts.split()}
FEATURES = ["bias", *(f"tag {g}" for g in [*dict.fromkeys(_GROUPS.values()), "other"]), *(f"name {k}" for k in NAMES), "links", "much text", "sentences", "few words"]
_AT = {name: k for k, name in enumerate(FEATURES)}


@dataclass
class Node:
    tag: str
    names: str = ""
    parent: int = -1
    #: Its own pieces of text, in page order: (number in the page, text).
    text: list = field(default_factory=list)
    letters: int = 0
    linked: int = 0
    marks: int = 0


def parse(page: str) -> list[Node]:
    """The blocks of a page, parents before children; [0] is the page itself.

    Inline elements belong to their block, and a line break within one is white space. An open p ends where another block
    begins, an open li at the next, and a closing tag ends what is open inside it; one without a start is nothing. Comments,
    scripts, styles and the like, and a tag that the page's end cuts off, are markup. Blocks may nest as deep as they like:
    the places of open elements are kept by name, so that closing one takes the time of what it closes.
    """
    nodes, stack, text, links = [Node("#page")], [0], [], 0
    opened: dict[str, list[int]] = {}
    number = at = 0

    def flush() -> None:
        nonlocal number, text
        if text:
            joined = _SPACE.sub(" ", references.unescape("".join(text))).strip()
            text = []
            if joined:
                node = nodes[stack[-1]]
                node.text.append((number, joined))
                node.letters += len(joined)
                node.marks += joined.count(". ") + joined.count(", ") + joined.endswith((".", "!", "?"))
                number += 1

    def deepest(names: tuple[str, ...]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def close(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        depth = deepest(names)
        if depth and depth >= deepest(stop):
            flush()
            for k in stack[depth:]:
                opened[nodes[k].tag].pop()
            del stack[depth:]

    ends: dict[str, dict[int, int]] = {}

    def skipped(name: str, less: int, at: int) -> int:
        """Where an element of RAW whose tag spans less to at ends."""
        if name in PLAIN:
            found = _RAW_TAG[name].search(page, at)
            return found.end() if found else size
        if name not in ends:  # all of them are matched once
            ends[name], starts = {}, []
            for m in _RAW_TAG[name].finditer(page, less):
                if not m[1]:
                    starts += [] if m[0].endswith("/>") else [m.start()]
                elif starts:
                    ends[name][starts.pop()] = m.end()
        return ends[name].get(less, at)

    size = len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            less = size
        if less > at:
            piece = page[at:less]
            text.append(piece)
            if links:
                nodes[stack[-1]].linked += len(piece.strip())
        if less == size:
            break
        m = _TAG.match(page, less)
        if not m:
            if less + 1 < size and (page[less + 1].isascii() and page[less + 1].isalpha() or page[less + 1] == "/"):
                break  # a tag that never ends
            text.append("<")
            at = less + 1
            continue
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                text.append(" ")
            elif name not in INLINE:
                close((name,))
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            elif name == "br":
                text.append(" ")
            continue
        if name in RAW and name != "head":
            at = skipped(name, less, at)
            continue
        if name == "head":
            continue
        flush()
        links = 0
        if name in ENDS_P:
            close(("p",), ("td", "th", "button"))
        if name in SIBLINGS:
            close(SIBLINGS[name], ("ul", "ol", "dl", "table"))
        if name in VOID:
            continue
        attrs = m["attrs"] or ""
        names = " ".join(next(v for v in x[1:] if v or v == x[3]) for x in _ATTR.findall(attrs)) if "=" in attrs else ""
        nodes.append(Node(name, names.lower(), stack[-1]))
        opened.setdefault(name, []).append(len(stack))
        stack.append(len(nodes) - 1)
    flush()
    return nodes


def named(names: str) -> list[str]:
    """The kinds of NAMES that a block's class, id and role speak of: by whole parts, and by stems of five letters and more."""
    parts = set(re.split(r"[^a-z]+", names)) - {""}
    return [kind for kind, words in _NAMES.items() if parts & words or any(len(w) > 4 and p.startswith(w) for p in parts for w in words)]


def totals(nodes: list[Node]) -> tuple[list[int], list[int], list[int]]:
    """Letters, linked letters and sentence marks of each block with all below it."""
    letters, linked, marks = ([getattr(n, k) for n in nodes] for k in ("letters", "linked", "marks"))
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        letters[up] += letters[k]
        linked[up] += linked[k]
        marks[up] += marks[k]
    return letters, linked, marks


def shape(letters: int, linked: int, marks: int) -> list[float]:
    return [min(1.0, linked / letters) if letters else 0.0, min(1.0, letters / 1000), min(1.0, 100 * marks / (letters + 1)), float(letters < 25)]


def vector(node: Node, letters: int, linked: int, marks: int) -> np.ndarray:
    x = np.zeros(len(FEATURES))
    x[0] = 1
    x[_AT[f"tag {_GROUPS.get(node.tag, 'other')}"]] = 1
    for kind in named(node.names):
        x[_AT[f"name {kind}"]] = 1
    x[-4:] = shape(letters, linked, marks)
    return x


#: Blocks that hold what their parent is about, unless their names say otherwise.
FLOW = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption details summary".split())


def tie(node: Node) -> int:
    """Which potentials tie a block to its parent: 1 for one of FLOW without names or a div with text of its own, 0 for a box."""
    return int(not node.names and (node.tag in FLOW or node.tag == "div" and bool(node.text)))


@dataclass
class Tree:
    """Potentials: weights of a block's own features, and the log potentials [tie][parent label][child label]; 1 is content."""

    weights: np.ndarray
    pair: list[list[list[float]]]
    _seen: dict = field(default_factory=dict, repr=False)

    def own(self, node: Node, letters: int, linked: int, marks: int) -> float:
        """Log odds of content by the block's own features; the part of tag and names is remembered."""
        key = (node.tag, node.names)
        if key not in self._seen:
            if len(self._seen) > 20_000:
                self._seen.clear()
            self._seen[key] = float(vector(node, 0, 0, 0)[:-4] @ self.weights[:-4])
        return self._seen[key] + sum(w * v for w, v in zip(self.weights[-4:].tolist(), shape(letters, linked, marks)))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The chance that each block is content: sum-product messages up the tree, then down. Exact, as it is a tree."""
        n = len(nodes)
        ties = [self.pair[tie(x)] for x in nodes]
        own = list(map(self.own, nodes, *totals(nodes)))
        belief, up = own[:], [0.0] * n  # log odds; messages to the parent as log odds

        def both(z: float, to0: float, to1: float) -> float:
            """log(exp(to0) + exp(to1 + z)), safe for large numbers."""
            a, b = to0, to1 + z
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        for k in range(n - 1, 0, -1):
            (p00, p01), (p10, p11) = ties[k]
            up[k] = both(belief[k], p10, p11) - both(belief[k], p00, p01)
            belief[nodes[k].parent] += up[k]
        for k in range(1, n):
            (p00, p01), (p10, p11) = ties[k]
            rest = belief[nodes[k].parent] - up[k]
            belief[k] += both(rest, p01, p11) - both(rest, p00, p10)
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, z)))) for z in belief]


def labelled_page(rng: random.Random) -> tuple[str, set[int]]:
    """A page of invented words in one of many layouts, and the numbers of its pieces of text that are content."""
    word = lambda: "".join(rng.choice("ka lo mi ren tas vu del por sin bra".split()) for _ in range(rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 16).capitalize() + rng.choice([".", ".", ".", "?", ", " + words(3, 8) + "."])
    # Some articles are lists of words, or a word: what tags and names say must outweigh how their text looks.
    plain, long = rng.random() < 0.4, rng.choice([1, 1, 2, 8, 30])
    flow = lambda: " ".join(words(1, 12) if plain else sentence() for _ in range(rng.choice([1, 1, 2, 4, 8][: 1 + long])))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    out, content, count = [], set(), [0]

    def say(tag: str, inner: str, is_content: bool, attrs: str = "") -> None:
        if is_content:
            content.add(count[0])
        count[0] += 1
        out.append(f"<{tag}{attrs}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"))

    def box(tags: str, kind: str | None, fill, share: float = 0.8) -> None:
        tag = rng.choice(tags.split())
        name = rng.choice(NAMES[kind].split()) if kind and (tag in ("div", "section", "ul") or rng.random() < share) else ""
        attr = f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-" + word(), " " + word()])}"' if name else ""
        out.append(f"<{tag}{attr}>")
        fill()
        out.append(f"</{tag}>")

    def menu() -> None:
        out.append("<ul>")
        for _ in range(rng.randint(2, 7)):
            say("li", link(), False)
        out.append("</ul>")

    def some(n: int, linked: float = 0.2) -> None:
        for _ in range(rng.randint(1, n)):
            say(rng.choice(["p", "div", "p", "h4"]), link() if rng.random() < linked else flow(), False)

    def fields() -> None:
        say("p", words(1, 6), False)
        out.append('<input type="text"><button>')
        out.append("</button>")

    def comments() -> None:
        for _ in range(rng.randint(1, 4)):
            box("div li article section", "comment", lambda: some(2, 0.1), 1.0)

    junk = [lambda: box("nav div", "menu", menu), lambda: box("div aside", "advert", lambda: some(1), 1.0), lambda: box("aside div section", "side", lambda: (some(2, 0.6), menu())), lambda: box("div section dialog", "notice", lambda: some(1), 1.0), lambda: box("form div", "form", fields), lambda: box("div ul", "share", menu, 1.0), lambda: box("section div", "comment", comments, 1.0)]

    def article() -> None:
        if rng.random() < 0.8:
            say(rng.choice(["h1", "h2"]), words(3, 9), True)
        for _ in range(rng.randint(1, long)):
            r = rng.random()
            if r < 0.7:
                say("p", flow(), True)
            elif r < 0.76:
                say(rng.choice(["h2", "h3"]), words(1, 5), True)
            elif r < 0.82:
                out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    say("li", flow(), True)
                out.append("</ul>")
            elif r < 0.845:
                out.append("<blockquote>")
                say("p", flow(), True)
                out.append("</blockquote>")
            elif r < 0.87:
                around = rng.choice(["", "", "div", "figure"])
                out.append(f"<{around}><table><tr>" if around else "<table><tr>")
                for _ in range(rng.randint(2, 5)):
                    say(rng.choice(["td", "td", "th"]), words(1, 4), True)
                out.append("</tr></table>" + (f"</{around}>" if around else ""))
            elif r < 0.89:
                around = rng.choice(["div", "section"])
                out.append(f"<{around}>")
                say(rng.choice(["p", "p", "h3", "div"]), flow(), True)
                out.append(f"</{around}>")
            elif r < 0.91:
                say("div", words(1, 3) if rng.random() < 0.5 else flow(), True)
            elif r < 0.925:
                out.append("<details>")
                say("summary", words(1, 5), True)
                say(rng.choice(["p", "div"]), flow(), True)
                out.append("</details>")
            elif r < 0.94:
                out.append("<dl>")
                say("dt", words(1, 3), True)
                say("dd", flow(), True)
                out.append("</dl>")
            elif r < 0.95:
                out.append("<figure><img>")
                say("figcaption", words(2, 8), True)
                out.append("</figure>")
            elif r < 0.96:
                say("pre", words(2, 20), True)
            else:
                rng.choice(junk)()
        for _ in range(rng.choice([0, 0, 0, 1, 2])):  # comments, forms and the like often close an article
            rng.choice(junk)()

    say_footer = lambda: say("p", "&copy; " + words(2, 9) + rng.choice(["", ". " + sentence()]), False)
    out.append("<html><body>")
    if rng.random() < 0.7:
        box("header div", "header", lambda: (say("p", words(1, 4), False), menu()))
    for _ in range(rng.randint(1, 3)):
        rng.choice(junk[:6])()
    wrap = rng.random() < 0.4
    if wrap:
        out.append(f"<div{rng.choice(['', ' class=wrap', ' id=page'])}>")
    r = rng.random()
    if r < 0.55:
        box("article article main", "content", article, 0.4)
    else:
        box("div section", "content", article, 1.0)
    if wrap:
        out.append("</div>")
    for _ in range(rng.randint(0, 3)):
        rng.choice(junk)()
    box("footer div", "footer", say_footer)
    out.append("</body></html>")
    return "".join(out), content


def labels_of(nodes: list[Node], content: set[int]) -> list[int]:
    """A block is content where its own text is. A box is where it lies in the innermost box that holds all content, or is it,
    and holds some."""
    inside = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        inside[k] += sum(number in content for number, _ in nodes[k].text)
        if k:
            inside[nodes[k].parent] += inside[k]
    if not inside[0]:
        return [0] * len(nodes)
    root = max(k for k in range(len(nodes)) if inside[k] == inside[0])
    while root and nodes[root].tag in FLOW:
        root = nodes[root].parent
    within, out = [False] * len(nodes), []
    for k, n in enumerate(nodes):
        within[k] = k == root or (k > 0 and within[n.parent])
        out.append(int(within[k] and inside[k] > 0 and not (n.text and n.text[0][0] not in content)))
    return out


def train(pages: list[tuple[str, set[int]]] | None = None, size: int = 1000, steps: int = 400, seed: int = 23) -> Tree:
    """Trains on labelled pages (html, numbers of the pieces of text that are content); without any, on `size` made ones.

    Pair potentials are the smoothed log ratios of label pairs to independent labels; own weights are then fitted by the
    gradient of the pages' likelihood with those potentials: labels minus marginals of the tree.
    """
    rng = random.Random(seed)
    pages = pages or [labelled_page(rng) for _ in range(size)]
    trees = [(nodes := parse(page), labels_of(nodes, content)) for page, content in pages]
    count = np.full((2, 2, 2), 1.0)
    for nodes, y in trees:
        for k in range(1, len(nodes)):
            count[tie(nodes[k]), y[nodes[k].parent], y[k]] += 1
    joint = count / count.sum((1, 2), keepdims=True)
    pair = np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))
    x = np.concatenate([[vector(n, *t) for n, *t in zip(nodes, *totals(nodes))] for nodes, _ in trees])
    y = np.concatenate([y for _, y in trees]).astype(float)
    tree = Tree(np.zeros(len(FEATURES)), pair.tolist())
    first = np.cumsum([0, *(len(nodes) for nodes, _ in trees)])
    up = np.concatenate([[n.parent + at if n.parent >= 0 else -1 for n in nodes] for (nodes, _), at in zip(trees, first)])
    depth = np.zeros(len(up), int)
    for k in np.flatnonzero(up >= 0):
        depth[k] = depth[up[k]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    ties = np.concatenate([[tie(n) for n in nodes] for nodes, _ in trees])
    rate, moment = 1.0, np.zeros(len(FEATURES))
    for _ in range(steps):
        p = _forest_marginals(x @ tree.weights, up, levels, pair[ties])
        moment = 0.9 * moment + x.T @ (y - p) / len(x) - 1e-4 * tree.weights
        tree.weights += rate * moment
    tree._seen.clear()
    return tree


def _forest_marginals(own: np.ndarray, up: np.ndarray, levels: list[np.ndarray], pair: np.ndarray) -> np.ndarray:
    """What Tree.marginals gives, for many trees at once, level by level."""
    p00, p01, p10, p11 = pair.reshape(-1, 4).T
    belief, message = own.copy(), np.zeros_like(own)
    for k in reversed(levels):
        message[k] = np.logaddexp(p10[k], p11[k] + belief[k]) - np.logaddexp(p00[k], p01[k] + belief[k])
        np.add.at(belief, up[k], message[k])
    for k in levels:
        rest = belief[up[k]] - message[k]
        belief[k] += np.logaddexp(p01[k], p11[k] + rest) - np.logaddexp(p00[k], p10[k] + rest)
    return 1 / (1 + np.exp(-np.clip(belief, -30, 30)))


def main_text(page: str, tree: Tree) -> str:
    """The pieces of text of blocks that are more likely content than not, in page order, one to a line."""
    nodes = parse(page)
    kept = [x for n, p in zip(nodes, tree.marginals(nodes)) if p > 0.5 for x in n.text]
    return "\n".join(t for _, t in sorted(kept))


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; null html counts as empty, repeated rows are each read, and an empty
    table gives an empty result. Other columns, whatever their names, are left."""
    spread = pages.sparkSession.sparkContext.broadcast(tree or train())

    def rows(c: dict) -> Iterator[tuple]:
        for page, url, html in zip(c["page_id"], c["url"], c["html"]):
            text = main_text(html, spread.value)
            yield page, url, text, len(text)

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html")), rows, "page_id long, url string, text string, n_chars long")
