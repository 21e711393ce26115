"""Main-text extraction by a tree-structured graphical model over DOM nodes.

Block elements and text runs are nodes; inline elements melt into the runs. Each node has a hidden state: content, boilerplate
or mixed (holds both). Parent-child potentials tie a node to its parent, given its tag, class words and links; emission
potentials tie it to its text's size and shape. Sum-product passes upward and downward give exact marginals in two sweeps over the tree; runs whose
content marginal exceeds one half are the text. All potentials are counted from labelled pages (:func:`training_pages`).

Defined cases: null and empty html give an empty text; broken markup is read as far as it goes (open elements end with the
page, stray end tags are ignored); repeated rows are read each; other columns are dropped; an empty table gives an empty
result. Pages have no length limit, nothing is cut, and reading takes time in proportion to a page's length: a tag ends at the
first ``>`` outside quotes, or, where quotes don't close, at the first one.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_texts
from tidewell.llm.tags import TagEnds

#: Fixed values of HTML: elements without an end tag, elements whose inside is no markup, inline elements, and end tags left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object head textarea select title canvas audio video annotation annotation-xml".split())
#: Of these, what stands without an end tag takes the rest of the page; the others are then ordinary open elements.
TO_THE_END = frozenset("script style textarea title".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

#: Words of class, id and role names, and of tags, by what they tell.
HINTS = {
    "menu": "nav navigation menu menubar navbar breadcrumb breadcrumbs tabs pager pagination toc toolbar",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget related recommended complementary popular trending more tags",
    "advert": "ad ads adv advert advertisement adbox adsbygoogle sponsor sponsored promo promotion dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall",
    "comment": "comment comments commentlist disqus reply replies respond discussion feedback",
    "share": "share sharing social follow print byline meta author",
    "form": "form search login register field input button",
    "main": "article content main body post entry story text maincontent articlebody postbody prose",
}
WORD_HINT = {w: k for k, v in HINTS.items() for w in v.split()}
PHRASE = re.compile(r"©|&copy;|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign up\b|\blog ?in\b|\bshare (this|on)\b|\breply\b|\bcomments?\b|\badvertisement\b|\bsponsored\b", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)|<[!?][^>]*+>", re.S)
#: Numeric references that stand for no character; they may have any number of digits.
FAR_REFERENCE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
ZEROS = re.compile(r"(&#[xX]?)0{9,}(?=[0-9a-fA-F])")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {n: re.compile(rf"</{n}\s*>" + (r"|<body[\s>]" if n == "head" else ""), re.I) for n in RAW}
LABEL = re.compile(r"data-label=\"([01])\"")

CONTENT, BOILER, MIXED = 0, 1, 2
TEXT = "#text"
TOP = ("#page", "html", "body")


@dataclass
class Page:
    """Nodes in page order, each behind its parent. ``kind`` is what emissions look at; runs have a text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kind: list[tuple] = field(default_factory=lambda: [("#page", "")])
    text: list[str | None] = field(default_factory=lambda: [None])
    label: list[int | None] = field(default_factory=lambda: [None])


def hint(attributes: str) -> str:
    """The first telling word of the class, id and role names."""
    found = ""
    for m in NAMES.finditer(attributes):
        for w in NAME_WORD.findall(m[1] or m[2] or m[3] or ""):
            kind = WORD_HINT.get(w.lower())
            if kind and kind != "main":
                return kind
            found = found or kind or ""
    return found


def shape(text: str, linked: int) -> tuple:
    """What emissions look at for a run of text."""
    n = text.count(" ") + 1
    size = 0 if n < 4 else 1 if n < 10 else 2 if n < 25 else 3
    links = 0 if not linked else 1 if 2 * linked < len(text) else 2
    return TEXT, size, links, text[-1] in ".!?…。\"”»", size < 3 and PHRASE.search(text) is not None


def decoded(raw: str) -> str:
    """``raw`` with character references decoded."""
    if "&#" in raw:
        raw = FAR_REFERENCE.sub("\ufffd", ZEROS.sub(r"\1", raw))
    return unescape(raw) if "&" in raw else raw


def parse(html: str) -> Page:
    """The tree of block elements and runs; elements without text inside are left out."""
    page = Page()
    open_tags: list[str] = ["#page"]
    opened: Counter = Counter()  # names among them
    path: list[int] = [0]
    pieces: list[str] = []
    links = linked = 0

    def end_run() -> None:
        nonlocal pieces, linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join(decoded(raw).split())
            if text:
                page.parent.append(path[-1])
                page.kind.append(shape(text, linked))
                page.text.append(text)
                page.label.append(None)
            pieces = []
        linked = 0

    def close() -> str:
        path.pop()
        opened[open_tags[-1]] -= 1
        return open_tags.pop()

    at, scan, size, unclosed, ends = 0, TOKEN.search, len(html), set(), TagEnds(html)
    last = html.rfind(">") + 1  # no tag ends behind it
    while at < size:
        m = scan(html, at, last)
        if m is None:
            pieces.append(html[at:])
            break
        start = m.start()
        if start > at:
            pieces.append(html[at:start])
            if links:
                linked += start - at
        at = m.end()
        name = m[2]
        if name is None:  # comment, doctype or instruction
            if html.startswith("<!--", start) and not html.endswith("-->", start, at):
                at = size
            continue
        at = ends.after(at)
        name, inside = name.lower(), html[m.end() : at - 1]
        if name in INLINE or name in MATH:
            if name == "a":
                links = 0 if m[1] else 1
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW and (name not in unclosed or m[1] or inside.endswith("/")):
            if not m[1] and not inside.endswith("/"):
                end = RAW_END[name].search(html, at)
                if name == "head" and end is not None and end[0][1] != "/":
                    at = end.start()
                elif end is not None:
                    at = end.end()
                elif name in TO_THE_END:
                    at = size
                else:
                    unclosed.add(name)
            pieces.append(" ")
            if name not in unclosed or m[1] or inside.endswith("/"):
                continue
        end_run()
        links = 0
        if m[1]:
            if opened[name]:
                while close() != name:
                    pass
            continue
        gone = CLOSES.get(name, CLOSES["p"])
        while open_tags[-1] in gone:
            close()
        page.parent.append(path[-1])
        page.kind.append((name, hint(inside) if inside else ""))
        page.text.append(None)
        page.label.append(int(x[1]) if (x := LABEL.search(inside)) else None)
        if name not in VOID and not inside.endswith("/"):
            open_tags.append(name)
            opened[name] += 1
            path.append(len(page.parent) - 1)
    end_run()
    return prune(page)


def prune(page: Page) -> Page:
    """Leaves out elements without text and tells the others how much of their text is long and how much is links."""
    n = len(page.parent)
    keep = [t is not None for t in page.text]
    keep[0] = True
    size = [len(t) if t else 0 for t in page.text]
    links = [size[i] if page.text[i] and page.kind[i][2] == 2 else 0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        if keep[i]:
            p = page.parent[i]
            keep[p] = True
            size[p] += size[i]
            links[p] += links[i]
    for i in range(n):
        if page.text[i] is None and keep[i]:
            page.kind[i] = (*page.kind[i], 0 if not links[i] else 1 if 2 * links[i] < size[i] else 2, min(4, size[i].bit_length() // 2))
    name, out = {-1: -1}, Page([], [], [], [])
    for i in range(n):
        if keep[i]:
            name[i] = len(out.parent)
            out.parent.append(name[page.parent[i]])
            out.kind.append(page.kind[i])
            out.text.append(page.text[i])
            out.label.append(page.label[i])
    return out


def states(page: Page) -> list[int]:
    """Labels of a training page: a run has its nearest marked ancestor's, an element has its runs' if they agree."""
    n = len(page.parent)
    mark = list(page.label)
    for i in range(1, n):
        mark[i] = mark[page.parent[i]] if mark[i] is None else mark[i]
    kinds: list[set] = [set() for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            kinds[i].add(CONTENT if mark[i] else BOILER)
        if i:
            kinds[page.parent[i]] |= kinds[i]
    return [MIXED if len(k) > 1 else next(iter(k), BOILER) for k in kinds]


class Model:
    """Potentials counted from labelled pages.

    Parent-child potentials depend on the child's tag, telling word and links: counts of these fall back on counts of fewer of
    them, weighted by ``smooth``. Emissions tell how well a state explains a node's text size and shape. Texts of one page look
    alike, so they aren't independent given their states: emissions are raised to ``trust``. What stands above all blocks is
    mixed and not counted.
    """

    def __init__(self, pages: list[str], smooth: float = 0.5, trust: float = 0.1, named: float = 0.5) -> None:
        self.pairs: dict[tuple, Counter] = {}
        self.emit: dict[tuple, Counter] = {}
        self.total: Counter = Counter()
        self.smooth, self.trust, self.named = smooth, trust, named
        for html in pages:
            page = parse(html)
            y = states(page)
            for i, kind in enumerate(page.kind):
                if kind[0] in TOP:
                    continue
                above = y[page.parent[i]]
                for part in self.parts(kind):
                    self.pairs.setdefault((above, part), Counter())[y[i]] += 1
                for k, x in self.shown(kind):
                    self.emit.setdefault((kind[0] == TEXT, k), Counter())[x, y[i]] += 1
                self.total[kind[0] == TEXT, y[i]] += 1
        self.known_pairs: dict[tuple, list] = {}
        self.known: dict[tuple, tuple] = {}

    @staticmethod
    def parts(kind: tuple) -> list[tuple]:
        """What potentials look at, from least to most."""
        if kind[0] == TEXT:
            return [(TEXT,), (TEXT, kind[2]), kind]
        return [("",), kind[:1], kind[:2], kind[:3]]

    @staticmethod
    def shown(kind: tuple) -> list[tuple]:
        return list(enumerate(kind))[1:] if kind[0] == TEXT else [(1, kind[:2]), (3, kind[3])]

    def potential(self, kind: tuple) -> list:
        """For each state of the parent the probabilities of the child's states."""
        got = self.known_pairs.get(kind)
        if got is None:
            options = (CONTENT, BOILER) if kind[0] == TEXT else (CONTENT, BOILER, MIXED)
            got = []
            for above in range(3):
                row = [1 / len(options) if y in options else 0.0 for y in range(3)]
                for k, part in enumerate(self.parts(kind)):
                    seen, weight = self.pairs.get((above, part), Counter()), self.smooth if k else 0.01
                    row = [(seen[y] + weight * row[y]) / (sum(seen.values()) + weight) for y in range(3)]
                got.append(row)
            self.known_pairs[kind] = got
        return got

    def emission(self, kind: tuple) -> tuple:
        """How well each state explains a node's size and, for runs, shape."""
        if kind[0] in TOP:
            return (1e-6, 1e-6, 1.0)
        got = self.known.get(kind)
        if got is None:
            leaf, out = kind[0] == TEXT, []
            for y in range(3):
                p = 1.0
                for k, x in self.shown(kind):
                    seen = self.emit.get((leaf, k), Counter())
                    values = len({v for v, _ in seen}) + 1
                    p *= ((seen[x, y] + self.smooth) / (self.total[leaf, y] + values * self.smooth)) ** (self.trust if leaf or k == 3 else self.named)
                out.append(0.0 if leaf and y == MIXED else p)
            top = max(out)
            got = self.known[kind] = tuple(p / top for p in out)
        return got

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of content: messages to the parents, last node first, then back to the children."""
        parent, n = page.parent, len(page.parent)
        up = [self.emission(k) for k in page.kind]
        pairs = [self.potential(k) for k in page.kind]
        message: list[tuple] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = up[i]
            q, r, s = pairs[i]
            x, y, z = q[0] * a + q[1] * b + q[2] * c, r[0] * a + r[1] * b + r[2] * c, s[0] * a + s[1] * b + s[2] * c
            message[i] = (x, y, z)
            p = parent[i]
            u, v, w = up[p]
            u, v, w = u * x, v * y, w * z
            t = u + v + w
            up[p] = (u / t, v / t, w / t)
        belief: list[tuple] = [(0.0, 0.0, 0.0)] * n
        belief[0] = up[0]
        out = [0.0] * n
        for i in range(1, n):
            (u, v, w), (x, y, z) = belief[parent[i]], message[i]
            u, v, w = u / x, v / y, w / z  # the parent's belief without this child's own message
            q, r, s = pairs[i]
            a, b, c = up[i]
            a, b, c = a * (q[0] * u + r[0] * v + s[0] * w), b * (q[1] * u + r[1] * v + s[1] * w), c * (q[2] * u + r[2] * v + s[2] * w)
            t = a + b + c
            belief[i] = (a / t, b / t, c / t)
            out[i] = belief[i][0]
        return out


def main_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = parse(html)
    return " ".join(t for t, p in zip(page.text, model.marginals(page)) if t is not None and p > 0.5)


# Labelled pages to train from. Layouts vary in tags and names; words are made up, so that only shape and markup can tell.


def training_pages(n: int = 600, seed: int = 7) -> list[str]:
    """``n`` pages with ``data-label`` 1 on what is content and 0 on what isn't."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(("ba", "do", "ki", "lu", "mer", "sta", "on", "tre")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _sentences(rng: random.Random) -> str:
    return " ".join(_words(rng, 1, 18).capitalize() + rng.choice("..!?") for _ in range(rng.choice((1, 1, 2, 4, 8))))


def _links(rng: random.Random) -> str:
    items = [f'<a href="/{k}">{_words(rng, 1, 3)}</a>' for k in range(rng.randint(2, 8))]
    return rng.choice((f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " ".join(items), f"<p>{' | '.join(items)}</p>"))


def _named(rng: random.Random, kind: str) -> str:
    return f' {rng.choice(("class", "class", "id"))}="{rng.choice(HINTS[kind].split())}"'


def _boiler(rng: random.Random, kind: str) -> str:
    tags = {"menu": ("nav", "nav", "div", "ul"), "head": ("header", "header", "div"), "foot": ("footer", "footer", "div"), "side": ("aside", "aside", "div", "section")}
    tag = rng.choice(tags.get(kind, ("form",) if kind == "form" else ("div", "section", "p", "ul")))
    own = tag in ("nav", "header", "footer", "aside", "form")
    name = "" if own and rng.random() < 0.6 else _named(rng, kind)
    if kind in ("menu", "share"):
        inner = _links(rng)
    elif kind == "form":
        inner = f"<label>{_words(rng, 1, 3)}</label><input name=q><button>{_words(rng, 1, 1)}</button>"
    elif kind == "comment":
        inner = "".join(f"<{t}><p>{_sentences(rng)}</p></{t}>" for t in [rng.choice(("div", "li", "article"))] * rng.randint(1, 5))
    elif kind == "side":
        inner = f"<h3>{_words(rng, 1, 4)}</h3>" + rng.choice((_links(rng), f"<p>{_sentences(rng)}</p>"))
    elif kind == "foot":
        inner = rng.choice(("&copy; ", "Copyright ", "")) + rng.choice((_words(rng, 2, 8), _sentences(rng), _links(rng)))
    elif kind == "head":
        inner = rng.choice((f"<h1>{_words(rng, 1, 4)}</h1>", f"<div>{_words(rng, 1, 4)}</div>", _links(rng))) + rng.choice(("", f"<p>{_words(rng, 2, 8)}</p>"))
    else:
        inner = rng.choice((_sentences(rng), f"<p>{_sentences(rng)}</p>", _words(rng, 2, 9)))
    if tag == "p":
        inner = re.sub(r"</?(?:p|div|ul|li|article|h3)>", " ", inner)
    if tag == "ul" and "<li>" not in inner:
        inner = f"<li>{inner}</li>"
    return f'<{tag}{name} data-label="0">{inner}</{tag}>'


def _content(rng: random.Random) -> str:
    blocks = []
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.7:
            text = _sentences(rng)
            blocks.append(f"<p><b>{text}<br>" if rng.random() < 0.1 else f"<p>{text}</p>")
        elif kind < 0.78:
            blocks.append(f"<h{(h := rng.randint(2, 4))}>{_words(rng, 1, 6)}</h{h}>")
        elif kind < 0.84:
            blocks.append("<ul>" + "".join(f"<li>{_words(rng, 1, 12)}{rng.choice(('', '.'))}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
        elif kind < 0.88:
            blocks.append(f"<blockquote><p>{_sentences(rng)}</p></blockquote>")
        elif kind < 0.91:
            blocks.append(f"<pre>{_words(rng, 3, 20)}</pre>")
        elif kind < 0.94:
            blocks.append("<table>" + "".join(f"<tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        else:
            blocks.append(f'<p>{_words(rng, 2, 9)} <a href="/x">{_words(rng, 1, 4)}</a> {_sentences(rng)}</p>')
        if rng.random() < 0.08:
            blocks.append(_boiler(rng, rng.choice(("advert", "share", "side", "notice", "form"))))
    title = rng.choice((f"<h1>{_words(rng, 1, 12)}{rng.choice(('', '.'))}</h1>", "", f"<header><h1>{_words(rng, 1, 10)}</h1></header>" if rng.random() < 0.2 else ""))
    return title + "".join(blocks)


def _page(rng: random.Random) -> str:
    tag = rng.choice(("article", "article", "article", "main", "div", "section"))
    name = _named(rng, "main") if tag in ("div", "section") or rng.random() < 0.2 else ""
    inner = "".join(f"<div>{_content(rng)}</div>" for _ in range(1)) if rng.random() < 0.15 else _content(rng)
    if rng.random() < 0.15:
        inner += _boiler(rng, rng.choice(("comment", "share", "side")))
    core = f'<{tag}{name} data-label="1">{inner}' + (f"</{tag}>" if rng.random() < 0.97 else "")
    before = [_boiler(rng, k) for k in rng.sample(("menu", "head", "advert", "notice", "form"), rng.randint(1, 4))]
    after = [_boiler(rng, k) for k in rng.sample(("foot", "side", "comment", "advert", "share", "notice", "form"), rng.randint(1, 4))]
    if rng.random() < 0.3:
        core = f"<main>{core}</main>" if tag != "main" else f"<div>{core}</div>"
    body = "".join(before) + core + "".join(after)
    body = f"<div{rng.choice((' id=page', '', ' class=wrapper'))}>{body}</div>" if rng.random() < 0.4 else body
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


@lru_cache(maxsize=4)
def trained(n: int = 600, seed: int = 7) -> Model:
    return Model(training_pages(n, seed))


def extract(pages: DataFrame, training: int = 600, seed: int = 7) -> DataFrame:
    """``page_id, url, text, n_chars``, a row for each page. The potentials, a few hundred numbers, are counted once and shipped."""
    model = trained(training, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_texts(read, run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
