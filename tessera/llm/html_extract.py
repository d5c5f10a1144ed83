"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are nodes with two states, content or not. A
node's own potential comes from its figures (each word of its class, id and
role, their group, share of text in links, amount of text, depth); an edge's
potential is the probability of a child's state given its parent's, by the pair
of their tags. Sum-product messages go up the tree and down again, which gives
each node's marginal exactly; text whose block is more likely content than not
is kept.

Potentials are trained from labelled pages, a bounded sample of those with one
marked article (or main element): nodes inside it are content, but for
navigation, asides, forms and footers in it; all others are not. Elements in
the article whose names tell of adverts, comments and the like have no label,
nor has what they hold. Weak prior counts stand for what the sample lacks; all
potentials have the same bound either way.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

#: Pages at most to train on, chosen by a hash of their text.
MAX_PAGES = 1_500
#: Code points at most of a page to train on (any page is extracted whole).
MAX_TRAINING_CHARS = 100_000

MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")

# Kinds of elements.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NEVER = {"head", "noscript", "template", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer foot gdpr"
    " header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reply replies"
    " respond search share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert disclaimer".split()
)
GOOD_NAMES = set("article content entry main post story text body".split())
OUTER = {"nav", "header", "footer", "aside", "form", "menu", "fieldset", "search", "dialog"}
#: Weak prior counts (content, not) for the values of a node's figures.
PRIOR = {("name", "bad"): (1.0, 12.0), ("name", "good"): (4.0, 2.0), ("links", 3): (1.0, 3.0)}
#: Prior counts of a child's state (not, content) given its parent's (not, content), by the child's kind of tag.
EDGE_PRIOR = {"text": ((30.0, 1.0), (1.0, 30.0)), "box": ((4.0, 1.0), (1.0, 4.0)), "top": ((4.0, 1.0), (1.0, 4.0)), "root": ((1.0, 4.0), (1.0, 4.0)), "outer": ((30.0, 0.5), (8.0, 1.0)), "named": ((30.0, 0.5), (6.0, 1.0))}
KINDS = {"article": "root", "main": "root", "div": "box", "section": "box", "td": "box", "body": "top", "html": "top"} | {t: "outer" for t in OUTER}
MOST = 4.0  # of a figure's log potential, either way
#: Weight of the figures that go together (links, amount and depth), so that their sum doesn't count the same evidence over and over.
SHARED = 0.5
FIGURE_ROWS, EDGE_ROWS = 200, 50  # counts of a figure, and of a pair of tags, are scaled down to so many


def kind_of(parent: str, tag: str, name: str) -> str:
    """The kind of an edge; a header in an article or section is its own, and holds its headline."""
    if name == "bad":
        return "named"
    return "box" if tag == "header" and parent in ("article", "section", "main") else KINDS.get(tag, "text")


class Page:
    """Nodes of one page, parents first, and its text in order."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.names: list[str] = []
        self.words: list[list[str]] = []
        self.depths: list[int] = []
        self.text: list[tuple[int, str, bool]] = []  # node (-1: never content), text, in a link
        self.parse(source)

    def node(self, tag: str, parent: int, attributes: str) -> int:
        words: set[str] = set()
        if "=" in attributes:
            words = {w for m in NAMED.findall(attributes) for v in m if v for w in WORD.findall(v.lower())}
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.words.append(sorted(words))
        self.names.append("bad" if words & BAD_NAMES else "good" if words & GOOD_NAMES else "plain" if words else "none")
        return len(self.tags) - 1

    def parse(self, source: str) -> None:
        root = self.node("html", -1, "")
        stack: list[tuple[str, int]] = [("html", root)]  # tag, its block's node (-1: never content)
        places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack
        blocks: list[int] = []  # those of blocks but paragraphs
        links, at, text = 0, 0, self.text
        nearest = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)

        def shut(first: int) -> None:
            nonlocal links
            while len(stack) > first:
                t, _ = stack.pop()
                places[t].pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()
                links -= t == "a"

        for m in MARKUP.finditer(source):
            if m.start() < at:  # inside an element of raw text
                continue
            if m.start() > at:
                text.append((stack[-1][1], source[at : m.start()], links > 0))
            at = m.end()
            if m[1] is not None:
                text.append((stack[-1][1], html.escape(m[1], False), links > 0))
            tag = m[3] or m[7]
            if not tag:
                continue
            tag, close = tag.lower(), m[2] or m[6]
            if tag == "br" or tag in BLOCK:
                text.append((stack[-1][1], "\n", links > 0))
            if close:
                if places[tag]:
                    shut(places[tag][-1])
                continue
            if tag in VOID or tag == "html" or (tag == "body" and places["body"]):
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if m[5] and tag not in BLOCK:
                continue
            # Elements that this one ends: a link, an item of the same list or table, a paragraph.
            if tag in SAME_LEVEL and nearest(SAME_LEVEL[tag]) > nearest(SCOPE[tag]):
                shut(nearest(SAME_LEVEL[tag]))
            ended = "a" if tag == "a" else "p" if tag in CLOSES_P else ""
            if ended and places[ended] and places[ended][-1] > (blocks[-1] if blocks else 0):
                shut(places[ended][-1])
            own = stack[-1][1]
            if own >= 0:
                own = -1 if tag in NEVER else self.node(tag, own, m[4] or m[8] or "") if tag in BLOCK else own
            places[tag].append(len(stack))
            if tag in BLOCK and tag != "p":
                blocks.append(len(stack))
            stack.append((tag, own))
            links += tag == "a"
        if at < len(source):
            text.append((stack[-1][1], source[at:], links > 0))

    def figures(self) -> list[list[tuple]]:
        """The figures of each node; amounts are of its whole branch."""
        n = len(self.tags)
        size, linked = [0] * n, [0] * n
        for node, t, link in self.text:
            if node >= 0 and (k := len(t) if t.strip() else 0):
                size[node] += k
                linked[node] += k if link else 0
        for i in range(n - 1, 0, -1):
            size[self.parents[i]] += size[i]
            linked[self.parents[i]] += linked[i]
        out = []
        for i in range(n):
            share = linked[i] / size[i] if size[i] else 0.0
            amount = min(6, int(math.log2(size[i] + 1) / 1.7))
            out.append([("name", self.names[i]), ("links", 0 if share < 0.1 else 1 if share < 0.35 else 2 if share < 0.7 else 3), ("amount", amount), ("depth", min(6, self.depths[i])), *(("word", w) for w in self.words[i])])
        return out

    def edges(self) -> list[tuple[str, str, str]]:
        """The pair of tags and the kind of the edge to each node's parent; the root's is not used."""
        pairs = [(self.tags[p] if p >= 0 else "", t, name) for p, t, name in zip(self.parents, self.tags, self.names, strict=True)]
        return [(a, b, kind_of(a, b, name)) for a, b, name in pairs]

    def labels(self, tag: str) -> list[bool | None] | None:
        """Which nodes are content, from the only element ``tag`` (None: no label); None if there is none, or several."""
        if self.tags.count(tag) != 1:
            return None
        out: list[bool | None] = []
        for t, p, (_, _, kind) in zip(self.tags, self.parents, self.edges(), strict=True):
            above = out[p] if p >= 0 else False
            out.append(True if t == tag else above if not above else None if kind == "named" else kind != "outer")
        return out

    def kept(self, content: list[bool]) -> str:
        """The text of content nodes, white space and blocks joined by one space."""
        raw, gap = [], False
        for node, t, _ in self.text:
            if node >= 0 and content[node]:
                raw.append(" " + t if gap else t)
                gap = False
            else:
                gap = True
        return " ".join(html.unescape("".join(raw)).split())


class Model:
    """Log potentials of figures, and probabilities of a child's state given its parent's, by pair of tags and by kind; of the root by itself."""

    def __init__(self, figures: dict, edges: dict, kinds: dict, root: float = 0.0):
        self.figures, self.edges, self.kinds, self.root = figures, edges, kinds, root

    def potentials(self, page: Page) -> tuple[list[float], list[tuple]]:
        """The log odds of content of each node by itself, and the table of the edge to its parent."""
        get = self.figures.get
        own = [sum([get(v, 0.0) for v in values]) for values in page.figures()]
        own[0] += self.root
        return own, [self.edges.get(e) or self.kinds[e[2]] for e in page.edges()]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each node, by messages up and down the tree."""
        n, parents = len(page.tags), page.parents
        own, edge = self.potentials(page)
        # Beliefs as pairs (not, content), scaled; potentials of nodes are odds.
        up = [(1.0, math.exp(max(-30.0, min(30.0, o)))) for o in own]
        message: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            b0, b1 = up[i]
            (e00, e01), (e10, e11) = edge[i]
            m0, m1 = e00 * b0 + e01 * b1, e10 * b0 + e11 * b1
            z = m0 + m1
            message[i] = (m0 / z, m1 / z)
            p0, p1 = up[parents[i]]
            p0, p1 = p0 * m0 / z, p1 * m1 / z
            s = p0 + p1
            up[parents[i]] = (p0 / s, p1 / s)
        out = [0.0] * n
        full = up[:]
        out[0] = full[0][1] / (full[0][0] + full[0][1])
        for i in range(1, n):
            f0, f1 = full[parents[i]]
            m0, m1 = message[i]
            r0, r1 = f0 / max(m0, 1e-300), f1 / max(m1, 1e-300)
            (e00, e01), (e10, e11) = edge[i]
            b0, b1 = up[i][0] * (r0 * e00 + r1 * e10), up[i][1] * (r0 * e01 + r1 * e11)
            s = b0 + b1
            full[i] = (b0 / s, b1 / s)
            out[i] = b1 / s
        return out


def train(sources: list[str]) -> Model:
    """Potentials from pages with one marked article, over weak prior counts."""
    seen: dict = defaultdict(lambda: [0.0, 0.0])
    roots, states, pairs = [1.0, 1.0], [1.0, 1.0], defaultdict(lambda: [[0.0, 0.0], [0.0, 0.0]])
    for source in sources:
        page = Page(source or "")
        labels = page.labels("article") or page.labels("main")
        if labels is None:
            continue
        for values, state, parent, edge in zip(page.figures(), labels, page.parents, page.edges(), strict=True):
            if state is None:
                continue
            states[state] += 1
            for v in values:
                seen[v][state] += 1
            if parent < 0:
                roots[state] += 1
            elif labels[parent] is not None:
                pairs[edge][labels[parent]][state] += 1
    figures = {}
    for v in set(seen) | set(PRIOR):
        no, yes = seen[v]
        a, b = PRIOR.get(v, (1.0, 1.0))
        # Counts are scaled down, so that no figure outweighs all others by the sample's size.
        scale = min(1.0, FIGURE_ROWS / (yes + no)) if yes + no else 0.0
        odds = math.log((yes * scale + a) / (no * scale + b)) - (math.log(states[1] / states[0]) * scale if scale else 0.0)
        figures[v] = max(-MOST, min(MOST, odds)) * (SHARED if v[0] in ("links", "amount", "depth") else 1.0)

    def table(counts, prior) -> tuple:
        rows = []
        for own, before in zip(counts, prior, strict=True):
            scale = min(1.0, EDGE_ROWS / sum(own)) if sum(own) else 0.0
            row = [x * scale + y for x, y in zip(own, before, strict=True)]
            rows.append(tuple(x / sum(row) for x in row))
        return tuple(rows)

    kinds = {}
    for kind, prior in EDGE_PRIOR.items():
        own = [[sum(c[p][s] for e, c in pairs.items() if e[2] == kind) for s in (0, 1)] for p in (0, 1)]
        kinds[kind] = table(own, prior)
    # A pair of tags starts from its kind.
    edges = {e: table(c, [[4 * x for x in row] for row in kinds[e[2]]]) for e, c in pairs.items()}
    return Model(figures, edges, kinds, max(-MOST, min(MOST, math.log(roots[1] / roots[0]))))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, extra: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of each row of ``pages``.

    A null or empty page has an empty text; malformed markup is read as far as
    it goes; rows that repeat are read each, equal pages have equal texts; an
    empty table gives no rows. ``extra`` columns are passed on, others are not
    read. Pages of any length are read whole, in time that grows in proportion
    to their elements. A header inside an article is part of it.

    Returns ``id_col``, ``extra``, text, n_chars long (code points).
    """
    source = F.coalesce(F.col(html_col), F.lit(""))
    sample = pages.where((source.contains("<article") | source.contains("<main")) & (F.length(source) <= MAX_TRAINING_CHARS)).select(F.xxhash64(source).alias("h"), source.alias("html"))
    least = sample.select("h").distinct().orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    chosen = sample.where(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).orderBy("h").limit(max_pages).collect() if least is not None else []  # bounded by max_pages
    model = train([r["html"] for r in chosen])
    shared = pages.sparkSession.sparkContext.broadcast((model.figures, model.edges, model.kinds, model.root))
    at = len(extra) + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Model(*shared.value)
        for batch in batches:
            texts = []
            for page in batch.column(at).to_pylist():
                tree = Page(page)
                texts.append(tree.kept([p >= 0.5 for p in own.marginals(tree)]))
            columns = [*(batch.column(i) for i in range(at)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *extra, "text", "n_chars"])

    rows = pages.select(id_col, *extra, source.alias(fresh(pages, "source")))
    types = dict(pages.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (id_col, *extra)) + ", text string, n_chars long")
