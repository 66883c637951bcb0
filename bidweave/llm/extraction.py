"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks with the elements they stand in. A logistic classifier of the
block's text gives one cost for calling it content and one for calling it boilerplate; the elements'
names and roles add theirs, and so do classes and ids, of which the nearest that says something counts.
All are on one scale, so that a wrong element can be outweighed by its own name, its text and its
neighbours. A header inside an article is part of it. These costs are the capacities to the two terminals. Blocks next to each
other, and blocks with the same parent, are tied by smoothness edges that weaken with the distance
in the tree. The minimum cut is the labelling of least total cost.

The classifier is fitted on SAMPLE_PAGES pages at most, picked by hash, whose blocks are labelled by
unmistakable elements (article or main against nav, footer, aside and the like); with no such blocks
the weights DEFAULT stand. Every page is labelled on its own in one pass, with no shuffle.

Edge cases: null and empty pages give the empty text; unclosed, crossed and truncated markup is read
as browsers do for the elements that matter here; a page without one content block gives the empty
text; repeated rows and null ids are kept; columns besides the id, url and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 1000
ADJACENT = 1.0
SIBLING = 1.0
REACH = 2.0
ELEMENT = 5.0
ARTICLE = 5.0
NAMED = 4.0
FOREIGN_NAMED = 6.0  # of names that only ever belong to something beside the article

# Elements of HTML by their part in a page.
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table"
    " tbody td tfoot th thead title tr ul".split()
)
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_ELEMENTS = frozenset("script style textarea noscript iframe noframes noembed xmp".split())
#: Elements of other vocabularies, where "/>" ends any element, and those in them that hold HTML again.
FOREIGN_ELEMENTS = frozenset("svg math".split())
HTML_AGAIN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: An opening one of these ends an open svg or math.
ENDS_FOREIGN = frozenset(
    "b blockquote body center code dd div dl dt em h1 h2 h3 h4 h5 h6 head hr i img li menu ol p pre s small span strong sub sup table u ul article aside footer header main nav section".split()
)
#: An end tag of these also ends what is left open in them.
ENCLOSING = frozenset("svg math template object".split())
DROPPED_ELEMENTS = RAW_ELEMENTS | frozenset("svg template object annotation annotation-xml head title form button select option input label fieldset audio video canvas map dialog".split())
BOILERPLATE_ELEMENTS = frozenset("nav footer header aside menu search".split())
CONTENT_ELEMENTS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog status".split())
#: Parts of a class or id that mark what is not the article when they are its head, the last part that says what it is.
BOILERPLATE_PARTS = re.compile(
    r"ads?|adverts?|advertis\w*|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*"
    r"|comments?|commentlist|replies|respond|disqus|discussion|sidebar|side|aside|widgets?|related|recommend\w*|trending|more|menu|nav|navbar|navigation|breadcrumbs?"
    r"|pagination|pager|toc|header|masthead|topbar|footer|bottombar|copyright|legal|social|share|sharing|login|signup|search|form|tags?|skip|tools?|toolbar|hidden"
)
#: Of these, the ones that mark it before any other head too.
FOREIGN_PARTS = re.compile(r"ads?|adverts?|advertis\w*|adslot|sponsor\w*|cookies?|consent|gdpr|newsletter|comments?|commentlist|disqus|sidebar|widgets?|breadcrumbs?|menu|nav|navbar|navigation|footer|masthead|topbar|pagination")
NEUTRAL_PARTS = frozenset("a an the and of to by in all area bar block box bottom boxes btn button buttons container grid group inner item items left links list outer panel posts right row rows section site slot stories top unit wrap wrapper".split())
CONTENT_PARTS = frozenset("article content entry post story main text body".split())
CONTAINER_PARTS = NEUTRAL_PARTS | frozenset("content text body main".split())
#: A name with one of these says how a page is laid out, not what the element is.
LAYOUT_PARTS = frozenset("has have with without no not is free hide show".split())
PART = re.compile(r"[_-]+|\d+")
#: An opening element ends an open one of these inside the same list, table or definition list.
CLOSED_BY = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol table dl select html menu".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


def _name_mark(name: str) -> float:
    """What one class or id says: above zero for the article, below for something else, zero for nothing.

    Container words at the end are passed over (``comment-body`` is a comment); a header is only
    one of the page if its name has no word for the article.
    """
    parts = [p for p in PART.split(name.lower()) if p]
    if not parts or not LAYOUT_PARTS.isdisjoint(parts):
        return 0.0
    head = len(parts) - 1
    while head and parts[head] in CONTAINER_PARTS:
        head -= 1
    story = not CONTENT_PARTS.isdisjoint(parts)
    if any(FOREIGN_PARTS.fullmatch(p) for p in parts):
        return -FOREIGN_NAMED
    if BOILERPLATE_PARTS.fullmatch(parts[head]) and not (story and parts[head] == "header"):
        return -NAMED
    return NAMED if story else 0.0


def names_mark(names: str) -> float:
    """What all classes and ids say: one that names something else outweighs those that name the article."""
    marks = [_name_mark(n) for n in names.split()]
    return min(min(marks), 0.0) or max(marks) if marks else 0.0


class Element:
    __slots__ = ("name", "parent", "depth", "dropped", "boilerplate", "inside", "mark", "link", "foreign")

    def __init__(self, name: str, parent: Element | None, attributes: str = ""):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.foreign = (name in FOREIGN_ELEMENTS or bool(parent and parent.foreign)) and name not in HTML_AGAIN
        self.link = name == "a" or bool(parent and parent.link)
        self.dropped = name in DROPPED_ELEMENTS or bool(parent and parent.dropped)
        given = {}
        if attributes and not attributes.isspace():
            given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            bare = ATTRIBUTE.sub(" ", attributes).lower().split()
            unseen = HIDDEN_STYLE.search(given.get("style", ""))
            self.dropped |= "hidden" in bare or given.get("aria-hidden", "").lower() == "true" or bool(unseen)
        self._place(given.get("role", "").lower(), f"{given.get('class', '')} {given.get('id', '')}")

    def _place(self, role: str, names: str) -> None:
        """Part of the page that the element is, and the mark of the nearest element that has one."""
        parent, outer = self.parent, self.name in ("html", "body")
        within = bool(parent and parent.boilerplate)
        article = self.name in CONTENT_ELEMENTS or role in ("main", "article")
        self.inside = article or bool(parent and parent.inside)
        own = self.name in BOILERPLATE_ELEMENTS and not (self.name == "header" and self.inside) or role in BOILERPLATE_ROLES and not outer
        self.boilerplate = within or own
        self.mark = 0.0 if own or not parent else parent.mark
        named = 0.0 if outer and names_mark(names) < 0 else names_mark(names)
        if article or named:
            foreign = named <= -FOREIGN_NAMED  # an article element that is named a comment is one
            mark = named if foreign else (ARTICLE if article else max(named, 0.0)) + min(named, 0.0)
            self.mark = mark / 2 if within and mark > 0 else mark


class TextBlock:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def _opened_in(here: Element, name: str) -> Element:
    """The element that a new ``name`` opens in, once it has ended what cannot hold it."""
    if name in BLOCK_ELEMENTS:
        up = here
        while up.parent and up.name not in ENCLOSING and (up.name == "p" or up.name not in BLOCK_ELEMENTS):
            up = up.parent
            if up.name == "p":
                here = up.parent
                break
        if here.name == "p":
            here = here.parent
    if name in CLOSED_BY:
        up, ends = here, CLOSED_BY[name].split()
        while up.parent and up.name not in SCOPES and up.name not in ENCLOSING:
            if up.name in ends:
                here = up.parent
            up = up.parent
    return here


def _outside(here: Element) -> Element:
    """The element that the open svg or math stands in."""
    while here.foreign and here.parent:
        here = here.parent
    return here


def _closed(here: Element, name: str) -> Element:
    """Where an end tag leads; one that ends nothing changes nothing."""
    up = here
    while up.parent and up.name != name:
        if name not in BLOCK_ELEMENTS and name not in ENCLOSING and up.name in BLOCK_ELEMENTS or name == "p" and up.name in BLOCK_ELEMENTS:
            return here
        up = up.parent
    return up.parent or here


def blocks(html: str) -> list[TextBlock]:
    """Text blocks in page order, without what is dropped whatever its text."""
    out: list[TextBlock] = []
    here = Element("", None)
    parts: list[str] = []
    linked = at = 0

    def add(text: str) -> None:
        nonlocal linked
        if not here.dropped:
            parts.append(text)
            if here.link:
                linked += len(text.strip())

    def end_block() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            inner = here
            while inner.parent and inner.name not in BLOCK_ELEMENTS:
                inner = inner.parent
            out.append(TextBlock(text, linked, inner))
        parts.clear()
        linked = 0

    while (tag := TOKEN.search(html, at)) is not None:
        add(html[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        while here.foreign and name in ENDS_FOREIGN and not tag[1]:
            here = here.parent
        if here.foreign and not tag[1] and tag[3].endswith("/"):
            continue
        if name in BLOCK_ELEMENTS and not here.foreign:
            end_block()
        elif name == "br":
            add(" ")
        if tag[1]:
            if here.foreign and name in BLOCK_ELEMENTS and _closed(here, name).depth < _outside(here).depth:
                end_block()
            here = _closed(here, name)
        elif name in RAW_ELEMENTS:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID_ELEMENTS and not (tag[3].endswith("/") and name not in BLOCK_ELEMENTS):
            here = Element(name, here if here.foreign else _opened_in(here, name), tag[3])
    add(html[at:])
    end_block()
    return out


FEATURES = 7
#: Weights of the features where no page of the sample has labelled blocks.
DEFAULT = np.array([-2.0, 0.6, -4.0, 1.5, 1.0, 0.0, -1.0])


def features(block: TextBlock) -> list[float]:
    text = block.text
    words = WORD.findall(text)
    n = max(1, len(words))
    return [
        1.0,
        float(np.log1p(len(words))),
        min(1.0, block.linked / len(text)),
        float(bool(SENTENCE.search(text[-2:]))),
        min(1.0, 10 * len(SENTENCE.findall(text)) / n),
        sum(map(len, words)) / n / 10,
        sum(c.isdigit() for c in text) / len(text),
    ]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing the same."""
    if not len(y) or y.min() == y.max():
        return DEFAULT
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - w)
    return w


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node pays ``gain`` for False where it is positive, ``-gain`` for True
    where it is negative, and every edge pays its weight where its ends differ.

    A node whose gain outweighs all its edges keeps its sign in some minimum cut; fixing such nodes,
    one after another, mostly settles a page. Augmenting paths settle the rest.
    """
    gain, near = list(gain), [{} for _ in gain]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * len(gain)
    waiting = list(range(len(gain)))
    while waiting:
        i = waiting.pop()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                waiting.append(j)
    open_nodes = [i for i, x in enumerate(label) if x is None]
    if open_nodes:
        source, sink = -1, -2
        room: dict[int, dict[int, float]] = {source: {}, sink: {}}
        for i in open_nodes:
            room[i] = dict(near[i])
        for i in open_nodes:
            room[source][i], room[i][source] = max(gain[i], 0.0), 0.0
            room[i][sink], room[sink][i] = max(-gain[i], 0.0), 0.0
        while True:
            came, queue = {source: source}, [source]
            for i in queue:
                for j, c in room[i].items():
                    if c > 1e-9 and j not in came:
                        came[j] = i
                        queue.append(j)
            if sink not in came:
                break
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[i][j] for i, j in path)
            for i, j in path:
                room[i][j] -= flow
                room[j][i] += flow
        for i in open_nodes:
            label[i] = i in came
    return label


def _apart(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def content(found: list[TextBlock], weights: np.ndarray) -> list[bool]:
    text_gain = np.clip(np.array([features(b) for b in found]) @ weights, -3, 3)
    gain = [g + b.element.mark - ELEMENT * b.element.boilerplate for g, b in zip(text_gain.tolist(), found)]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT * float(np.exp(-max(0, _apart(found[i - 1].element, b.element) - 2) / REACH))))
        parent = id(b.element.parent)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    kept = minimum_cut(gain, edges)
    if any(kept) or all(b.element.mark >= 0 for b in found):
        return kept
    # names alone never empty a page
    return minimum_cut([g + max(0.0, -b.element.mark) * (not b.element.boilerplate) for g, b in zip(gain, found)], edges)


def main_text(html: str | None, weights: np.ndarray = DEFAULT) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(found, content(found, weights)) if keep) if found else ""


def train(pages: DataFrame, html: str = "html", limit: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from the labelled blocks of ``limit`` pages of at most 1 MB each."""
    rows = pages.select(F.xxhash64(html).alias("h"), F.col(html).alias("html")).where(F.octet_length(html) <= 1 << 20)
    picked = rows.select("h").orderBy("h").limit(limit).distinct()

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page in batch["html"]:
                for b in blocks(page):
                    if b.element.boilerplate or b.element.mark:
                        out.append((features(b), int(not b.element.boilerplate and b.element.mark > 0)))
            yield pd.DataFrame(out, columns=["x", "y"])

    sample = rows.join(F.broadcast(picked), "h", "left_semi").dropDuplicates(["h"]).select("html").mapInPandas(label, "x array<double>, y int").collect()
    x = np.array([r["x"] for r in sample]).reshape(-1, FEATURES)
    order = np.lexsort(x.T) if len(x) else []
    return fit(x[order], np.array([r["y"] for r in sample], float)[order]) if len(x) else DEFAULT


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""
    weights = train(pages, html)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch["html"]]
            yield pd.DataFrame({"key": batch["key"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInPandas(run, "key string, url string, text string, n_chars long")
    return out.select(F.col("key").cast(pages.schema[key].dataType).alias(key), F.col("url").alias(url), "text", "n_chars")
