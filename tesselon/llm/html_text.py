"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into the text blocks between block-level tags. Each block is described by its word count
and link density, those of the blocks before and after it, its place (inside an article, inside
navigation and the like, or neither) and whether names of the tags around it hint at other things than
the article. A decision tree, trained on the labelled table below, tells which blocks belong to the main
text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import chunks

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)[^>]*>?|<[!?][^>]*>?""", re.S)
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements with markup inside that is never shown as text of the page, or only in place of something else.
_APART = frozenset("noscript template svg object canvas audio video select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ASIDE = frozenset("nav footer aside form menu dialog head".split())
#: What the start of an element ends: open elements of these tags, unless one of the others is open inside them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
_TABLE = frozenset("table td th caption".split())
_TABLE_TAGS = _TABLE | frozenset("tr tbody thead tfoot".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTENT = frozenset("p li dd dt td th blockquote pre figure figcaption".split())
# Words in names that mark other things than the article; the second kind may also be what an article is about.
_STRONG = r"ads?|adsby\w+|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|newsletters?|subscri\w+|popup|modal|side-?bars?|menus?|nav\w*|breadcrumbs?|footer|masthead|comments?|disqus|pager|pagination|toolbar|skip|contentinfo|complementary|shar(?:e|ing)|social|log-?in"
_WEAK = r"notices?|alerts?|related|recommend\w*|widgets?|discussion|repl(?:y|ies)|search|sign-?up"
_JOINED_BEFORE, _JOINED_AFTER = r"(?:post|page|site|user|reader|blog|article|main|top|left|right|header)?", r"(?:list|box|block|wrap(?:per)?|area|section|bar|form|thread|slot|unit|body|links?|container)?"
_FILLER = r"list|block|box|wrap(?:per)?|container|area|section|bar|links?|items?|inner|outer|body|text|header|title|post|entry|article|site|main|page|top|bottom|left|right|global|slot|unit|\d+"
_HINT = re.compile(rf"(?<![a-z]){_JOINED_BEFORE}(?:{_STRONG}|{_WEAK}){_JOINED_AFTER}(?![a-z])")
_WHOLE = re.compile(rf"(?:(?:{_FILLER})[-_]+)*{_JOINED_BEFORE}(?:{_STRONG}){_JOINED_AFTER}(?:[-_]+(?:{_STRONG}|{_WEAK}|{_FILLER}))*")
_AD_ATTRIBUTE = re.compile(r"""(?:^|\s)data-(?:ads?|advert\w*|sponsor\w*)(?:-[\w-]*)?(?=[\s=/]|$)""")
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WHITE = re.compile(r"\s+")
INSIDE, NO_ARTICLE, OUTSIDE, ASIDE = 2, 1, 0, -1


class Block(NamedTuple):
    text: str
    words: int
    density: float
    place: int
    hint: int


def _hint(tag: str, attributes: str) -> int:
    """2 if a name says nothing but a word for other things or an attribute names an advert, 1 if a name holds such a word, else 0.

    Names of headings are made from their words and mean nothing; those of paragraphs and the like are
    seldom a place's.
    """
    if tag in _HEADING or tag in ("html", "body"):
        return 0
    if "data-" in attributes and _AD_ATTRIBUTE.search(_VALUE.sub("=", attributes)):
        return 2
    if not _HINT.search(attributes):
        return 0
    names = [name for value in _ATTRIBUTE.findall(attributes) for name in value.strip("\"'").split()]
    if tag not in _CONTENT and any(map(_WHOLE.fullmatch, names)):
        return 2
    return int(tag in _BLOCK and any(map(_HINT.search, names)))


class _Open(NamedTuple):
    """An open element, and what holds again once it is closed."""

    tag: str
    block: bool
    place: int
    hint: int
    held: tuple[list[str], int] | None


class _Page:
    """One pass over the tags of a page; every element is pushed and popped once."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are
        self.blocks, self.tables = [], []
        self.parts, self.link_words = [], 0
        self.place, self.hint, self.article = NO_ARTICLE, 0, False
        self.closed_at: dict[str, int] = {}

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.parts.append(text)
            if self.at["a"]:
                self.link_words += len(text.split())

    def flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.out.append((text, text.count(" ") + 1, self.link_words, self.place, self.hint))
        self.parts, self.link_words = [], 0

    def close(self, k: int) -> None:
        """Close the open elements from number ``k`` on."""
        while len(self.open) > k:
            last = self.open.pop()
            self.at[last.tag].pop()
            if last.block:
                self.blocks.pop()
            if last.tag in _TABLE:
                self.tables.pop()
            if last.block or last.held:
                self.flush()
            self.place, self.hint = last.place, last.hint
            if last.held:
                self.parts, self.link_words = last.held
                self.parts.append(" ")

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def end(self, tag: str) -> None:
        k = self.last((tag,))
        if tag in _BLOCK:
            inside = -1 if tag in _TABLE_TAGS else self.last(("td", "th", "caption"))
        else:
            inside = self.blocks[-1] if self.blocks else -1
        if k > inside:
            self.close(k)
        elif tag in _BLOCK:
            self.flush()

    def start(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCK
        if block:
            p = self.last(("p",))
            if p > self.last(_TABLE):
                self.close(p)
            ends, unless = _ENDS.get(tag, ((), ()))
            k = self.last(ends)
            if k > self.last(unless):
                self.close(k)
            self.flush()
        elif tag == "a":
            k = self.last(("a",))
            if k > (self.blocks[-1] if self.blocks else -1):
                self.close(k)
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        own, hidden = _hint(tag, attributes), bool(_HIDDEN.search(attributes))
        place, hint = self.place, max(self.hint, own)
        if tag in ("article", "main") and place != ASIDE and self.hint < 2:
            # An article's own name may be that of one with comments; what hints around it is the page's.
            if own < 2:
                place, hint, self.article = INSIDE, 0, True
        elif tag in _ASIDE or tag in _APART or hidden or (tag == "header" and place != INSIDE):
            place = ASIDE
        held = None
        if not block and (place != self.place or own > self.hint):
            held, self.parts, self.link_words = (self.parts, self.link_words), [], 0
        self.at[tag].append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        if tag in _TABLE:
            self.tables.append(len(self.open))
        self.open.append(_Open(tag, block, self.place, self.hint, held))
        self.place, self.hint = place, hint

    def is_closed(self, tag: str, at: int) -> bool:
        """Whether an end tag follows; the search goes over the page once for each tag."""
        if self.closed_at.get(tag, -1) < at:
            found = re.compile(rf"</{re.escape(tag)}(?![a-z0-9])", re.I).search(self.page, at)
            self.closed_at[tag] = found.start() if found else len(self.page) + 1
        return self.closed_at[tag] <= len(self.page)

    def run(self) -> list[Block]:
        at = 0
        while m := _TAG.search(self.page, at):
            self.add(self.page[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if m[1]:
                self.end(tag)
            elif tag in _RAW:
                if not m[0].endswith("/>"):
                    end = re.compile(rf"</{tag}(?![a-z0-9])[^>]*>?", re.I).search(self.page, at)
                    at = end.end() if end else len(self.page)
            elif tag and not (tag in _APART and (m[0].endswith("/>") or not self.is_closed(tag, at))):
                self.start(tag, m[3].lower())
        self.add(self.page[at:])
        self.close(0)
        self.flush()
        return [Block(text, words, linked / words, OUTSIDE if self.article and where == NO_ARTICLE else where, hint) for text, words, linked, where, hint in self.out]


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in page order, references decoded and white space folded."""
    return _Page(page).run()


# Labelled blocks: words, link density, then both of the block before and of the block after (0 at the
# page's ends), place (2 in an article, 1 on a page without one, 0 outside it, -1 navigation and the
# like), hint (2 a name for other things, 1 a name with such a word, 0 none), and whether it is main text.
LABELLED = """
8 0.0 0 0.0 62 0.0 2 0 1
62 0.0 8 0.0 40 0.0 2 0 1
40 0.1 62 0.0 15 0.0 2 0 1
15 0.0 40 0.1 3 0.0 2 0 1
3 0.0 15 0.0 90 0.0 2 0 1
1 0.0 55 0.0 1 0.0 2 0 1
1 0.0 1 0.0 12 0.0 2 0 1
12 1.0 70 0.0 33 0.0 2 0 1
2 1.0 33 0.0 48 0.0 2 0 1
120 0.02 12 0.0 9 0.0 2 0 1
9 0.0 120 0.02 0 0.0 2 0 1
25 0.4 18 0.0 1 0.0 2 0 1
1 1.0 0 0.0 1 1.0 -1 0 0
1 1.0 1 1.0 1 1.0 -1 0 0
4 1.0 1 1.0 9 0.0 -1 0 0
9 0.0 4 1.0 8 0.0 -1 0 0
35 0.0 1 1.0 60 0.0 -1 0 0
80 0.0 60 0.0 0 0.0 -1 0 0
14 0.2 90 0.0 0 0.0 -1 0 0
22 0.0 45 0.0 31 0.0 -1 0 0
55 0.05 40 0.0 44 0.0 -1 0 0
2 0.0 60 0.0 3 0.0 -1 0 0
12 0.0 0 0.0 10 0.0 0 0 0
45 0.0 3 1.0 8 0.0 0 0 0
3 1.0 2 1.0 45 0.0 0 0 0
20 0.1 70 0.0 0 0.0 0 0 0
100 0.0 30 0.0 2 0.0 0 0 0
1 0.0 20 0.1 5 1.0 0 0 0
1 1.0 0 0.0 1 1.0 1 0 0
2 1.0 1 1.0 3 1.0 1 0 0
3 1.0 2 1.0 11 0.0 1 0 0
6 0.9 3 1.0 2 1.0 1 0 0
5 0.8 1 1.0 6 0.9 1 0 0
4 0.0 2 1.0 3 1.0 1 0 0
3 0.0 5 0.8 4 0.7 1 0 0
6 0.0 2 1.0 70 0.0 1 0 1
70 0.0 6 0.0 52 0.0 1 0 1
52 0.05 70 0.0 34 0.0 1 0 1
34 0.0 52 0.05 18 0.1 1 0 1
18 0.1 34 0.0 41 0.0 1 0 1
11 0.0 41 0.0 29 0.0 1 0 1
29 0.2 11 0.0 5 0.0 1 0 1
5 0.0 29 0.2 64 0.0 1 0 1
64 0.0 5 0.0 4 0.9 1 0 1
20 0.0 0 0.0 25 0.0 1 0 1
25 0.0 20 0.0 0 0.0 1 0 1
40 0.0 0 0.0 0 0.0 1 0 1
4 0.9 64 0.0 8 1.0 1 0 0
8 1.0 4 0.9 7 0.0 1 0 0
7 0.0 8 1.0 0 0.0 1 0 0
9 0.6 50 0.0 2 1.0 1 0 0
30 0.8 50 0.0 6 1.0 1 0 0
16 0.7 3 1.0 4 1.0 1 0 0
3 1.0 40 0.0 0 0.0 1 0 0
4 1.0 60 0.0 7 0.0 1 0 0
2 1.0 25 0.1 30 0.0 1 0 0
6 0.0 2 1.0 30 0.0 1 0 1
5 0.0 1 1.0 18 0.0 1 0 1
9 0.0 0 0.0 7 0.0 1 0 1
7 0.0 9 0.0 8 0.0 1 0 1
4 0.0 7 0.0 5 0.0 1 0 1
4 0.0 2 1.0 3 0.0 1 0 0
3 0.0 1 1.0 2 0.0 1 0 0
5 0.0 3 1.0 6 0.0 1 0 0
2 0.0 1 1.0 4 0.0 1 0 0
4 0.0 2 1.0 40 0.0 1 0 1
3 0.0 1 1.0 25 0.0 1 0 1
8 0.0 7 0.0 0 0.0 1 0 1
4 1.0 60 0.0 3 1.0 2 0 0
3 1.0 4 1.0 3 1.0 2 0 0
2 1.0 3 1.0 5 1.0 2 0 0
5 1.0 2 1.0 0 0.0 2 0 0
3 1.0 4 1.0 40 0.0 2 0 0
40 0.0 50 0.0 3 1.0 2 0 1
30 0.0 3 1.0 50 0.0 2 0 1
5 0.0 3 1.0 4 1.0 2 0 1
80 0.0 70 0.0 60 0.0 0 0 1
60 0.0 80 0.0 90 0.02 0 0 1
90 0.02 60 0.0 75 0.0 0 0 1
3 1.0 20 0.0 25 0.0 2 0 1
5 1.0 90 0.0 60 0.0 2 0 1
4 1.0 8 0.0 12 0.0 2 0 1
4 1.0 90 0.0 3 1.0 2 0 0
5 1.0 3 1.0 80 0.0 2 0 0
3 1.0 70 0.0 4 1.0 2 0 0
4 1.0 4 1.0 70 0.0 2 0 0
3 1.0 90 0.0 60 0.0 -1 0 0
3 1.0 30 0.0 20 0.0 -1 0 0
70 0.0 80 0.0 90 0.0 -1 0 0
4 1.0 80 0.0 50 0.0 0 0 0
60 0.0 5 0.0 70 0.0 0 0 0
22 0.0 90 0.0 70 0.0 0 0 0
70 0.0 2 1.0 80 0.0 0 0 0
3 1.0 75 0.0 70 0.0 1 0 0
3 0.0 60 0.0 70 0.0 2 1 0
4 0.0 35 0.0 20 0.0 2 1 0
9 0.0 40 0.0 6 1.0 2 1 1
10 0.0 60 0.0 60 0.0 2 1 1
14 0.0 70 0.0 60 0.0 2 1 1
21 0.0 60 0.0 60 0.0 2 1 1
7 0.0 50 0.0 60 0.0 2 1 0
18 0.1 50 0.0 45 0.0 2 1 1
18 0.6 50 0.0 45 0.0 2 1 0
6 1.0 40 0.0 5 1.0 2 1 0
5 1.0 6 1.0 30 0.0 2 1 0
9 0.5 70 0.0 60 0.0 2 1 0
30 0.0 50 0.0 40 0.0 2 1 1
60 0.05 30 0.0 45 0.0 2 1 1
45 0.0 3 0.0 80 0.0 2 1 1
90 0.0 12 0.0 0 0.0 2 1 1
40 0.0 0 0.0 35 0.0 1 1 1
70 0.05 40 0.0 50 0.0 1 1 1
3 0.0 2 1.0 4 1.0 1 1 0
14 0.1 0 0.0 60 0.0 1 1 0
10 0.0 70 0.0 40 0.0 1 1 0
2 0.0 60 0.0 50 0.0 2 2 0
10 0.0 60 0.0 50 0.0 2 2 0
40 0.0 60 0.0 30 0.0 2 2 0
70 0.0 30 0.0 40 0.0 2 2 0
4 1.0 60 0.0 50 0.0 2 2 0
25 0.0 40 0.0 45 0.0 1 2 0
60 0.0 25 0.0 70 0.0 1 2 0
80 0.0 60 0.0 0 0.0 1 2 0
4 1.0 5 1.0 3 1.0 1 2 0
70 0.0 80 0.0 60 0.0 0 2 0
40 0.0 60 0.0 30 0.0 0 1 0
12 0.0 90 0.0 60 0.0 0 1 0
2 0.5 2 0.0 6 0.0 2 0 1
10 0.5 40 0.0 0 0.0 2 0 1
6 0.6 30 0.0 12 0.0 2 0 1
4 0.75 3 0.0 5 0.0 2 0 1
4 0.75 3 0.0 5 0.0 -1 0 0
10 0.5 40 0.0 60 0.0 -1 0 0
10 0.5 40 0.0 60 0.0 0 0 0
60 0.0 80 0.0 90 0.0 -1 0 0
60 0.0 80 0.0 100 0.0 -1 1 0
100 0.0 20 0.0 95 0.0 -1 0 0
90 0.0 90 0.0 100 0.0 -1 0 0
70 0.0 90 0.0 120 0.0 -1 0 0
1 0.0 40 0.0 0 0.0 2 0 1
2 0.0 1 1.0 1 0.0 2 0 1
4 1.0 90 0.0 80 0.0 2 0 1
3 1.0 70 0.0 70 0.0 2 0 1
4 1.0 60 0.0 50 0.0 2 0 1
60 0.0 5 1.0 80 0.05 -1 0 0
45 0.05 30 0.0 3 1.0 -1 0 0
50 0.0 60 0.0 40 0.1 -1 0 0
90 0.0 100 0.0 70 0.1 -1 0 0
120 0.0 90 0.0 80 0.0 0 0 1
150 0.0 100 0.0 60 0.0 0 0 1
60 0.05 80 0.0 70 0.0 0 0 1
70 0.0 4 1.0 3 1.0 0 0 0
"""


class DecisionTree:
    """Binary tree on numeric columns, grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8):
        self.root = self._grow(rows, labels, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or y.min() == y.max():
            return int(2 * y.sum() >= len(y))
        best = (np.inf, 0, 0.0)
        for column in range(x.shape[1]):
            values = np.unique(x[:, column])
            for cut in (values[1:] + values[:-1]) / 2:
                left = y[x[:, column] <= cut]
                right = y[x[:, column] > cut]
                gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (left, right))
                best = min(best, (round(gini, 9), column, float(cut)))
        if best[0] == np.inf:
            return int(2 * y.sum() >= len(y))
        below = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[below], y[below], depth - 1), self._grow(x[~below], y[~below], depth - 1)

    def __call__(self, row: tuple[float, ...]) -> int:
        node = self.root
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


def trained(labelled: str = LABELLED) -> DecisionTree:
    table = np.array([[float(v) for v in line.split()] for line in labelled.strip().splitlines()])
    # Words and densities come first, so that they win among equally good cuts.
    return DecisionTree(table[:, :8], table[:, 8])


def main_text(page: str, tree: DecisionTree) -> str:
    found = blocks(page)
    kept, none = [], Block("", 0, 0.0, 0, 0)
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        if tree((b.words, b.density, before.words, before.density, after.words, after.density, b.place, b.hint)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, labelled: str = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the main text, one block a line, and its code points.

    Null pages count as empty and give an empty text, as do pages without main text. Null ids and urls
    and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    tree = trained(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            text = pa.array([main_text(p, tree) for p in part.column("html").to_pylist()], pa.string())
            yield pa.record_batch([part.column("page_id"), part.column("url"), text], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    found = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, f"{kinds}, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: DuckDB SQL for pages that mark their article and nest nothing else in it, as those of ``pages`` do.
EXTRACT_SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
parts AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(a, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) AS p FROM inner_html),
decoded AS (
  SELECT page_id, url, list_filter(list_transform(p, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS p
  FROM parts)
SELECT page_id, url, coalesce(array_to_string(p, chr(10)), '') AS text, length(coalesce(array_to_string(p, chr(10)), ''))::BIGINT AS n_chars FROM decoded
"""
