"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A logistic classifier over what speaks for and against each block (length, links, ending,
tag) gives log-odds, to which containers and names around the block add theirs; they become the capacities to the two terminals. Blocks that are neighbours on
the page, or close in the document tree, are joined by smoothness edges. The minimum cut, found by maximum flow,
labels all blocks at once. The classifier is fitted on a bounded sample of the pages themselves, whose containers and names give the labels. Nothing of a block depends on how
deep it stands, so plain containers around a page change nothing. Spark deals out the pages; a task holds one page's blocks at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import about

#: Fixed values of HTML: elements without an end, elements whose content is no markup, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's.
NEVER = frozenset("head nav footer aside form button select menu dialog svg math object map datalist search".split())
#: Words in a class, an id or a role that speak of something beside the article, and of the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|masthead|topbar|"
    r"footer|foot|copyright|sidebar\w*|side|aside|rail|widget\w*|related|recommend\w*|share|sharing|social|comments?|commentlist|"
    r"disqus|replies|reply|respond|notice\w*|cookie\w*|consent|gdpr|alert|popup|modal|overlay|toolbar|pagination|pager|subscribe|"
    r"newsletter|signup|login|search\w*|tags|skip|legal|disclaimer|contentinfo|navigation|complementary)(?=$|[\s_-])",
    re.I,
)
#: Words that speak so outside the article only: there they name the page's head, inside it the article's.
HEAD = re.compile(r"(?:^|[\s_-])(?:header|head|banner)(?=$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|reply|replies)(?=$|[\s_-])", re.I)
WITHIN = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|maincontent|prose|text|body)(?=$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Units of a capacity, and one that no cut pays: only the elements in NEVER have it.
UNIT, NO_CUT = 16, 1 << 30
#: Inputs of the classifier, all between 0 and 1 and blind to plain containers around a block, and the weights that hold before any page was seen.
#: A weight is fitted on its own side of 0 (free where it is 0), so no sample turns what an input speaks for.
PRIOR = {
    "log_words": 4.4, "link_share": -4.0, "ends_sentence": 1.0, "heading": 1.0, "cell": -1.0, "copyright": -3.0, "capitals": 0.0, "digits": 0.0, "one": -2.0,
}
_FREE = ("capitals", "digits", "one")
#: What a container of the article adds, and what is left of a name beside the article after all else: more than its neighbours' edges can pay.
WITHIN_GAIN, BESIDE_LEFT = 12.0, 6.0
#: Bounds of the sample that the classifier is fitted on: pages, characters of a page, blocks; and how many blocks the sample counts for beside the prior.
FIT_PAGES, FIT_CHARS, FIT_BLOCKS, EVIDENCE = 400, 100_000, 20_000, 200.0


@dataclass
class Block:
    """A run of text between block boundaries, and where it stands."""

    text: str
    linked: int
    tag: str
    path: tuple[int, ...]
    never: bool
    beside: bool
    within: bool


@dataclass
class _Open:
    tag: str
    number: int
    never: bool
    beside: bool
    within: bool


@dataclass
class _Walk:
    """The open elements, and the text since the last boundary."""

    opened: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    count: int = 0
    blocks: list[Block] = field(default_factory=list)

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.linked += len(text.strip())

    def cut(self) -> None:
        """End the block; text of elements that are never the article's is kept too, and labelled by its place."""
        text = " ".join(entities.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            top = self.opened[-1] if self.opened else _Open("", 0, False, False, False)
            tag = next((o.tag for o in reversed(self.opened) if o.tag in BLOCK), "")
            path = tuple(o.number for o in self.opened if o.tag in BLOCK)
            self.blocks.append(Block(text, self.linked, tag, path, top.never, top.beside, top.within))
        self.parts, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.cut()
            if tag in ("p", "li", "td", "th", "tr", "option", "dt", "dd"):
                self._close_like(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        self.count += 1
        up = self.opened[-1] if self.opened else _Open("", 0, False, False, False)
        named = " ".join(filter(None, (x for m in _NAMED.finditer(attributes) for x in m.groups()))) if attributes else ""
        root = tag in ("html", "body", "main")
        within = up.within or tag in ("article", "main") or bool(named and WITHIN.search(named) and tag != "body")
        never = up.never or tag in NEVER or (tag == "header" and not up.within)
        words = named if not root else ""
        beside = up.beside or bool(words and (COMMENT if tag == "article" else BESIDE).search(words))
        beside = beside or bool(words and tag != "article" and not up.within and HEAD.search(words))
        self.opened.append(_Open(tag, self.count, never, beside, within))
        self.links += tag == "a"

    def _close_like(self, tag: str) -> None:
        """An open paragraph, item or cell ends where the next begins, unless a container stands between."""
        for i in range(len(self.opened) - 1, -1, -1):
            open_ = self.opened[i].tag
            if open_ == tag:
                self._drop(i)
                return
            if open_ in BLOCK and open_ not in ("p", "dt", "dd"):
                return

    def _drop(self, i: int) -> None:
        self.links -= sum(o.tag == "a" for o in self.opened[i:])
        del self.opened[i:]

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        for i in range(len(self.opened) - 1, -1, -1):
            if self.opened[i].tag == tag:
                self._drop(i)
                return
            if tag not in BLOCK and self.opened[i].tag in BLOCK:
                return


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; scripts, styles and comments have none."""
    walk, at = _Walk(), 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            walk.say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes, ended = m[1], m[2], m[3] or "", m[4]
        if tag is None:
            closing, tag, ended = m[5], m[6], m[7]
            if tag is None:
                continue
        if not ended:  # the page breaks off within a tag
            break
        tag = tag.lower()
        if closing:
            walk.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        else:
            walk.start(tag, attributes)
            if attributes.endswith("/") and tag not in BLOCK and tag not in VOID:
                walk.end(tag)
    if at < len(page):
        walk.say(page[at:] if m is None else "")
    walk.cut()
    return walk.blocks


def inputs(block: Block) -> list[float]:
    """What the classifier sees of a block, in the order of PRIOR."""
    text = block.text
    words, size = text.count(" ") + 1, len(text)
    return [
        min(float(np.log1p(words)), 4.0) / 4, min(1.0, block.linked / size), float(text[-1] in ".!?…:\"'”»)"),
        float(block.tag in ("h1", "h2", "h3", "h4", "blockquote", "pre", "figcaption")), float(block.tag in ("li", "td", "th")),
        float("©" in text), sum(map(str.isupper, text[:400])) / min(size, 400), sum(map(str.isdigit, text[:400])) / min(size, 400), 1.0,
    ]


def known_label(block: Block) -> int:
    """1 in an article, 0 in what an element or a name sets beside it, -1 where neither says so."""
    return 0 if block.never or block.beside else 1 if block.within else -1


def fit(x: np.ndarray, y: np.ndarray, spread: float = 3.0, steps: int = 60) -> np.ndarray:
    """Weights of a logistic classifier by Newton's method, with a normal prior around PRIOR of width ``spread``.

    All rows together count for EVIDENCE blocks at most, so that a large sample that a plane can part does not drive the weights off. A weight that would cross 0
    stays there. Names and containers are no inputs: they make the labels. Without rows the prior stands.
    """
    middle = np.array(list(PRIOR.values()))
    if not len(y):
        return middle
    share, y = min(1.0, EVIDENCE / len(y)), y.astype(float)
    side = np.where([k in _FREE for k in PRIOR], 0, np.sign(middle))
    w = middle.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = share * (x.T @ (p - y)) + (w - middle) / spread**2
        stuck = (side != 0) & (w == 0) & (slope * side > 0)
        bend = share * (x.T * (p * (1 - p))) @ x + np.eye(len(w)) / spread**2
        move = np.zeros(len(w))
        move[~stuck] = np.linalg.solve(bend[~stuck][:, ~stuck], slope[~stuck])
        w = w - move * min(1.0, 3.0 / max(float(np.abs(move).max()), 1e-12))
        w = np.where((side != 0) & (w * side < 0), 0.0, w)
        if np.abs(move).max() < 1e-8:
            break
    return w


def costs(block: Block, weights: np.ndarray) -> tuple[int, int]:
    """What it costs to call a block boilerplate, and to call it content: its log-odds, in units of a capacity.

    A container of the article adds to them; a name beside the article takes away all that could speak for the block, its neighbours among it.
    """
    if block.never:
        return 0, NO_CUT
    odds = float(np.dot(inputs(block), weights)) + WITHIN_GAIN * block.within
    if block.beside:
        odds = min(odds, 0.0) - BESIDE_LEFT
    units = round(UNIT * odds)
    return max(units, 0), max(-units, 0)


def smoothness(row: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, capacity): neighbours on the page by their distance in the tree, and next blocks of one parent."""
    edges, last = [], {}
    for j, b in enumerate(row):
        if j:
            a = row[j - 1].path
            same = next((k for k, (x, y) in enumerate(zip(a, b.path, strict=False)) if x != y), min(len(a), len(b.path)))
            edges.append((j - 1, j, round(UNIT * 2 / (1 + len(a) + len(b.path) - 2 * same))))
        parent = b.path[:-1]
        if parent in last and last[parent] != j - 1:
            edges.append((last[parent], j, UNIT // 2))
        last[parent] = j
    return edges


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (the smallest such set).

    ``terminals``: capacities from the source and to the sink of each node; ``edges``: capacities in both directions.
    Nodes whose terminals outweigh all that joins them are settled first, and hand what joins them to their neighbours.
    The rest is solved by shortest augmenting paths.
    """
    n = len(terminals)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    gain = [s - t for s, t in terminals]
    side: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:
        i = work.popleft()
        if side[i] is None and abs(gain[i]) > (joined := sum(near[i].values())) or (side[i] is None and not joined):
            side[i] = gain[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                gain[j] += c if side[i] else -c
                if side[j] is None:
                    work.append(j)
            near[i] = {}
    source, sink = n, n + 1
    flow: dict[int, dict[int, int]] = {i: dict(near[i]) for i in range(n) if side[i] is None}
    flow[source], flow[sink] = {}, {}
    for i in range(n):
        if side[i] is None and gain[i] > 0:
            flow[source][i], flow[i][source] = gain[i], 0
        elif side[i] is None and gain[i] < 0:
            flow[i][sink], flow[sink][i] = -gain[i], 0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            break
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        least = min(flow[i][j] for i, j in path)
        for i, j in path:
            flow[i][j] -= least
            flow[j][i] = flow[j].get(i, 0) + least
    return [i in came if s is None else s for i, s in enumerate(side)]


def main_text(page: str, weights: np.ndarray | None = None) -> str:
    """The blocks labelled content, one to a line; without ``weights`` by those of PRIOR."""
    row = blocks(page)
    weights = np.array(list(PRIOR.values())) if weights is None else weights
    content = minimum_cut([costs(b, weights) for b in row], smoothness(row))
    return "\n".join(b.text for b, keep in zip(row, content, strict=True) if keep)


def fit_on(pages: DataFrame, max_pages: int = FIT_PAGES, max_chars: int = FIT_CHARS, max_blocks: int = FIT_BLOCKS) -> np.ndarray:
    """Weights fitted on blocks whose containers say what they are, of the ``max_pages`` pages with the smallest hashes, whatever their order in the table."""
    some = pages.filter(about(2 * max_pages, pages.count(), "page_id", "url"))
    chosen = some.filter(F.length("html").between(1, max_chars)).orderBy(F.xxhash64("page_id", "url"), F.xxhash64("html")).limit(max_pages).select("html")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(inputs(b), y) for h in batch.column("html").to_pylist() for b in blocks(h) if (y := known_label(b)) >= 0]
            yield pa.record_batch([pa.array([k[0] for k in known], pa.list_(pa.float64())), pa.array([k[1] for k in known], pa.int32())], ["x", "y"])

    rows = chosen.mapInArrow(look, "x array<double>, y int").orderBy(F.xxhash64("x"), "x", "y").limit(max_blocks).collect()
    return fit(np.array([r.x for r in rows], float).reshape(-1, len(PRIOR)), np.array([r.y for r in rows]))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars (code points).

    Without ``weights`` the classifier is fitted on a sample of ``pages``.

    Null or empty html, and a page of boilerplate alone, give an empty text. Nulls in the other columns stay nulls;
    repeated rows keep their rows; columns beside page_id, url and html are not read; an empty table returns none.
    Pages that break off, or whose elements are not closed, are read as far as they go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [main_text(h or "", weights) for h in part.column("html").to_pylist()]
                yield pa.record_batch(
                    [
                        part.column("page_id"), part.column("url"), pa.array(found, pa.string()),
                        pa.array(list(map(len, found)), pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    weights = fit_on(rows) if weights is None else weights
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
