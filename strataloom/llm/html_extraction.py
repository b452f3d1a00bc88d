"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf tag path. Text length and punctuation are aggregated per
path, both ratios are smoothed along the page and fused, and a threshold over the fused scores selects content
paths. Where the page marks its article, the scores choose among the marked elements, and inside them drop paths of
links below the threshold; otherwise the selected paths and what stands among them are the content. Elements that are menus,
forms, adverts or the like by their tag take no part; those that are so by their name only where the name says nothing
else, and never one that holds most of the page's text (reader comments excepted, as long as other text is left).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import accumulate
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element kinds of HTML that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style button textarea title noscript template iframe noframes noembed xmp svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
BOILERPLATE = frozenset("head nav footer aside form menu dialog".split())
MARKED = frozenset("article main".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Words in class, id and role that name page furniture, and words that may stand beside them.
FURNITURE = re.compile(
    r"ads?|adv|advert\w*|ad(?:box|slot|unit|banner|space)|sponsor\w*|promo\w*|banner|nav|navbar|navigation|(?:main|top|side|sub)?menu|breadcrumbs?|"
    r"sidebar|(?:top|tool)bar|footer|cookies?|consent|notices?|alerts?|related|recommend\w*|share|sharing|social|newsletter|subscribe\w*|signup|login|"
    r"popup|modal|search|pagination|pager|tags|complementary|contentinfo|masthead"
)
COMMENTS = re.compile(r"comments?(?:list|s?area|box|thread|section|wrap(?:per)?)?|respond|replies|disqus\w*")
BESIDE = re.compile(
    r"\d*|site|page|pop|up|side|bar|top|bottom|left|right|main|post|posts|article|articles|entry|area|box|list|section|container|wrap|wrapper|widget|block|panel|links?|items?|inner|outer|"
    r"content|form|buttons?|icons?|group|row|col|column|fixed|sticky|mobile|desktop|global|primary|secondary|header|slot|unit|space|stories|story|news|this|us|the|id|js|ui|text|message|thread"
)
PAGE_HEADER = re.compile(r"(?:site-|page-|top-)?header")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
HUMP = re.compile("(?<=[a-z])(?=[A-Z])")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
HEADING = re.compile("h[1-6]")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

SMOOTHING = (0.25, 0.5, 0.25)
SIBLING = 0.3
"""A marked element beside the best one is content too if its mean score is at least the threshold and this share of the best."""
PLAIN, FURNISHED, COMMENTED, HARD = range(4)


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case and decoded values; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def named_kind(words: list[str]) -> int:
    """What the words of class, id and role say of an element: a word counts if all of its parts name furniture or may stand beside it."""
    kind = PLAIN
    for word in words:
        parts = [p for p in word.split("-") if p]
        if all(COMMENTS.fullmatch(p) or FURNITURE.fullmatch(p) or BESIDE.fullmatch(p) for p in parts):
            if any(COMMENTS.fullmatch(p) for p in parts):
                return COMMENTED
            if any(FURNITURE.fullmatch(p) for p in parts) or "side-bar" in word or "pop-up" in word:
                kind = FURNISHED
    return kind


class Block:
    """A run of text: the tag and number of its innermost element, its path's number, and how much of it is links."""

    __slots__ = ("element", "links", "path", "tag", "text")

    def __init__(self, tag: str, path: int, element: int, text: str, links: int):
        self.tag, self.path, self.element, self.text, self.links = tag, path, element, text, links


class Tree:
    """A page's elements, numbered from 1 as they open (0 is the page), with what lies inside them as a range of numbers."""

    def __init__(self):
        self.parent, self.last, self.tag = [0], [0], [""]

    def open(self, parent: int, tag: str) -> int:
        self.parent.append(parent)
        self.last.append(len(self.last))
        self.tag.append(tag)
        return len(self.last) - 1

    def holds(self, outer: int, element: int) -> bool:
        return outer <= element <= self.last[outer]

    def within(self, outer) -> Callable[[int], bool]:
        """Whether an element lies in any of these."""
        tops: list[int] = []
        for n in sorted(outer):
            if not tops or n > self.last[tops[-1]]:
                tops.append(n)
        return lambda element: (k := bisect_right(tops, element)) > 0 and element <= self.last[tops[k - 1]]

    def around(self, elements: list[int]) -> int:
        """The innermost element that holds all of these."""
        low, high = min(elements), max(elements)
        n = low
        while self.last[n] < high:
            n = self.parent[n]
        return n


def blocks_of(page: str) -> tuple[list[Block], list[int], Tree]:
    """Text blocks outside boilerplate, in page order, the elements that mark an article, outer ones first, and all elements.

    Paths are numbered by their parent path and last step, and elements by a tree, so work and memory follow the page's
    length at any depth.
    """
    blocks: list[Block] = []
    marked: list[int] = []
    named: dict[int, int] = {}
    tree, paths, held = Tree(), {}, Counter()  # held: open elements by tag
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]  # tag, element, boilerplate above or here, path, a mark above or here
    parts: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not stack[-1][2]:
                blocks.append(Block(stack[-1][0], stack[-1][3], stack[-1][1], text, links))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        flush()
        for tag, element, *_ in stack[k:]:
            tree.last[element] = len(tree.last) - 1
            held[tag] -= 1
        del stack[k:]

    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not stack[-1][2]:
            parts.append(text)
            links += in_link and len(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                in_link = 0
            elif tag not in INLINE and tag not in VOID:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0) if held[tag] else 0
                close(k) if k else flush()
            continue
        attributes = found[3]
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in VOID or tag in INLINE:
            if tag == "hr":
                flush()
        else:
            flush()
            if tag in CLOSES and any(held[t] for t in CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in CLOSES[tag]:
                        close(k)
                        break
                    if stack[k][0] in SCOPES.get(tag, ()):
                        break
            elif tag not in CLOSES and stack[-1][0] == "p":
                close(len(stack) - 1)
            number = tree.open(stack[-1][1], tag)
            own = attributes_of(attributes) if attributes.strip() else {}
            words = HUMP.sub("-", " ".join(own[k] for k in ("class", "id", "role") if k in own)).replace("_", "-").lower().split()
            junk = stack[-1][2] or tag in BOILERPLATE or own.get("hidden", "false").lower() != "false" or own.get("aria-hidden", "").lower() == "true" or bool(HIDING.search(own.get("style", "")))
            inside = stack[-1][4]
            kind = named_kind(words) if words and tag not in ("html", "body") else PLAIN
            if not inside and tag not in MARKED and (tag == "header" or any(PAGE_HEADER.fullmatch(w) for w in words)):
                kind = max(kind, FURNISHED)
            if kind and not junk:
                named[number] = kind
            if tag in MARKED or (not inside and "articlebody" in own.get("itemprop", "").lower().split()):
                marked.append(number)
            path = paths.setdefault((stack[-1][3], tag, " ".join(words)), len(paths) + 1)
            stack.append((tag, number, junk, path, inside or tag in MARKED))
            held[tag] += 1
    close(1)
    tree.last[0] = len(tree.last) - 1
    return without_furniture(blocks, named, tree), marked, tree


def without_furniture(blocks: list[Block], named: dict[int, int], tree: Tree) -> list[Block]:
    """The blocks outside elements that are furniture by name, of which none holds most of the text."""
    for kind in (COMMENTED, FURNISHED):
        gone = {n for n, k in named.items() if k == kind}
        if kind == FURNISHED and gone:
            mass = [0] * (len(tree.last) + 1)  # of the text in elements before each
            for b in blocks:
                mass[b.element + 1] += len(b.text) - b.links
            mass = list(accumulate(mass))
            gone = {n for n in gone if 2 * (mass[tree.last[n] + 1] - mass[n]) < mass[-1]}
        inside = tree.within(gone)
        left = [b for b in blocks if not inside(b.element)] if gone else blocks
        blocks = left or blocks
    return blocks


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Smoothed and fused text and punctuation ratios of each tag path."""
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    count: dict[int, int] = {}
    for b in blocks:
        length[b.path] = length.get(b.path, 0) + max(0, len(b.text) - b.links)
        marks[b.path] = marks.get(b.path, 0) + (len(PUNCTUATION.findall(b.text)) if b.links < len(b.text) else 0)
        count[b.path] = count.get(b.path, 0) + 1
    fused = [1.0] * len(blocks)
    for totals in (length, marks):
        row = [totals[b.path] / count[b.path] for b in blocks]
        padded = [row[0], *row, row[-1]]
        smooth = [sum(w * padded[i + k] for k, w in enumerate(SMOOTHING)) for i in range(len(row))]
        most = max(smooth) or 1.0
        fused = [f * s / most for f, s in zip(fused, smooth)]
    scores: dict[int, float] = {}
    for b, f in zip(blocks, fused):
        scores[b.path] = scores.get(b.path, 0.0) + f / count[b.path]
    return scores


def chosen_marks(blocks: list[Block], marked: list[int], tree: Tree, scores: dict[int, float], least: float) -> list[int]:
    """The marked elements that are content: an inner one stands for an outer one if what it leaves out scores below the threshold."""
    order = sorted(range(len(blocks)), key=lambda k: blocks[k].element)
    numbers = [blocks[k].element for k in order]
    span = {m: slice(bisect_left(numbers, m), bisect_right(numbers, tree.last[m])) for m in marked}
    marked = [m for m in marked if span[m].start < span[m].stop]  # those with text
    inner: dict[int, list[int]] = {m: [] for m in marked}
    outer, open_ = [], []
    for m in marked:
        while open_ and not tree.holds(open_[-1], m):
            open_.pop()
        (inner[open_[-1]] if open_ else outer).append(m)
        open_.append(m)
    found, left = [], outer[::-1]
    while left:
        m = left.pop()
        apart = tree.within(inner[m])
        held = [blocks[k] for k in order[span[m]]]
        if not inner[m] or any(scores[b.path] >= least and not HEADING.fullmatch(b.tag) and not apart(b.element) for b in held):
            found.append(m)
        else:
            left += inner[m][::-1]
    if not found:
        return []
    texts = {m: [blocks[k] for k in order[span[m]]] for m in found}
    weight = {m: sum(scores[b.path] * len(b.text) for b in texts[m]) for m in found}
    best = max(found, key=lambda m: (weight[m], -m))
    mean = {m: weight[m] / sum(len(b.text) for b in texts[m]) for m in found}
    return [m for m in found if m == best or mean[m] >= max(least, SIBLING * mean[best])]


def main_text(page: str | None) -> str:
    """The article of one page: white space inside a block as one space, blocks joined by newlines."""
    blocks, marked, tree = blocks_of(page or "")
    if not blocks:
        return ""
    scores = path_scores(blocks)
    least = min(pstdev(scores.values()), max(scores.values()))
    linked: dict[int, int] = {}
    for b in blocks:
        linked[b.path] = linked.get(b.path, 0) + 2 * b.links - len(b.text)
    content = lambda b: scores[b.path] >= least or linked[b.path] < 0 or bool(HEADING.fullmatch(b.tag))
    marks = chosen_marks(blocks, marked, tree, scores, least)
    if marks:
        inside = tree.within(marks)
        chosen = [b for b in blocks if inside(b.element)]
        if not any(b.tag == "h1" for b in chosen):  # a headline that stands above its article, inside a mark around both
            near = tree.within(m for m in marked if any(tree.holds(m, n) for n in marks))
            chosen = [b for b in blocks if inside(b.element) or (b.tag == "h1" and near(b.element))]
        return "\n".join(b.text for b in [b for b in chosen if content(b)] or chosen)
    hits = [k for k, b in enumerate(blocks) if scores[b.path] >= least]
    parents = [tree.parent[blocks[k].element] for k in hits]
    root = tree.around([blocks[k].element for k in hits])
    if all(blocks[k].element == root for k in hits):  # a single block of text: what holds it
        root = tree.parent[root]
    every = tree.around([b.element for b in blocks])
    homes = tree.within({n for n in parents if n >= max(root, 1) and not tree.holds(n, every)})
    first = hits[0]
    while first and HEADING.fullmatch(blocks[first - 1].tag) and heads(tree, root, blocks[first - 1].element, blocks[hits[0]].element):
        first -= 1
    near = lambda k, b: k < hits[0] and k >= first or tree.holds(root, b.element) and (first <= k <= hits[-1] or homes(b.element))
    return "\n".join(b.text for k, b in enumerate(blocks) if scores[b.path] >= least or (near(k, b) and content(b)))


def heads(tree: Tree, root: int, heading: int, text: int) -> bool:
    """Whether a heading belongs to a text that follows it: it stands in the content's element, or beside what holds it (the page itself apart)."""
    beside = tree.parent[heading]
    return tree.holds(root, heading) or (tree.tag[beside] not in ("", "html", "body") and tree.holds(beside, text))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with its id, url, text and n_chars (code points).

    Null or empty html, or a page without content, gives an empty text. Pages are read whole; repeated rows and
    rows without id or url are extracted like any other. Other columns are not read. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(a, 512)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(run, schema)
