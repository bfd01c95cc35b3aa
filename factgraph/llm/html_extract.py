"""Main text of web pages by composite text density of DOM nodes.

A page is tokenised once into a tree of elements. Left out, with all they hold, are elements that are boilerplate by their kind
or ARIA role (navigation, headers and footers of the page, asides, forms, scripts, styles, ...) or by name: a class or id all of
whose parts are words of HINTS or NEUTRAL, one of HINTS at least (`sidebar-left`, but not `related-work`), unless the element
also names content, holds an article or main element, or holds LARGE of the text around it; and blocks of reader comments that
a heading of COMMENTS opens.

Every other block-level node gets its composite density: characters per tag (inline tags other than links count as text),
weighed by the logarithm of its text to link proportions, whose base depends on the page's own proportions. The sum of the densities of a node's children is its density sum. From the node
with the largest sum, the least density on the path up to body is the threshold; in every node that reaches it, the subtree of
largest density sum is content. Headings in front of it that hang on that path are content too; blocks that hold nothing but
links (MENU of them or more) are not. Where article elements (else main) hold at least SCOPE of the text, densities count only
what lies in them, and short paragraphs, headings and lists that hang on the path are content as well.

White space is [\\x20\\x09-\\x0D]. Text is split into blocks at block-level elements and line breaks.

Nulls: a null html is an empty page, and a page without main text gives the empty string. Markup that is broken, cut off or
nested very deeply is read as far as it goes; very long pages are read whole. Ties of density sums go to the node with more
text, then to the first. Rows are read one by one, so repeated rows give equal results, and an empty table gives none; columns
other than the named ones play no part (a column main_text of the input is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import common
from factgraph.llm.textkernel import slices

# Element kinds of HTML, and words in class, id and role that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())  # fmt: skip
CLOSES_P = BLOCK - frozenset("br body button caption col colgroup head html legend option optgroup select tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these kinds (up to an element of the second list).
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select optgroup"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
BOILERPLATE = frozenset("head nav footer aside form menu dialog noscript template svg math canvas object audio video select button script style textarea title xmp noembed noframes iframe search".split())
NEVER = frozenset("html body article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors cookie cookies consent gdpr popup modal newsletter "
    "subscribe subscription signup sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus replies respond "
    "share sharing social related recommended recommendations pagination pager login".split())  # fmt: skip
WEAK_HINTS = frozenset("header masthead banner promo promotion alert notice notices notification disclaimer announcement search toolbar widget".split())
#: Words that say where or in what shape a named element stands, not what it holds.
NEUTRAL = WEAK_HINTS | frozenset(
    "left right top bottom upper lower center side inner outer site page global mobile desktop primary secondary wrapper wrap container box block section area region zone slot unit bar panel "
    "list item items row col column group module body link links button buttons icon icons media text title heading form reader readers user users thread count posts stories articles news "
    "policy banner overlay dropdown toggle first last odd even the and by for".split())  # fmt: skip
#: Headings that open reader comments, in the languages of the rules.
COMMENTS = frozenset((
    "comments", "comment", "reader comments", "user comments", "readers comments", "leave a comment", "leave a reply", "post a comment", "join the discussion",
    "kommentare", "leserkommentare", "commentaires", "commentaires des lecteurs", "comentarios", "comentarios de los lectores"))
#: Share of the text around it from which an element is not left out for its name; of the text, from which article or main elements are all that counts.
LARGE, SCOPE = 0.9, 0.5
MENU = 3
CONTENT_HINTS = frozenset("article content entry post story main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WHITE = re.compile(r"[\x20\x09-\x0d]+")
_NAMES = re.compile(r"[a-z]+|[0-9]+")
_LABEL = re.compile(r"[^\W\d_]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p ul ol dl blockquote pre table figure figcaption hgroup details address".split())


def _named(value: str, weak: bool) -> bool:
    """Whether one of the names in a class or id value says boilerplate: all its parts are hints, neutral, numbers or, beside a hint,
    the kind of text it belongs to (`post-comments`). weak: words of WEAK_HINTS are hints as well, if no kind of text is beside."""
    for name in value.split():
        parts = _NAMES.findall(name)
        plain = [x for x in parts if x not in CONTENT_HINTS]
        if all(x in HINTS or x in NEUTRAL or x.isdigit() for x in plain):
            if any(x in HINTS for x in plain) or (weak and len(plain) == len(parts) and any(x in WEAK_HINTS for x in plain)):
                return True
    return False


def _is_boilerplate(tag: str, attributes: str, inside: bool) -> bool | None:
    """None: only by its class or id, so that what the element holds decides. inside: it stands in an article or main element."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not attributes or tag in NEVER:
        return False
    hinted = content = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if name in ("class", "id"):
            hinted = hinted or _named(value, not inside)
            content = content or not CONTENT_HINTS.isdisjoint(value.split())
    return None if hinted and not content else False


class Tree:
    """Elements in page order: parent, tag; runs: (element, text) in page order, where text None is a block boundary."""

    def __init__(self, html: str):
        self.parent, self.tag, self.last = [-1], ["body"], [0]
        self.runs: list[tuple[int, str | None]] = []
        self.hinted: list[int] = []  # elements that HINTS name
        self._stack, self._open = [0], {}
        self._skip_depth = 0  # stack height from which all is left out, or 0
        self._inside = 0  # open article and main elements
        self._read(html)
        while len(self._stack) > 1:
            self._pop()

    def _pop(self) -> None:
        node = self._stack.pop()
        tag = node if isinstance(node, str) else self.tag[node]
        self._open[tag] -= 1
        self._inside -= tag in ("article", "main")
        if len(self._stack) < self._skip_depth:
            self._skip_depth = 0
        if tag in BLOCK and not self._skip_depth:
            self.runs.append((0, None))

    def _tag_at(self, k: int) -> str:
        node = self._stack[k]
        return node if isinstance(node, str) else self.tag[node]

    def _close(self, tags: frozenset[str], until: frozenset[str]) -> None:
        """Ends the open elements from the outermost one of `tags` that lies inside the innermost one of `until`."""
        if not any(self._open.get(t) for t in tags):
            return
        first = 0
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._tag_at(k)
            if tag in until:
                break
            if tag in tags:
                first = k
        while first and len(self._stack) > first:
            self._pop()

    def _end(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        if tag not in BLOCK:  # an inline end tag ends nothing outside its block
            k = len(self._stack) - 1
            while k and self._tag_at(k) != tag:
                if self._tag_at(k) in BLOCK:
                    return
                k -= 1
        while self._tag_at(-1) != tag:
            self._pop()
        self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in CLOSES_P and self._open.get("p"):
            self._close(frozenset("p"), frozenset(("button", "td", "th", "table", "object")))
        if tag in VOID:
            if not self._skip_depth:
                if tag in BLOCK:
                    self.runs.append((0, None))
                self._add(tag)
            return
        self._open[tag] = self._open.get(tag, 0) + 1
        named = False if self._skip_depth else _is_boilerplate(tag, attributes, self._inside > 0)
        if named:
            self._skip_depth = len(self._stack) + 1
            self.runs.append((0, None))
        self._inside += tag in ("article", "main")
        if self._skip_depth:
            self._stack.append(tag)
            return
        if tag in BLOCK:
            self.runs.append((0, None))
        self._stack.append(self._add(tag))
        if named is None:
            self.hinted.append(self._stack[-1])
            self.runs.append((self._stack[-1], ""))  # a boundary if the element goes

    def _add(self, tag: str) -> int:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if not self._skip_depth and (stop := m.start() if m else n) > at:
                self.runs.append((self._stack[-1], html[at:stop]))
            if not m:
                break
            at = m.end()
            if m[2] is None or not m[4]:  # a comment, a declaration, broken markup, or a tag that the end cuts off
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not self._open.get("p") and not self._skip_depth:
                    self.runs.append((0, None))
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else n


def _gone(tree: Tree, runs: list[tuple[int, str | None]]) -> list[bool]:
    """Of each element, whether it or one above it is left out for a word of HINTS."""
    n = len(tree.tag)
    gone = [False] * n
    if not tree.hinted:
        return gone
    size, holds, around = [0] * n, [t in ("article", "main") for t in tree.tag], [0] * n
    for k in range(1, n):
        around[k] = tree.parent[k] if holds[tree.parent[k]] else around[tree.parent[k]]
    for k, text in runs:
        if text:
            size[k] += len(text) - sum(map(len, _WHITE.findall(text)))
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
        holds[k] = holds[k] and size[k] > 0
        holds[tree.parent[k]] |= holds[k]
    for k in tree.hinted:
        large = size[k] and size[k] >= LARGE * size[around[k]] and (around[k] or not holds[0])  # most of what there is, so no mere part
        gone[k] = not (holds[k] or large)
    for k in range(1, n):
        gone[k] = gone[k] or gone[tree.parent[k]]
    return gone


def _comments(tree: Tree, runs: list[tuple[int, str | None]], gone: list[bool]) -> None:
    """Marks the blocks of reader comments that a heading opens: the heading's parent if the heading is its first text, else
    the heading and what follows it up to the next heading of its rank."""
    tag, parent = tree.tag, tree.parent
    label: dict[int, str] = {}
    first: dict[int, int] = {}  # of each element, the element of its first text
    for k, text in runs:
        if text and not gone[k] and text.strip():
            up = k
            while up >= 0 and up not in first:
                first[up], up = k, parent[up]
            up = k
            while up > 0 and tag[up] not in HEADINGS:
                up = parent[up]
            if up > 0:
                label[up] = label.get(up, "") + text
    found = [k for k, text in label.items() if len(text) < 60 and " ".join(_LABEL.findall(text.lower())) in COMMENTS]
    for k in found:
        up, at = parent[k], first[parent[k]]
        while at > k:
            at = parent[at]
        if up and tag[up] not in NEVER and at == k:
            gone[up] = True
            continue
        gone[k] = True
        for x in range(k + 1, len(tag)):
            if parent[x] == up:
                if tag[x] in HEADINGS and tag[x] <= tag[k]:
                    break
                gone[x] = True
    if found:
        for k in range(1, len(tag)):
            gone[k] = gone[k] or gone[parent[k]]


def _scope(tree: Tree, chars: list[int]) -> list[int]:
    """The outermost article elements if they hold SCOPE of the text, else main elements that do, else none."""
    for kind in ("article", "main"):
        under, roots = [False] * len(tree.tag), []
        for k in range(1, len(tree.tag)):
            under[k] = under[tree.parent[k]] or tree.tag[tree.parent[k]] == kind
            if tree.tag[k] == kind and not under[k] and chars[k]:
                roots.append(k)
        if roots and sum(chars[k] for k in roots) >= SCOPE * chars[0]:
            return roots
    return []


class Measures:
    """Characters, tags, link characters and link tags of every subtree, without what is gone."""

    def __init__(self, tree: Tree, runs: list[tuple[int, str | None]], gone: list[bool]):
        n, tag, parent = len(tree.tag), tree.tag, tree.parent
        link = [False] * n
        for k in range(1, n):
            link[k] = tag[k] == "a" or link[parent[k]]
        self.chars, self.link_chars, self.links = [0] * n, [0] * n, [0] * n
        self.tags = [int(not x and (t in BLOCK or t == "a")) for x, t in zip(gone, tag, strict=True)]
        for k, text in runs:
            if text and not gone[k] and (size := len(text) - sum(map(len, _WHITE.findall(text)))):
                self.chars[k] += size
                self.link_chars[k] += size if link[k] else 0
        for k in range(n - 1, 0, -1):
            up = parent[k]
            self.chars[up] += self.chars[k]
            self.tags[up] += self.tags[k]
            self.link_chars[up] += self.link_chars[k]
            self.links[up] += self.links[k] + (tag[k] == "a" and not gone[k])

    def densities(self) -> list[float]:
        page = self.link_chars[0] / self.chars[0]
        out = [0.0] * len(self.chars)
        for k, c in enumerate(self.chars):
            if c:
                t, lc, lt = max(self.tags[k], 1), self.link_chars[k], self.links[k]
                base = log(c / max(c - lc, 1) * lc + page * c + e)
                out[k] = c / t * (log(max(c / max(lc, 1) * (t / max(lt, 1)), 1.0)) / log(base) if base > 1 + 1e-9 else log(max(c * t, e)))
        return out


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order, joined by one space; empty if there is none."""
    if not html:
        return ""
    tree = Tree(html)
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    runs = [(k, None if t is None else unescape(t) if "&" in t else t) for k, t in tree.runs]
    gone = _gone(tree, runs)
    _comments(tree, runs, gone)
    m = Measures(tree, runs, gone)
    if roots := _scope(tree, m.chars):
        held = [False] * n
        for k in roots:
            held[k] = True
        for k in range(1, n):
            held[k] = held[k] or held[parent[k]]
        m = Measures(tree, runs, gone := [g or not h for g, h in zip(gone, held, strict=True)])
    if not m.chars[0]:
        return ""
    content = _content(parent, tag, m, set(roots))
    text = "".join(" " if t is None or gone[k] else t for k, t in runs if t is None or gone[k] or content[k])
    return _WHITE.sub(" ", text).strip(" ")


def _content(parent: list[int], tag: list[str], m: Measures, roots: set[int]) -> list[bool]:
    """Of each element, whether density makes it content; roots: the article or main elements that hold all that counts."""
    n, chars, density = len(tag), m.chars, m.densities()
    block = [t in BLOCK for t in tag]
    block[0] = True
    total, up = [0.0] * n, [0] * n  # up: the block around an element
    for k in range(1, n):
        up[k] = parent[k] if block[parent[k]] else up[parent[k]]
        if block[k]:
            total[up[k]] += density[k]
    best = max((k for k in range(n) if block[k]), key=lambda k: (total[k], chars[k], -k))
    path, inside, k = set(), set(), best
    while True:
        path.add(k)
        if not k:
            break
        if k in roots:
            inside = set(path)
        k = up[k]
    threshold = min(density[k] for k in path)
    top = list(range(n))  # of each node, the node of largest density sum in its subtree
    for k in range(n - 1, 0, -1):
        if block[k]:
            a, b = top[k], top[up[k]]
            if (total[a], chars[a], -a) > (total[b], chars[b], -b):
                top[up[k]] = a
    content = [False] * n
    for k in range(n):
        if block[k] and chars[k] and density[k] >= threshold:
            content[top[k]] = True
    for k in range(1, n):
        if tag[k] in PARAGRAPHS and 2 * m.link_chars[k] < chars[k]:
            over = up[k]
            while over not in path and chars[over] == chars[k]:  # it may stand alone in a wrapper
                over = up[over]
            content[k] = content[k] or over in inside or (k < best and tag[k] in HEADINGS and over in path)
    for k in range(1, n):
        content[k] = content[k] or content[parent[k]]
    menu = [False] * n
    for k in range(1, n):
        menu[k] = menu[parent[k]] or (tag[k] in BLOCK and m.links[k] >= MENU and chars[k] == m.link_chars[k])
        content[k] = content[k] and not menu[k]
    return content


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with one more column, main_text. A column of that name goes."""
    pages = pages.drop("main_text")
    rows = pages.select(F.struct(*[c for c in pages.columns if c != html_col]).alias("__row") if len(pages.columns) > 1 else F.lit(0).alias("__row"), F.col(html_col).alias("html"))
    out = T.StructType([*rows.schema.fields, T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                html = part.column("html")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(x) for x in html.to_pylist()], pa.string())], names=[*part.schema.names, "main_text"])

    rows = rows.mapInArrow(run, out)
    return rows.select(*(F.col("html").alias(c) if c == html_col else F.col(f"__row.{c}") for c in pages.columns), "main_text")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
