"""Plain Python versions of the training-data operators, straight from their definitions."""

import re
from collections import Counter, defaultdict

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def dedup_lines(docs, min_chars=20, min_docs=3):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, kept text)], rows in order."""
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOW)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality_base(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    many = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def contaminated(docs, items, size=10):
    """[(doc_id, text)], [(item, text)] -> {row: (n_words, n_hit, sorted items)}"""
    patterns = defaultdict(set)
    for i, t in items:
        ws = ALNUM.findall((t or "").translate(LOW))
        n = min(size, len(ws))
        for k in range(len(ws) - n + 1 if ws and i is not None else 0):
            patterns[tuple(ws[k : k + n])].add(str(i))
    lengths = {len(p) for p in patterns}
    out = []
    for _, t in docs:
        ws = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                p = tuple(ws[k : k + n])
                if p in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[p]
        out.append((len(ws), len(hit), sorted(found)))
    return out


def scrambled(h):
    h = (h ^ h >> 33) * 0xC2B2AE3D27D4EB4F % 2**64
    h = (h ^ h >> 29) * 0x165667B19E3779F9 % 2**64
    return h ^ h >> 32


def shingles(text, size):
    ws = words((text or "").translate(LOW))
    return [" ".join(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))] if ws else []


def fingerprint(text, size=3, width=1):
    first = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]
    out = 0
    for w in range(width):
        hashes = [scrambled((h + w) % 2**64) if w else h for h in first]
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << 64 * w
    return out


def components(fps, radius=2):
    """{id: fingerprint} -> {id: least id reachable}"""
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


class Element:
    """A node of a well-formed page for the density reference: tag, children (elements and strings)."""

    def __init__(self, tag):
        self.tag, self.children = tag, []

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Element):
                yield from c.walk()

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def chars(self):
        return len(re.sub(r"\s", "", self.text()))


def densest(page):
    """Words of the subtree of largest density sum and of every subtree that the body-path threshold admits, for pages of plain
    div, p and a elements without names: {element index: is content}, straight from the formulas."""
    import math
    from html.parser import HTMLParser

    root = Element("body")
    stack = [root]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack[-1].children.append(Element(tag))
            stack.append(stack[-1].children[-1])

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            stack[-1].children.append(data)

    Reader().feed(page)
    kids = lambda e: [c for c in e.children if isinstance(c, Element)]
    links = lambda e: [x for x in e.walk() if x.tag == "a" and x is not e]
    link_chars = lambda e: e.chars() if e.tag == "a" else sum(x.chars() for x in links(e))
    ratio = link_chars(root) / root.chars()

    def density(e):
        c, lc, t, lt = e.chars(), link_chars(e), len(list(e.walk())), len(links(e))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        if base <= 1 + 1e-9:
            return c / t * math.log(max(c * t, math.e))
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / math.log(base)

    blocks = [e for e in root.walk() if e.tag != "a"]
    total = {id(e): sum(density(c) for c in kids(e) if c.tag != "a") for e in blocks}
    best = max(blocks, key=lambda e: (total[id(e)], e.chars(), -blocks.index(e)))
    threshold = min(density(e) for e in blocks if any(x is best for x in e.walk()))
    taken = set()
    for e in blocks:
        if e.chars() and density(e) >= threshold:
            top = max((x for x in e.walk() if x.tag != "a"), key=lambda x: (total[id(x)], x.chars(), -blocks.index(x)))
            taken |= {id(x) for x in top.walk()}

    def out(e):
        if e is not root and len(links(e)) >= 3 and e.tag != "a" and e.chars() == link_chars(e):
            return " "
        inner = "".join((c if id(e) in taken else "") if isinstance(c, str) else out(c) for c in e.children)
        return inner if e.tag == "a" else f" {inner} "

    return " ".join(out(root).split())
