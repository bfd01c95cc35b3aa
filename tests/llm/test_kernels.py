import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm.html_extract import main_text
from factgraph.llm.simhash_bk import BKTree, bit_share, fingerprints_of, linked, sampled_masks, shard_masks
from factgraph.llm.textkernel import IS_PUNCT, HashIndex, Words, xxh64
from tests.llm import brute

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB é\n\t.,9\x0b字"), max_size=80)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    for separators, pattern in ((None, brute.WORD), (IS_PUNCT, brute.ALNUM)):
        w = Words(pa.array(rows, pa.string()), *([] if separators is None else [separators]))
        buf, start, end = w.joined()
        got = [[buf[a:b].tobytes().decode() for a, b in zip(start[p:q], end[p:q])] for p, q in zip(w.ptr[:-1], w.ptr[1:])]
        assert got == [pattern.findall((t or "").translate(brute.LOW)) for t in rows]
        assert [int(h) for h in xxh64(buf, start, end)] == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert [int(x) for x in fingerprints_of(pa.array(rows, pa.string()))[:, 0]] == [brute.fingerprint(t) for t in rows]


def test_hashes_of_all_lengths():
    raw = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    start = np.zeros(300, np.int64)
    end = np.array([*range(290), 1000, 2047, 2048, 2049, 3000, 4000, 4999, 5000, 31, 32])
    assert [int(h) for h in xxh64(raw, start, end)] == [xxhash.xxh64_intdigest(raw[:b].tobytes(), 42) for b in end]


def test_long_fingerprint_counts_past_255():
    text = " ".join(f"w{k % 700}" for k in range(3000))
    assert int(fingerprints_of(pa.array([text]))[0, 0]) == brute.fingerprint(text)


def test_hash_index():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64) << np.uint64(4))
    index = HashIndex(keys)
    assert (keys[index.find(keys)] == keys).all() and (index.find(keys + np.uint64(1)) == -1).all()
    assert (HashIndex(keys[:0]).find(keys) == -1).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 63)), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_bk_trees_find_all(rows, radius):
    rows = sorted(rows)
    shard, low = np.array([r[0] for r in rows]), [r[1] for r in rows]
    v = np.array([[x, x * 0x9E3779B97F4A7C15 % 2**64] for x in low], np.uint64)
    near = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b)) <= radius
    found = {(int(q), int(n)) for qs, ns in BKTree(v, shard).search(v, shard, radius) for q, n in zip(qs, ns)}
    pairs = {(a, b) for a in range(len(v)) for b in range(len(v)) if shard[a] == shard[b] and near(v[a], v[b])}
    assert found == pairs
    every = np.ones(len(v), bool)
    links = linked(np.arange(len(v)), v, shard, every, every, radius)
    parent = list(range(len(v)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert links.shape[1] == len(v) - len({root(x) for x in range(len(v))})
    assert all(root(int(a)) == root(int(b)) for a, b in links.T)


def test_sampled_keys_lose_few_links():
    """Two fingerprints that differ in the expected number of bits share a key with probability 1 - MISS or more."""
    masks = sampled_masks(5000)
    rng = random.Random(2)
    far = round(256 * (1 - bit_share(0.8)))
    hit = 0
    for _ in range(2000):
        flips = rng.sample(range(256), far)
        x = [sum(1 << (f % 64) for f in flips if f // 64 == w) for w in range(4)]
        hit += any(all(a & m == 0 for a, m in zip(x, mask)) for mask in masks)
    assert hit >= 0.92 * 2000


def test_shard_keys_lose_no_link():
    masks = shard_masks(2)
    for a in range(64):
        for b in range(a):
            assert any((1 << a | 1 << b) & m == 0 for (m,) in masks)


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><aside>side</aside><article><h1>Head &amp; line</h1><p>One <b>two\n</b>three<br>four<p>five <script>x</script>six</article><div class='comments'><p>reader says much here</p></div><footer>foot</footer></body></html>"
    assert main_text(page) == "Head & line One two three four five six"
    assert main_text(None) == main_text("") == main_text("<nav>only menu</nav>") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>cut off <b>here</p><p>and the en") == "cut off here and the en"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<p>a &lt;b&gt; &#233; &nosuch; c</p>") == "a <b> é &nosuch; c"
    long = " ".join(["word"] * 50_000)
    assert main_text(f"<div><div class=sidebar>links</div><div><p>{long}</p></div></div>") == long


def test_density_parts_text_from_links():
    body = "".join(f"<p>{'sentence with many plain words in it ' * 6}{k}.</p>" for k in range(5))
    links = "".join(f"<div><a href='/{k}'>link {k}</a></div>" for k in range(30))
    text = main_text(f"<body><div>{links}</div><div><div>{body}</div></div></body>")
    assert text.startswith("sentence with") and text.endswith("4.") and "link" not in text


def test_hint_words_remove_no_article():
    """A wrapper that names content, holds an article, or holds most of the page stays; small named boilerplate goes."""
    text = " ".join(f"plain sentence number {k} of the article" for k in range(40))
    for wrapper in ("<div class='content has-sidebar'>", "<div class='post comments-open'>", "<section class='social-science'>", "<div id=main class=subscription>"):
        page = f"<body><div class=sidebar>side words</div>{wrapper}<p>{text}</p></div></section></body>"
        assert main_text(page) == text
    assert main_text(f"<div class='page sidebar'><article><p>short</p></article></div><p>{text}</p>") != ""
    assert main_text("<div class=related><article>the article</article></div><div class=ad>buy</div>") == "the article"
    assert main_text(f"<p>{text}<span class=share></span>end</p><div class=comments><p>reader <b>says</b> this</p></div>") == text + " end"
    assert main_text(f"<div class=ad>{text}</div><article><p>short</p></article>") == "short"
    assert main_text(f"<article><h1>head</h1><div class='science social'><p>{text}</p></div><div class=share>share it</div></article>") == "head " + text


def test_probes_of_names_headings_and_comments():
    text = " ".join(f"plain sentence number {k} of the article" for k in range(40))
    assert main_text(f"<div class='related-work'><p>{text}</p></div>") == text
    assert main_text(f"<article><h1>Head</h1><div class='share-your-story'><p>{text}</p></div></article>") == "Head " + text
    assert main_text(f"<div><h1>Title</h1><div><p>{text}</p><p>{text}</p></div></div>") == f"Title {text} {text}"
    assert main_text(f"<article><p>{text} one</p></article><article><p>{text} two</p></article>") == f"{text} one {text} two"
    assert main_text(f"<div><p>{text}</p><p>{text}</p></div><section><h2>Comments (3)</h2><p>{text} me</p></section>") == f"{text} {text}"
    assert main_text(f"<div><p>{text}</p><h3>Leave a reply</h3><p>{text} x</p></div>") == text
    assert main_text(f"<div><div class='reader-comments'><p>{text} {text} x</p></div><div><p>{text}</p></div></div>") == text
    assert main_text(f"<article><p>{text}</p><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>end</p></article>") == text + " end"
    for name in ("post-comments", "article-sidebar", "main_nav", "related-posts", "comment-list-2", "entry-share-buttons"):
        assert main_text(f"<div><div><p>{text}</p></div><div class='x {name}'><p>{text} y</p></div></div>") == text
    for name in ("post-header", "story-of-menus", "commentary", "article-body", "newsroom"):
        assert main_text(f"<div class='{name}'><p>{text}</p></div>") == text
    assert main_text(f"<main><p>short</p><div><p>{text}</p><p>{text}</p></div></main>") == f"short {text} {text}"


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.sampled_from(["word", "some plain words in a row. " * 4, "<a>link text</a>", "<a>l</a>" * 3]), lambda x: st.tuples(st.sampled_from(["div", "p"]), st.lists(x, min_size=1, max_size=4)).map(lambda e: f"<div>{''.join(e[1])}</div>" if e[0] == "div" else f"<div><p>some text {len(e[1])}</p>{''.join(e[1])}</div>"), max_leaves=14))
def test_density_against_formulas(page):
    assert main_text(page) == brute.densest(page)


def test_all_pages_give_their_articles():
    """Precision and recall 1 on the given pages: the text of the article element, blocks parted by one space."""
    import re
    from html import unescape

    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = unescape(re.sub(r"<(/?)(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner)))
        assert main_text(r["html"]) == re.sub(r"[\x20\x09-\x0d]+", " ", want).strip(" ")
