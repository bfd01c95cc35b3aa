"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Fingerprints of one or more 64-bit words are made in vectorised Arrow batches. Distinct ones are dealt into shards by keys of some
of their bits. A shard's BK-tree (children keyed by integer Hamming distance to the parent) is searched for all its members,
following only edges within the radius; the trees of many small shards are built and searched together. A shard larger than
`tree_rows` is cut into pieces, and each pair of pieces is a tree and its queries, so no task holds an unbounded tree or
an unbounded set of queries. Links are thinned to a spanning forest where they are found, and components come from alternating
large-star and small-star steps on DataFrames.

Two ways to choose the keys:

* `near_duplicates` (radius 2 of 64 bits) uses pigeonhole keys: with radius r and r + 2 bit blocks, two fingerprints within the
  radius agree on at least two whole blocks, so each pair of blocks makes one key and no link is lost.
* `representatives` (five words, similarity 0.8) needs a radius of a sixth of the bits, where no such keys prune. It takes WORDS * 64
  bits, so that their distance estimates the similarity to about 0.05, and links texts whose distance is at most the expected
  one at that similarity plus ERRORS standard errors. Each of its keys is a sample of bits, as many as keep a shard at about 8 unrelated
  texts, and there are as many keys as lose a link of exactly that similarity with probability MISS (closer ones far more rarely).
  Keys grow with the number of texts to the power 0.24.

Nulls: a null text is empty; a text without words has fingerprint zero and links like any other. A null doc_id keeps its
fingerprint but is nobody's component id unless all documents of the component lack one. Repeated rows stay repeated in
near_duplicates. Very long texts are fingerprinted whole, empty tables give no rows, and columns beside the named ones play no part
(representatives returns them; columns __text and __row of its input are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import common
from factgraph.llm.textkernel import Words, mix, slices, xxh64

RADIUS, SHINGLE, BITS = 2, 3, 64
#: Of `representatives`: similarity (Jaccard, of shingles) of a link, words of a shingle, words of a fingerprint, share of links that
#: the keys lose at exactly that similarity, standard errors of the estimate that the radius allows for.
SIMILARITY, STAGE_SHINGLE, WORDS, MISS, ERRORS = 0.8, 5, 4, 0.02, 1.5
#: Pieces of cut shards whose sizes are broadcast; beyond that they meet the rows in a join.
HOT_ROWS = 100_000
Masks = Sequence[Sequence[int]]


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, width: int = 1) -> np.ndarray:
    """The fingerprint of every text, (texts, width): a bit is set if more than half of its shingle hashes (repeats included) set
    it. The first word of a shingle's hash is its XXH64, the others scramble that."""
    words = Words(texts)
    buf, start, end = words.joined()
    out = np.zeros((len(words.n), width), np.uint64)
    full = words.n > 0
    count = np.where(full, np.maximum(words.n - shingle + 1, 1), 0)
    ptr = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(words.ptr[:-1] - ptr[:-1], count) + np.arange(ptr[-1])
    last = first + np.repeat(np.minimum(words.n, shingle) - 1, count)
    h = xxh64(buf, start[first], end[last])
    at = np.flatnonzero(full)
    for w in range(width if len(at) else 0):
        with np.errstate(over="ignore"):
            hashes = mix(h + np.uint64(w)) if w else h
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = _column_sums(bits, ptr[at], count[at])
        set_ = (2 * ones > count[at][:, None]).astype(np.uint8)
        out[at, w] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _column_sums(bits: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ones in each of the 64 columns per document; runs of up to 255 rows are added in bytes, then the runs."""
    runs = -(-count // 255)
    owner = np.concatenate([[0], np.cumsum(runs)])
    inner = np.arange(owner[-1]) - np.repeat(owner[:-1], runs)
    small = np.add.reduceat(bits, np.repeat(begin, runs) + 255 * inner, axis=0, dtype=np.uint8)
    return np.add.reduceat(small, owner[:-1], axis=0, dtype=np.int64)


def fp_names(width: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, width))]


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, more: tuple[str, ...] = (), width: int = 1) -> DataFrame:
    """(doc_id, more..., fp bigint, fp1...) for each row: bit patterns of the fingerprint's words. more: bigint columns."""
    names, out = ["doc_id", *more], fp_names(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints_of(part.column("text"), shingle, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(fp[:, w].copy()) for w in range(width))], [*names, *out])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, *out]))


def shard_masks(radius: int) -> Masks:
    """Bit masks of the pigeonhole keys: every pair of blocks, of radius + 2 equal blocks."""
    cuts = np.linspace(0, BITS, radius + 3).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [(a | b,) for a, b in combinations(blocks, 2)]


def bit_share(similarity: float) -> float:
    """Share of fingerprint bits in which two texts of this Jaccard similarity (and equal length) are expected to agree."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_masks(texts: int, similarity: float = SIMILARITY, width: int = WORDS, miss: float = MISS) -> Masks:
    """Masks of random bits for so many texts; a link of this similarity agrees on none of the keys with probability `miss`."""
    bits = max(8, math.ceil(math.log2(max(texts, 2))) - 3)
    tables = math.ceil(math.log(miss) / math.log(1 - bit_share(similarity) ** bits))
    rng = np.random.default_rng(width)
    chosen = (rng.choice(width * BITS, bits, replace=False).tolist() for _ in range(tables))
    return [[sum(1 << (x % BITS) for x in own if x // BITS == w) for w in range(width)] for own in chosen]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of a and b, (n, words)."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKTree:
    """BK-trees in arrays, one for each run of equal shard numbers. values: (n, words). Nodes are made level by level; the
    children of a node lie together, each with its edge distance. root: the first value of each shard is its tree's root."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        n = len(values)
        new = np.ones(n, bool)
        new[1:] = shard[1:] != shard[:-1]
        self.root, self.shard = np.flatnonzero(new), shard[new]
        self.child_begin, self.child_end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.edge, self.node = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of child entries
        used = 0
        # all values under one parent are parted by their distance to it; the first of each part becomes the child
        members = np.flatnonzero(~new)
        groups = self.root[np.cumsum(new) - 1][members]
        while len(members):
            d = distances(values[members], values[groups])
            order = np.lexsort((members, d, groups))
            groups, members, d = groups[order], members[order], d[order]
            new = np.ones(len(members), bool)
            new[1:] = (groups[1:] != groups[:-1]) | (d[1:] != d[:-1])
            heads = np.flatnonzero(new)
            k = len(heads)
            self.node[used : used + k], self.edge[used : used + k] = members[heads], d[heads]
            parents, first, amount = np.unique(groups[heads], return_index=True, return_counts=True)
            self.child_begin[parents], self.child_end[parents] = used + first, used + first + amount
            used += k
            groups = members[heads][np.cumsum(new) - 1]
            groups, members = groups[~new], members[~new]

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) of all pairs of one shard within the radius, level by level, in blocks of bounded size."""
        at = np.searchsorted(self.shard, shard)
        on = np.flatnonzero((at < len(self.shard)) & (self.shard[np.minimum(at, len(self.shard) - 1)] == shard))
        stack = [(q, self.root[at[q]]) for q in np.split(on, range(most // 8, len(on), most // 8))]
        while stack:
            q, node = stack.pop()
            if len(q) > most:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = distances(queries[q], self.values[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            begin, many = self.child_begin[node], self.child_end[node] - self.child_begin[node]
            total = int(many.sum())
            if not total:
                continue
            entry = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(total)
            follow = np.abs(np.repeat(d, many) - self.edge[entry]) <= radius  # the triangle inequality
            if follow.any():
                stack.append((np.repeat(q, many)[follow], self.node[entry[follow]]))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n points: the least point that links a[i]-b[i] reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == was).all():
            return label


def linked(node: np.ndarray, fp: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> np.ndarray:
    """Links (x, y) between the nodes of whole shards, rows sorted by shard, as a spanning forest over all of them.
    in_tree, asks: whether a row is in its shard's tree, and whether it is a query."""
    values, own = np.unique(node, return_inverse=True)
    label = np.arange(len(values))
    at_q, at_t = own[asks], own[in_tree]
    for q, t in BKTree(fp[in_tree], shard[in_tree]).search(fp[asks], shard[asks], radius):
        x, y = label[at_q[q]], label[at_t[t]]
        new = x != y
        if new.any():
            label = _forest(x[new], y[new], len(values))[label]
    child = np.flatnonzero(label != np.arange(len(values)))
    return np.stack([values[child], values[label[child]]])


def shard_links(nodes: DataFrame, radius: int, masks: Masks, tree_rows: int = 20_000) -> DataFrame:
    """(a, b) with a <> b: links between nodes (node, fp, fp1...) that share a shard and lie within the radius, thinned."""
    width = len(masks[0])
    names = fp_names(width)

    def key(mask: Sequence[int]) -> Column:
        parts = [F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(names, mask, strict=True)]
        return parts[0] if width == 1 else F.xxhash64(*parts)

    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), key(m).alias("key")) for k, m in enumerate(masks)]))
    rows = nodes.select("node", *names, keys.alias("k")).select("k.mask", "k.key", "node", *names)
    hot = common.written(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > tree_rows), "hot-shards")
    rows = rows.join(F.broadcast(hot) if hot.count() <= HOT_ROWS else hot, ["mask", "key"], "left")
    cut = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tree_rows)).cast("int")
    # a shard is cut into pieces; the tree of the pieces (i, j), i <= j, holds piece i, and piece j asks it
    rows = rows.withColumn("cut", cut).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    rows = rows.withColumn("other", other).select(
        "mask", "key", (F.least("own", "other") * F.col("cut") + F.greatest("own", "other")).cast("int").alias("tree"),
        (F.col("own") <= F.col("other")).alias("member"), (F.col("own") >= F.col("other")).alias("asks"), "node", *names)
    rows = rows.repartition(common.partitions(nodes), "mask", "key", "tree").sortWithinPartitions("mask", "key", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the shard that the last batch left open

        def links(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(part), bool)
            new[1:] = (part[1:, :3] != part[:-1, :3]).any(axis=1)
            shard = np.cumsum(new) - 1
            some = np.bincount(shard)[shard] > 1
            part, shard = part[some], shard[some]
            if len(part):
                both = linked(part[:, 5], part[:, 6:].view(np.uint64), shard, part[:, 3] > 0, part[:, 4] > 0, radius)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)], axis=1)
            if not len(rows):
                continue
            if held and (held[-1][-1, :3] != rows[0, :3]).any():
                yield from links(np.concatenate(held))
                held = []
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            if len(change):
                yield from links(np.concatenate([*held, rows[: change[-1] + 1]]))
                held, rows = [], rows[change[-1] + 1 :]
            held.append(np.ascontiguousarray(rows))
        if held:
            yield from links(np.concatenate(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node in links (a, b): root is the least node that it reaches.

    Alternating large-star and small-star steps; each round is written to the shared folder, so a lost executor costs one
    round. Least neighbours are written before they are joined: both sides of a join then come from plain exchanges, and Spark
    splits the rows of a centre that a large group shares. It ends when a round changes nothing."""
    edges = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = common.written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("x"), "m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v"))
        edges = common.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def rooted(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, least, root) for every distinct fp of fps (doc_id, fp): its least doc_id, and the least fingerprint it reaches."""
    distinct = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(shard_links(distinct.select(F.col("fp").alias("node"), "fp"), radius, shard_masks(radius)))
    whole = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return common.written(whole, "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document row: doc_id, fp, component_id (the smallest doc_id reachable over links within the radius)."""
    fps = common.written(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints")
    whole = rooted(fps, radius)
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = STAGE_SHINGLE, width: int = WORDS) -> DataFrame:
    """Exactly one row of each component of texts that are this similar, with the columns of docs: that of least doc_id (nulls
    last), then least text hash, then least row hash. Rows that are equal in all columns are one. Texts are told apart by a
    64-bit hash."""
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    row = F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull())))
    keyed = docs.withColumns({"__text": text, "__row": row})
    fps = common.written(fingerprint_table(keyed, shingle=shingle, more=("__text", "__row"), width=width), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text", "__row")
    names = fp_names(width)
    texts = common.written(fps.groupBy(F.col("__text").alias("node"), *names).agg(F.min(order).alias("first")), "texts")
    far = BITS * width * (1 - bit_share(similarity))
    radius = round(far + ERRORS * math.sqrt(far * bit_share(similarity)))
    roots = components(shard_links(texts.select("node", *names), radius, sampled_masks(texts.count(), similarity, width)))
    whole = texts.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = whole.groupBy("root").agg(F.min("first").alias("first")).select("first.__text", "first.__row")
    return keyed.join(keep, ["__text", "__row"], "left_semi").dropDuplicates(["__text", "__row"]).select(*docs.columns)


def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
