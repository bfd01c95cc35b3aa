"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark items' windows of ten words (a shorter item is one window). The search symbol is a word and a
block is two words. For all patterns of one length m, a shift table says how far the window may move after a block: a block
that no pattern holds skips m - 1 words. Where the shift is 0, the window's last block and first block name a bucket of
patterns (suffix and prefix hash), and the words themselves are then compared, so hashes never decide. Texts are searched
in lanes of end positions, all lanes of a batch at once in numpy. Equal windows are one pattern with a list of items.

The benchmark goes to the executors in blocks of at most about `block_bytes` of text, one broadcast for each (normally one).
A worker compiles a block once into flat arrays (some 12 times its text) and keeps the last one. Every pass over the rows searches
one block and adds its hits to a bitmap that travels with the row; between passes the rows are written to the shared folder,
so that no two blocks are held at once. Documents are never shuffled.

Nulls: a null text has no words and is clean; a null item text or one without words is no pattern, and so is an item whose
id is null. Repeated documents are judged alike; repeated items count once; an item that occurs in many texts or a window
that many items share needs no special case. Very long texts are searched whole. An empty benchmark hits nothing, an empty
table gives no rows. Other columns return as they are; one named like the result is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import common
from factgraph.llm.textkernel import IS_PUNCT, Words, mix, slices, xxh64

WINDOW, LANE, TABLE_BITS = 10, 128, 20
BLOCK_BYTES = 16 << 20
SEARCHED = [T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__words", T.LongType())]


def _blocks(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of `size` (1 or 2) words that ends at each position."""
    with np.errstate(over="ignore"):
        return h[at] if size == 1 else mix(h[at - 1] * np.uint64(3) + h[at])


def same_bytes(a: np.ndarray, a_from: np.ndarray, b: np.ndarray, b_from: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether a[a_from:a_from + size] equals b[b_from:b_from + size], for many spans of at least one byte."""
    out = np.empty(len(size), bool)
    cut, end = 0, np.cumsum(size)
    while cut < len(size):
        to = max(cut + 1, int(np.searchsorted(end, (end[cut - 1] if cut else 0) + most, "right")))
        n = size[cut:to]
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[cut:to] = np.logical_and.reduceat(a[np.repeat(a_from[cut:to], n) + at] == b[np.repeat(b_from[cut:to], n) + at], begin)
        cut = to
    return out


class Text:
    """The words of a batch of texts: their hashes, and their bytes with single spaces between them."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, IS_PUNCT)
        self.n, self.ptr = words.n, words.ptr
        self.h = xxh64(words.buf, words.start, words.end)
        self.buf, self.start, self.end = words.joined()


class Patterns:
    """Shift table and buckets for all windows of one length in words; at: first words of the windows, item: their items."""

    def __init__(self, size: int, text: Text, at: np.ndarray, item: np.ndarray):
        self.size, self.block = size, min(2, size)
        self.shift = np.full(1 << TABLE_BITS, size - self.block + 1, np.int64)
        for last in range(self.block - 1, size):
            np.minimum.at(self.shift, self._slot(_blocks(text.h, at + last, self.block)), size - 1 - last)
        pair = self._pair(_blocks(text.h, at + size - 1, self.block), _blocks(text.h, at + self.block - 1, self.block))
        whole = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                whole = mix(whole * np.uint64(3) + text.h[at + k])
        order = np.lexsort((item, whole, pair))
        at, item, pair, whole = at[order], item[order], pair[order], whole[order]
        first, last = text.start[at], text.end[at + size - 1]
        # equal neighbours are one window; windows that only share their hashes stay apart
        new = np.ones(len(at), bool)
        near = 1 + np.flatnonzero((pair[1:] == pair[:-1]) & (whole[1:] == whole[:-1]) & (last[1:] - first[1:] == last[:-1] - first[:-1]))
        if len(near):
            new[near] = ~same_bytes(text.buf, first[near], text.buf, first[near - 1], (last - first)[near])
        self.buf, self.start, self.bytes = text.buf, first[new], (last - first)[new]
        self.bucket, self.bucket_at = np.unique(pair[new], return_index=True)
        self.bucket_at = np.append(self.bucket_at, new.sum())
        window = np.cumsum(new) - 1
        once = np.ones(len(at), bool)
        once[1:] = new[1:] | (item[1:] != item[:-1])
        self.item = item[once]
        self.item_at = np.searchsorted(window[once], np.arange(len(self.start) + 1))

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    @staticmethod
    def _pair(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(suffix * np.uint64(5) + prefix)

    def search(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence."""
        m, h = self.size, text.h
        ends = np.maximum(text.n - m + 1, 0)
        lanes = -(-ends // LANE)
        begin = np.repeat(text.ptr[:-1] + m - 1, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(begin + LANE, np.repeat(text.ptr[1:], lanes))
        at = begin
        found = [np.zeros(0, np.int64)]
        while len(at):
            shift = self.shift[self._slot(_blocks(h, at, self.block))]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at = np.sort(np.concatenate(found))
        pair = self._pair(_blocks(h, at, self.block), _blocks(h, at - m + self.block, self.block))
        where = np.minimum(np.searchsorted(self.bucket, pair), len(self.bucket) - 1)
        hit = self.bucket[where] == pair
        at, where = at[hit] - m + 1, where[hit]
        many = self.bucket_at[where + 1] - self.bucket_at[where]
        first, window = np.repeat(at, many), np.repeat(self.bucket_at[where], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        equal = np.flatnonzero(text.end[first + m - 1] - text.start[first] == self.bytes[window]) if len(first) else first
        first, window = first[equal], window[equal]
        same = same_bytes(text.buf, text.start[first], self.buf, self.start[window], self.bytes[window]) if len(first) else np.zeros(0, bool)
        return first[same], window[same]


def compile_patterns(ids: list[str], texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, list[Patterns]]:
    """The item ids, sorted, and the patterns of each length."""
    names, item = np.unique(np.array(ids, object), return_inverse=True) if ids else (np.array([], object), np.zeros(0, np.int64))
    text = Text(pa.array(texts, pa.string()))
    size = np.minimum(text.n, window)
    out = []
    for m in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == m)
        many = text.n[own] - m + 1
        at = np.repeat(text.ptr[:-1][own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(Patterns(m, text, at, np.repeat(item[own], many)))
    return names, out


_COMPILED: dict[str, tuple[np.ndarray, list[Patterns]]] = {}


def _compiled(key: str, ids: list[str], texts: list[str], window: int) -> tuple[np.ndarray, list[Patterns]]:
    """The patterns of a block, compiled once by each worker; it keeps the last block only."""
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = compile_patterns(ids, texts, window)
    return _COMPILED[key]


def _searched(texts: pa.Array, names: np.ndarray, patterns: list[Patterns]) -> tuple[list[bytes | None], list[list[str]], np.ndarray]:
    """Of each text: the bitmap of hit words or None, its items in order, and its number of words."""
    text = Text(texts)
    edge = np.zeros(len(text.h) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for p in patterns:
        first, window = p.search(text)
        if not len(first):
            continue
        np.add.at(edge, first, 1)
        np.add.at(edge, first + p.size, -1)
        own = np.searchsorted(text.ptr, first, "right") - 1
        own, window = np.divmod(np.unique(own * len(p.start) + window), len(p.start))
        many = p.item_at[window + 1] - p.item_at[window]
        item = p.item[np.repeat(p.item_at[window], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        pairs.append(np.unique(np.repeat(own, many) * len(names) + item))
    hit = np.cumsum(edge[:-1]) > 0
    bits: list[bytes | None] = [None] * len(text.n)
    items: list[list[str]] = [[] for _ in range(len(text.n))]
    both = np.unique(np.concatenate(pairs))
    for k, item in zip(*(x.tolist() for x in np.divmod(both, max(len(names), 1))), strict=True):
        items[k].append(names[item])
    for k, found in enumerate(items):
        if found:
            bits[k] = np.packbits(hit[text.ptr[k] : text.ptr[k + 1]], bitorder="little").tobytes()
    return bits, items, text.n


def _either(a: bytes | None, b: bytes | None) -> bytes | None:
    if a is None or b is None:
        return a if b is None else b
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """The items in blocks of about block_bytes: as many hash classes as the measured size asks for, fetched one by one."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).collect() if total else []
        yield [r.i for r in rows], [r.t for r in rows]


def searched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "contamination") -> DataFrame:
    """docs with a struct column `name`: n_words, n_hit, items (sorted as strings), hit (bitmap over words, or null). A column
    of that name goes."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (text_col, name)]
    row = F.struct(*others) if others else F.lit(0)
    rows = docs.select(row.alias("__row"), F.col(text_col).alias("__text"))
    out = T.StructType([*rows.schema.fields, *SEARCHED])
    rows = rows.select("*", F.lit(None).cast("binary").alias("__hit"), F.array().cast("array<string>").alias("__items"), F.lit(0).cast("long").alias("__words"))
    for k, (ids, texts) in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)):
        sent, key = spark.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            compiled = _compiled(key, *sent.value, window)
            for batch in batches:
                for part in slices(batch, "__text"):
                    bits, items, n = _searched(part.column("__text"), *compiled)
                    was = part.column("__hit").to_pylist(), part.column("__items").to_pylist()
                    bits = [_either(a, b) for a, b in zip(was[0], bits, strict=True)]
                    items = [sorted({*a, *b}) if a else b for a, b in zip(was[1], items, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("__text"), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(n.astype(np.int64))], names=part.schema.names)

        rows = (common.written(rows, "searched") if k else rows).mapInArrow(run, out)
    nibbles = F.regexp_replace(F.translate(F.hex("__hit"), "0123456789ABCDEF", "0112122312232334"), "0", "")
    ones = sum((F.lit(k) * (F.length(nibbles) - F.length(F.replace(nibbles, F.lit(str(k)), F.lit("")))) for k in range(1, 5)), F.lit(0))
    kept = ((F.col("__text") if c == text_col else F.col(f"__row.{c}")).alias(c) for c in docs.columns if c != name)
    return rows.select(*kept, F.struct(F.col("__words").alias("n_words"), F.coalesce(ones, F.lit(0)).cast("long").alias("n_hit"), F.col("__items").alias("items"), F.col("__hit").alias("hit")).alias(name))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return searched(docs, benchmark, name="__contamination").where("__contamination.n_hit = 0").select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    c = F.col("contamination")
    return searched(docs, common.table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pattern AS (SELECT DISTINCT item, least(len(ws), 10) AS m,
    unnest(list_transform(range(len(ws) - least(len(ws), 10) + 1), lambda i: array_to_string(ws[i + 1:i + least(len(ws), 10)], ' '))) AS k FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM pattern),
win AS (SELECT r, m, unnest(range(len(ws) - m + 1)) AS p, unnest(list_transform(range(len(ws) - m + 1), lambda i: array_to_string(ws[i + 1:i + m], ' '))) AS k
    FROM d, sizes WHERE len(ws) >= m),
hits AS (SELECT win.r, win.p, win.m, item FROM win JOIN pattern ON win.k = pattern.k AND win.m = pattern.m),
covered AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(p, p + m)) AS w FROM (SELECT DISTINCT r, p, m FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN items i ON d.r = i.r
"""
