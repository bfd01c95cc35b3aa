"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Target text is labelled good (quality 1, not toxic); raw text is the whole corpus. Both get a generative bag model over
BUCKETS hashed features: words and pairs of neighbouring words. A document's importance weight is the sum of log(target / raw)
over its features. Adding Gumbel noise (a fixed function of id and text) to the log weights and taking the k largest keys
samples k documents without replacement in proportion to their weights. k is the corpus size times the share of labels
of quality 1.

The target model is fitted on at most LABELLED labelled documents (those with the least id hash; the broadcast of their ids
has that bound). Raw counts, weights and the selection cover all whole documents. The k-th key is found exactly by counting
keys in ever finer ranges, so no sort of all rows and no large collect is needed.

Nulls: a null or empty text has no features and log weight 0; a null doc_id is never a label's document. Repeated rows have
equal weights and keys; ties at the k-th key are broken by doc_id, then at random but among equal rows only. Without good
labels all weights are 0; an empty table gives no rows. Very long texts count whole; columns other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm import common
from factgraph.llm.textkernel import Words, exact_sums, mix, slices, xxh64

BUCKETS, LABELLED, SMOOTH = 1 << 15, 20_000, 0.5
#: Features that the raw model is worth as the target model's prior.
PRIOR = 1e6
#: Rows that the last step of the selection may sort in one task.
LAST_SORT, RANGES = 100_000, 4096


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts, one after the other (words, then pairs, by text), and the first feature of each text."""
    words = Words(texts)
    h = mix(xxh64(words.buf, words.start, words.end, 1))
    one = (h >> np.uint64(64 - 15)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = (mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - 15)).astype(np.int64) if len(h) > 1 else np.zeros(0, np.int64)
    pairs = np.maximum(words.n - 1, 0)
    ptr = np.concatenate([[0], np.cumsum(words.n + pairs)])
    out = np.empty(ptr[-1], np.int64)
    owner = np.repeat(np.arange(len(words.n)), words.n)
    out[np.arange(len(h)) - words.ptr[owner] + ptr[owner]] = one
    owner = np.repeat(np.arange(len(words.n)), pairs)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    out[ptr[owner] + words.n[owner] + inner] = pair[words.ptr[owner] + inner]
    return out, ptr


def model_counts(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """(2, BUCKETS) feature counts: of all documents, and of those whose id is in good (at most LABELLED rows)."""
    named = F.broadcast(good.select(F.col("doc_id").alias("__good")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(named, F.col("doc_id") == F.col("__good"), "left")
    rows = rows.select("text", F.col("__good").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, ptr = features(part.column("text"))
                total[0] += np.bincount(found, minlength=BUCKETS)
                on = np.repeat(part.column("good").to_numpy(zero_copy_only=False), np.diff(ptr))
                total[1] += np.bincount(found[on], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    counts = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, BUCKETS), np.int64)
    for r in counts.collect():  # BUCKETS rows
        out[:, r.bucket] = r.raw, r.target
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log(target / raw) of every bucket; 0 everywhere if there is no target text."""
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    raw = (counts[0] + SMOOTH) / (counts[0].sum() + SMOOTH * BUCKETS)
    # the raw model is the target's prior, so buckets that the target sample lacks say little
    target = (counts[1] + PRIOR * raw) / (counts[1].sum() + PRIOR)
    return np.log(target / raw)


def weighted(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, n_features, log_weight, sample_key) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, ptr = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(np.diff(ptr)), pa.array(exact_sums(table[found], ptr))], ["doc_id", "h", "n_features", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, h long, n_features long, log_weight double")
    uniform = (F.pmod("h", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.select("doc_id", "n_features", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("sample_key"))


def top_k(keyed: DataFrame, k: int, key: str = "sample_key", last: int = LAST_SORT) -> DataFrame:
    """keyed with a column selected: true for the k rows of largest key (ties: least doc_id), exactly."""
    low, high = keyed.agg(F.min(key), F.max(key)).first()
    total = keyed.count()
    if k <= 0 or k >= total or low is None:
        return keyed.withColumn("selected", F.lit(k >= total and k > 0))
    above, inside = 0, total  # rows with larger keys than high; rows between low and high
    while inside > last and low < high:
        width = (high - low) / RANGES
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(RANGES - 1))
        bins = keyed.where(F.col(key).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r.bin):  # at most RANGES rows; a bin's own extremes bound the next round
            if above + r.n >= k:
                low, high, inside = r.lo, r.hi, r.n
                break
            above += r.n
    middle = keyed.where(F.col(key).between(low, high))
    rank = F.row_number().over(Window.orderBy(F.desc(key), "doc_id"))
    # the range that holds the k-th key has at most `last` rows, unless that many keys are equal
    cut = middle.select(key, "doc_id", rank.alias("rank")).where(F.col("rank") == k - above).select(F.col(key).alias("k"), F.col("doc_id").alias("d")).first()
    surely = (F.col(key) > cut.k) | ((F.col(key) == cut.k) & (F.coalesce(F.col("doc_id") <= cut.d, F.lit(True)) if cut.d is not None else F.col("doc_id").isNull()))
    return keyed.withColumn("selected", surely)


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """(doc_id, n_features, log_weight, sample_key, selected); share of rows to take (default: that of labels of quality 1)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality")).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    good = (F.col("q") > 0) & (F.col("x") == 0)
    seen, many = known.agg(F.count("*"), F.count_if(F.col("q") > 0)).first()
    sample = known.where(good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id")
    keyed = common.written(weighted(docs, log_ratio(model_counts(docs, sample, id_col, text_col)), id_col, text_col), "weights")
    share = share if share is not None else (many / seen if seen else 1.0)
    return top_k(keyed, round(share * keyed.count()))


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_features", "log_weight", "sample_key", "selected", F.col("selected").alias("kept"))
