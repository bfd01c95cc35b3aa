"""Mixing documents to target domain weights by soft membership. DataFrame functions only.

A classifier trained on the labelled table gives every document a posterior over domains (good, poor, toxic). Projected
gradient least squares then fits one nonnegative rate per document so that the expected tokens of each domain, summed over
all documents, match the targets. The gradient of a rate is preconditioned by the document's tokens, so a rate depends on
the document only through its posterior and the domain residuals so far. Documents are first summed, by one aggregate that
combines before the shuffle, into at most CELLS**2 / 2 cells of almost equal posteriors (each cell has the token-weighted
mean of its posteriors), so a step reads that bounded table and not the corpus.

The classifier is a Bernoulli naive Bayes model of hashed words: it counts, over at most LABELLED labelled documents (those
with the least id hash), how many documents of each domain hold a word bucket, and keeps the buckets whose shares differ
significantly between domains. A document's score adds up the log odds of the kept buckets that it holds; that it holds no
others counts as well. The table of at most BUCKETS rows is broadcast; everything else covers all documents. Labels err: even a
text without any evidence has some posterior of each domain. That floor is the label noise, and memberships are posteriors
above it (the domain of the largest floor takes the rest), so noise does not weigh on ordinary documents.

Targets that no rates can meet (a zero target of documents that also belong to other domains, a domain that no document
belongs to) leave a residual: `reached` gives wanted and reached tokens by domain.

Nulls: a null text has no words, so it is the document without evidence and its tokens are 0. Labels with a null id, quality or
toxic are left out; several labels of one document count with the largest quality and toxic. Repeated rows get equal rates,
and so do rows that share doc_id and text; rows that share only the doc_id are apart. Without labels or without documents all
domains are equally likely and every rate is fitted from those. Very long texts are counted whole. An empty table gives no
rows. Columns mix_rate and mix_copies of the input are replaced; other columns play no part and return as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import common

DOMAINS = ("good", "poor", "toxic")
#: Share of the mixed tokens that each domain is to have, and the mixed tokens as a multiple of all tokens.
TARGETS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}
EPOCHS = 1.25
LABELLED, BUCKETS, SHRINK = 20_000, 1 << 16, 20.0
#: A bucket counts only if its domain shares differ from the prior by this log-likelihood ratio (G) statistic.
G_LEAST = 25.0
#: Buckets that a larger share of the labelled documents holds tell lengths apart rather than domains, and do not count.
COMMON = 0.1
STEPS, CLOSE, CELLS = 40, 1e-3, 512
#: A domain with a target of zero is done when this share of its expected tokens is left, on documents of mixed membership.
GONE = 0.02
SPLIT = r"[\x20\x09-\x0D.,;:]+"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), SPLIT, -1))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _tokens(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(common.WHITE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, common.GAP, -1))).cast("long")


def domain_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, domain) of at most `most` labelled documents."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.select("doc_id", F.when(F.col("x") > 0, 2).when(F.col("q") > 0, 0).otherwise(1).alias("domain"))


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...) log odds of the buckets that tell domains apart, and the log scores of a document without them."""
    k_all = range(len(DOMAINS))
    named = F.broadcast(domain_labels(labels))  # at most LABELLED rows
    rows = _keyed(docs, id_col, text_col).join(named, "doc_id").select("doc_id", "domain", "text")
    words = rows.select("doc_id", "domain", F.explode(F.array_append(_words(F.col("text")), F.lit(None).cast("string"))).alias("w"))
    seen = words.select("doc_id", "domain", F.when(F.col("w").isNull(), -1).otherwise(_bucket(F.col("w"))).alias("bucket")).distinct()  # -1: the document itself
    counts = seen.groupBy("bucket").agg(*(F.sum((F.col("domain") == k).cast("double")).alias(f"n{k}") for k in k_all))
    counts = common.written(counts, "bucket-counts")
    total = counts.where("bucket = -1").first()
    many = np.array([total[f"n{k}"] for k in k_all]) if total else np.zeros(len(DOMAINS))
    prior = (many + 1) / (many.sum() + len(DOMAINS))
    n = sum((F.col(f"n{k}") for k in k_all), F.lit(0.0))
    excess = [F.when(F.col(f"n{k}") > 0, 2 * F.col(f"n{k}") * F.log(F.col(f"n{k}") / (n * float(prior[k])))).otherwise(0.0) for k in k_all]
    held = [(F.col(f"n{k}") + SHRINK * n / F.lit(float(many.sum() + 1))) / F.lit(float(many[k] + SHRINK)) for k in k_all]
    held = [F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)) for x in held]
    chosen = counts.where("bucket >= 0").where((sum(excess, F.lit(0.0)) >= G_LEAST) & (n <= F.lit(COMMON * float(many.sum()))))
    chosen = chosen.select("bucket", *(F.log(x / (1 - x)).alias(f"w{k}") for k, x in enumerate(held)), *(F.log(1 - x).alias(f"a{k}") for k, x in enumerate(held)))
    chosen = common.written(chosen.coalesce(1), "weights")  # at most BUCKETS rows
    absent = chosen.agg(*(F.coalesce(F.sum(f"a{k}"), F.lit(0.0)).alias(f"a{k}") for k in k_all)).first()
    return chosen.select("bucket", *(f"w{k}" for k in k_all)), [float(np.log(prior[k]) + absent[f"a{k}"]) for k in k_all]


def _membership(score: Column, start: list[float]) -> Column:
    """Posteriors of log scores, less what a document without evidence has; start: that document's log scores."""
    top = F.array_max(score)
    share = F.transform(score, lambda x: F.exp(x - top))
    p = F.transform(share, lambda x: x / F.aggregate(share, F.lit(0.0), lambda a, y: a + y))
    floor = np.exp(np.array(start) - max(start))
    floor /= floor.sum()
    rest = int(floor.argmax())
    above = [F.lit(0.0) if k == rest else F.greatest(F.get(p, F.lit(k)) - float(floor[k]), F.lit(0.0)) / float(1 - floor[k]) for k in range(len(start))]
    return F.array(*(F.greatest(1 - sum(above, F.lit(0.0)), F.lit(0.0)) if k == rest else x for k, x in enumerate(above)))


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, n_rows, tokens, p array<double>) for every distinct (doc_id, text)."""
    weights, start = classifier(docs, labels, id_col, text_col)
    weights = F.broadcast(weights)  # at most BUCKETS rows
    rows = _keyed(docs, id_col, text_col).withColumn("tokens", _tokens(F.col("text")))
    # the null word at the end stands for the row itself: it counts rows and keeps documents without words
    buckets = F.array_distinct(F.transform(_words(F.col("text")), _bucket))
    words = rows.select("doc_id", "part", "tokens", F.explode(F.array_append(buckets, F.lit(None).cast("int"))).alias("bucket"))
    words = words.withColumn("end", F.col("bucket").isNull().cast("int"))
    joined = words.join(weights, "bucket", "left")
    names = [f"w{k}" for k in range(len(DOMAINS))]
    sums = joined.groupBy("doc_id", "part").agg(F.sum("end").alias("n_rows"), F.max("tokens").alias("tokens"), *(F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in names))
    sums = sums.withColumn("score", F.array(*(F.lit(start[k]) + F.col(w) / F.col("n_rows") for k, w in enumerate(names))))
    return sums.select("doc_id", "part", "n_rows", "tokens", _membership(F.col("score"), start).alias("p"))


def _rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate after the given gradient steps: each moves it against its posterior's residual and projects it on r >= 0."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*(F.array(*map(F.lit, g)) for g in steps))
    return F.aggregate(taken, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum(F.get(p, F.lit(k)) * F.get(g, F.lit(k)) for k in range(len(steps[0])))))


def cells(members: DataFrame) -> DataFrame:
    """(tokens, p): members of almost equal posteriors summed; p is their token-weighted mean. At most CELLS**2 / 2 rows."""
    t = (F.col("tokens") * F.col("n_rows")).cast("double")
    key = [F.round(F.get("p", F.lit(k)) * CELLS).cast("int").alias(f"c{k}") for k in range(len(DOMAINS))]
    sums = members.where("tokens > 0").groupBy(*key).agg(F.sum(t).alias("tokens"), *(F.sum(t * F.get("p", F.lit(k))).alias(f"t{k}") for k in range(len(DOMAINS))))
    return sums.select("tokens", F.array(*(F.col(f"t{k}") / F.col("tokens") for k in range(len(DOMAINS)))).alias("p"))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS, steps: int = STEPS) -> list[list[float]]:
    """Gradient steps that fit rates of members (tokens, n_rows, p) to the targets, until they are met, nothing changes any
    more (what is left of them cannot be met), or `steps` are taken."""
    k = len(DOMAINS)
    members = common.written(cells(members), "cells")
    t = F.col("tokens")
    p = [F.get("p", F.lit(i)) for i in range(k)]
    got = members.agg(*(F.sum(t * p[i]).alias(f"t{i}") for i in range(k)), *(F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    have = np.array([got[f"t{i}"] or 0.0 for i in range(k)])
    total = have.sum()
    if not total:
        return []
    want = np.array([targets[d] for d in DOMAINS]) * total * epochs
    want = np.where(have > 0, want, 0.0)  # no rates give tokens of a domain that no document belongs to
    # a domain with a target of zero is measured by its own tokens, so that it goes however small its share of the table is
    close = np.where(want > 0, CLOSE * total, GONE * have)
    scale = 1 / np.sqrt(np.maximum(have, 1.0))  # each domain's squared residual counts relative to its tokens
    gram = np.array([[got[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) * np.outer(scale, scale)
    step = 1 / max(np.linalg.eigvalsh(gram).max(), 1e-12)
    taken: list[list[float]] = []
    for _ in range(steps):
        residual = have - want
        if (np.abs(residual) <= close).all():
            break
        taken.append([float(x) for x in step * scale * scale * residual])
        row = members.withColumn("r", _rate(F.col("p"), taken)).agg(*(F.sum(t * F.col("r") * p[i]).alias(f"t{i}") for i in range(k))).first()
        was, have = have, np.array([row[f"t{i}"] or 0.0 for i in range(k)])
        if (np.abs(have - was) <= 0.02 * close).all():
            break
    return taken


def reached(rates: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """(domain, held, wanted, reached): expected tokens of each domain in rates (what `mixed` returns), before and after mixing."""
    t = (F.col("tokens") * F.col("n_rows")).cast("double")
    sums = rates.agg(F.sum(t).alias("all"), *(F.sum(t * F.get("p", F.lit(k))).alias(f"h{k}") for k in range(len(DOMAINS))), *(F.sum(t * F.col("rate") * F.get("p", F.lit(k))).alias(f"r{k}") for k in range(len(DOMAINS))))
    each = (F.struct(F.lit(d).alias("domain"), F.col(f"h{k}").alias("held"), (F.col("all") * targets[d] * epochs).alias("wanted"), F.col(f"r{k}").alias("reached")) for k, d in enumerate(DOMAINS))
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """(doc_id, part, n_rows, tokens, p, rate, copies): copies is the rate rounded up or down, at random by the id's hash."""
    members = common.written(posteriors(docs, labels, id_col, text_col), "members")
    rates = members.withColumn("rate", _rate(F.col("p"), fit_rates(members, targets, epochs)))
    uniform = (F.pmod(F.xxhash64("doc_id", "part", F.lit("mix")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return rates.withColumn("copies", F.floor(F.col("rate") + uniform).cast("long"))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """The documents that the mix takes at least once, with the columns of docs and their mix_rate and mix_copies."""
    rates = mixed(docs, labels, targets=targets, epochs=epochs).where("copies > 0").select(F.col("doc_id").alias("__doc"), F.col("part").alias("__part"), F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__part"))
    return docs.drop("mix_rate", "mix_copies").join(rates, same).drop("__doc", "__part")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixed(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    rates = rates.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rates.select("doc_id", F.col("tokens").alias("n_tokens"), *(F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")
