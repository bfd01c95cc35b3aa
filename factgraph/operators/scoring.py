"""Rule scoring: vocabularies, weights and thresholds as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether the text contains any of the terms, as substrings."""
    test = F.lit(False)
    for t in terms:
        test = test | text.contains(t)
    return F.coalesce(test, F.lit(False))


def found_terms(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the order given."""
    return F.array_compact(F.array(*(F.when(text.contains(t), F.lit(t)) for t in terms)))


def weighted_score(tests: list[tuple[float, Column]], digits: int = 2, most: float = 1.0) -> Column:
    """Sum of the weights whose test is true, capped, and rounded before anything compares it."""
    total = F.lit(0.0)
    for weight, test in tests:
        total = total + F.when(test, F.lit(weight)).otherwise(0.0)
    return F.round(F.least(total, F.lit(most)), digits)


def banded(score: Column, bands: list[tuple[float, str]], below: str) -> Column:
    """The label of the first band (from, label) that the score reaches; bands fall in value."""
    out = F.lit(below)
    for start, label in reversed(bands):
        out = F.when(score >= start, F.lit(label)).otherwise(out)
    return out


def token_evidence(source: Column, target: Column) -> Column:
    """0.85 if the target's tokens lie in the source's, 0.80 for the reverse, 0.70 if they share one, else null."""
    some = (F.size(source) > 0) & (F.size(target) > 0)
    return (
        F.when(some & (F.size(F.array_except(target, source)) == 0), 0.85)
        .when(some & (F.size(F.array_except(source, target)) == 0), 0.80)
        .when(some & F.arrays_overlap(source, target), 0.70)
    )


def token_pairs(left: DataFrame, right: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(source, target, confidence) for ids that share a token: an equi-join on exploded tokens, not a cross join.

    Pairs that share several tokens are merged before the sets are compared."""
    a = left.select(F.col(id_col).alias("source"), F.col(tokens).alias("__s"))
    b = right.select(F.col(id_col).alias("target"), F.col(tokens).alias("__t"))
    shared = a.select("source", F.explode(F.array_distinct("__s")).alias("__token")).join(b.select("target", F.explode(F.array_distinct("__t")).alias("__token")), "__token")
    pairs = shared.where("source <> target").select("source", "target").distinct().join(a, "source").join(b, "target")
    return pairs.select("source", "target", token_evidence(F.col("__s"), F.col("__t")).alias("confidence"))


def mean_confidence(column: str) -> Column:
    """Mean rounded to two digits; 0.0 over nothing."""
    return F.coalesce(F.round(F.avg(column), 2), F.lit(0.0))
