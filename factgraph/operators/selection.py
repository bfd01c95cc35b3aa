"""Order-sensitive deduplication, merging, caps and top-k. Every tie is settled by a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    if all(isinstance(o, str) for o in order):  # min of a struct combines before the shuffle; a window would not
        best = F.min(F.struct(*order, *(c for c in df.columns if c not in order))).alias("__row")
        return df.groupBy(*keys).agg(best).select(*(F.col(f"__row.{c}").alias(c) for c in df.columns))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def keep_best(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of largest score of each key (null scores last); ties go to the least of `ties`."""
    return cap_per_group(df, keys, score, ties, 1)


def cap_per_group(df: DataFrame, keys: list[str], score: str, ties: list[str], cap: int | dict[str, int], cap_key: str | None = None) -> DataFrame:
    """At most `cap` rows of largest score per key; cap may depend on the value of cap_key. The rank limit is pushed below
    the shuffle by the optimizer, so a hot key sends at most cap rows from each task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *ties))
    out = df.withColumn("__rank", rank)
    if isinstance(cap, int):
        return out.where(F.col("__rank") <= cap).drop("__rank")
    most = F.create_map(*(F.lit(x) for kv in cap.items() for x in kv))
    return out.where(F.col("__rank") <= max(cap.values())).where(F.col("__rank") <= F.coalesce(F.try_element_at(most, F.col(cap_key)), F.lit(0))).drop("__rank")


def merge_fields(df: DataFrame, key: str, order: str, first: list[str], least: list[str] = (), largest: list[str] = ()) -> DataFrame:
    """One row per key: the first non-null value of each field in `order`, and extremes of others."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in first]
    return df.groupBy(key).agg(*firsts, *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in largest))


def merge_sets(df: DataFrame, key: str, score: str, evidence: str) -> DataFrame:
    """Rows of one key merged: largest score, sorted union of evidence, row count. A null key never merges.

    Evidence is exploded and made distinct before it is gathered, so what meets for a key is its distinct evidence only."""
    keyed = df.where(F.col(key).isNotNull())
    sizes = keyed.groupBy(key).agg(F.max(score).alias(score), F.count("*").alias("n_merged"))
    items = keyed.select(key, F.explode(evidence).alias("__item")).groupBy(key).agg(F.array_sort(F.collect_set("__item")).alias("__items"))
    none = F.array().cast(df.schema[evidence].dataType)
    merged = sizes.join(items, key, "left").select(key, score, F.coalesce("__items", none).alias(evidence), "n_merged")
    alone = df.where(F.col(key).isNull()).select(key, score, F.array_sort(F.array_distinct(F.coalesce(F.col(evidence), none))).alias(evidence), F.lit(1).cast("long").alias("n_merged"))
    return merged.unionByName(alone)


def merge_suggestions(df: DataFrame, key: str = "semantic_key") -> DataFrame:
    """Suggestions (id, semantic_key, source, confidence, evidence, ...) merged by key: the row of a deterministic source stays before
    one of a language model, then that of more confidence, then least id; it takes the largest confidence and all evidence."""
    rows = df.withColumn("__llm", F.col("source").contains("llm").cast("int"))
    first = keep_first(rows.withColumn("__low", -F.col("confidence")).where(F.col(key).isNotNull()), [key], ["__llm", "__low", "id"])
    merged = merge_sets(df, key, "confidence", "evidence").where(F.col(key).isNotNull()).withColumnRenamed("confidence", "__most").withColumnRenamed("evidence", "__all").drop("n_merged")
    whole = first.join(merged, key).withColumns({"confidence": F.col("__most"), "evidence": F.col("__all")}).select(*df.columns)
    return whole.unionByName(df.where(F.col(key).isNull()))


def top_k(df: DataFrame, keys: list[str], k: int, count: str = "n") -> DataFrame:
    """The k most frequent keys; ties go to the least key."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).orderBy(F.desc(count), *keys).limit(k)


def add_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not in existing, the first of each key."""
    return keep_first(incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order)


def disambiguate(df: DataFrame, id_col: str, name: str, role: str) -> DataFrame:
    """Display names: the plain name if unique, else name_role if that is, else that with the id's last segment, and if even those
    are equal, with a counter from the second on (by id)."""
    named = F.concat_ws("_", name, role)
    tail = F.concat_ws("_", named, F.regexp_extract(F.col(id_col).cast("string"), "[^:._]+$", 0))
    plain, by_role, by_tail = (F.count("*").over(Window.partitionBy(c)) for c in (F.col(name), named, tail))
    nth = F.row_number().over(Window.partitionBy(tail).orderBy(id_col))
    numbered = F.when((by_tail == 1) | (nth == 1), tail).otherwise(F.concat(tail, F.lit("_"), nth.cast("string")))
    return df.withColumn("display_name", F.when(plain == 1, F.col(name)).when(by_role == 1, named).otherwise(numbered))
