"""Multiset matching, integrity findings and review overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """0-based ordinal of each row among the rows of its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def multiset_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], right_id: str) -> DataFrame:
    """left with matched_id: the n-th left row of a key takes the n-th right row; the rest stay unmatched."""
    numbered = occurrence(right, keys, right_order).select(*keys, "occurrence", F.col(right_id).alias("matched_id"))
    return occurrence(left, keys, left_order).join(numbered, [*keys, "occurrence"], "left").select(*left.columns, "occurrence", "matched_id")


def match_status(matched: DataFrame, owner: str) -> DataFrame:
    """matched, unmatched or partially_matched for each owner."""
    n, hit = F.count("*"), F.count("matched_id")
    status = F.when(F.col("n_matched") == F.col("n_calls"), "matched").when(F.col("n_matched") == 0, "unmatched").otherwise("partially_matched")
    return matched.groupBy(owner).agg(n.alias("n_calls"), hit.alias("n_matched")).withColumn("status", status)


def missing_reference(rule: str, level: str, df: DataFrame, element: str, column: str, known: DataFrame, known_col: str) -> DataFrame:
    """Findings for rows whose column is not in known."""
    dim = known.select(F.col(known_col).alias("__known")).distinct()
    lost = df.where(F.col(column).isNotNull()).join(dim, F.col(column) == F.col("__known"), "left_anti")
    return finding(rule, level, lost, element, F.concat(F.lit(f"{column} not found: "), F.col(column).cast("string")))


def duplicate_key(rule: str, level: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """One finding for each key that occurs more than once."""
    many = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return finding(rule, level, many.withColumn("__key", F.concat_ws("|", *keys)), "__key", F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")))


def violates(rule: str, level: str, df: DataFrame, element: str, test: Column, message: Column | str) -> DataFrame:
    """Findings for rows for which test is true."""
    return finding(rule, level, df.where(test), element, F.lit(message) if isinstance(message, str) else message)


def finding(rule: str, level: str, df: DataFrame, element: str, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), F.col(element).cast("string").alias("element"), message.alias("message"))


def apply_overrides(base: DataFrame, overrides: DataFrame, key: str, fields: list[str], order: list[str] = ()) -> DataFrame:
    """A merge by key: fields take the override's non-null values, and overrides of unknown keys are added.

    Several overrides of one key are reduced to one first: of each field the last non-null value in `order` (columns of overrides;
    ties and no order: the largest value). A null key overrides nothing."""
    known = overrides.where(F.col(key).isNotNull())
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__v"))))["__v"].alias(c) for c in overrides.columns if c != key and c not in order]
    one = known.groupBy(key).agg(*last) if last else known.select(key).distinct()
    new = one.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in fields))
    merged = base.join(new, F.col(key) == F.col("__key"), "left").select(
        *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns), F.when(F.col("__key").isNotNull(), "reviewed").otherwise("unchanged").alias("review_status")
    )
    added = one.join(base.select(key).distinct(), key, "left_anti")
    added = added.select(*(F.col(c) if c in one.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns), F.lit("added").alias("review_status"))
    return merged.unionByName(added)


def apply_decisions(base: DataFrame, overrides: DataFrame, key: str, fields: list[str], promote: bool = False) -> DataFrame:
    """Reviewers' decisions on rows (key, materialize, review_status, ...): overrides have key, decision, `fields` and, with promote,
    promote_to_architectural.

    accepted and rejected set materialize; a field that is given replaces the row's; promotion keeps the former
    relationship_level as source_level and makes the relationship architectural. Of these the last one names review_status.
    Overrides of unknown keys change nothing."""
    names = ["decision", *fields, *(["promote_to_architectural"] if promote else [])]
    one = overrides.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(c).alias(f"__{c}") for c in names)).withColumnRenamed(key, "__key")
    rows = base.join(one, F.col(key) == F.col("__key"), "left")
    given = F.lit(False)
    for c in fields:
        given = given | F.col(f"__{c}").isNotNull()
    up = F.coalesce(F.col("__promote_to_architectural"), F.lit(False)) if promote else F.lit(False)
    live = F.when(up, True).when(F.col("__decision") == "accepted", True).when(F.col("__decision") == "rejected", False).otherwise(F.col("materialize"))
    status = F.when(up, "user_promoted").when(given, "user_modified").when(F.col("__decision") == "accepted", "user_accepted").when(F.col("__decision") == "rejected", "user_rejected").otherwise(F.col("review_status"))
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields} | {"materialize": live, "review_status": status}
    if promote:
        level = new.get("relationship_level", F.col("relationship_level"))
        new |= {"source_level": F.when(up, F.coalesce(level, F.lit("technical"))).otherwise(F.col("source_level")), "relationship_level": F.when(up, "architectural").otherwise(level)}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in base.columns))
