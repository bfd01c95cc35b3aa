"""The common schema: fields, callables and class relations of any source language in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators import selection

Tables = dict[str, DataFrame]


def type_columns(c: Column) -> dict[str, Column]:
    """resolved, raw and arguments of a type mention."""
    full = names.normal_type(c)
    return {"resolved_type": full, "raw_type": names.raw_type(full), "type_arguments": names.type_arguments(full)}


def fields(t: Tables) -> DataFrame:
    """(qualified_name, class_id, name, kind, type, resolved_type, raw_type, type_arguments, line_start, line_end): one row for each class or
    instance attribute, however often it is assigned: the first type that is known, and the extremes of its lines."""
    v = t["variable"].where("scope in ('class_attribute', 'instance_attribute')")
    qn = F.concat_ws(".", F.regexp_replace("owner_id", "^class:", ""), "name")
    rows = v.select(qn.alias("qualified_name"), F.col("owner_id").alias("class_id"), "name", F.col("scope").alias("kind"), F.coalesce("annotation", "assigned_type").alias("type"), "ord", F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    merged = selection.merge_fields(rows, "qualified_name", "ord", ["class_id", "name", "kind", "type"], ["line_start"], ["line_end"])
    return merged.withColumns(type_columns(F.col("type")))


def signatures(t: Tables) -> DataFrame:
    """(callable_id, signature, return_type, resolved_return_type): name and raw parameter types (their names where untyped), without
    self and cls."""
    text = F.coalesce(names.raw_type(names.normal_type(F.col("annotation"))), F.col("name"))
    p = t["parameter"].where("name not in ('self', 'cls')").groupBy("callable_id").agg(F.array_sort(F.collect_list(F.struct("idx", text.alias("text")))).alias("ps"))
    rows = t["callable_fact"].join(p, "callable_id", "left")
    listed = F.array_join(F.transform(F.coalesce("ps", F.array().cast("array<struct<idx:int,text:string>>")), lambda x: x["text"]), ",")
    return rows.select("callable_id", F.concat("name", F.lit("("), listed, F.lit(")")).alias("signature"), F.col("return_annotation").alias("return_type"), names.normal_type(F.col("return_annotation")).alias("resolved_return_type"))


def class_relations(classes: DataFrame) -> DataFrame:
    """(class_id, relation, target): each base of classes (class_id, qn, name, bases, is_interface) as extends or implements: a base that
    is a known interface, Protocol or ABC is implemented. A base that names a class of the project becomes its id."""
    known = classes.groupBy("name").agg(F.min(F.struct("qn", "class_id", "is_interface")).alias("k")).select(F.col("name").alias("base"), F.col("k.class_id").alias("target_id"), F.col("k.is_interface").alias("known_interface"))
    rows = classes.select("class_id", F.explode("bases").alias("base")).join(known, "base", "left")
    is_interface = F.col("base").isin("Protocol", "ABC") | F.coalesce("known_interface", F.lit(False))
    return rows.select("class_id", F.when(is_interface, "implements").otherwise("extends").alias("relation"), F.coalesce("target_id", F.concat(F.lit("external:"), "base")).alias("target"))
