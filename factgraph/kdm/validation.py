"""Integrity rules of the knowledge-discovery model as findings, and regression checks against minimum counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.kdm.model import DATATYPE_CLASSES
from factgraph.operators.matching import duplicate_key, finding, violates

# Tags that a model must not carry.
OBSOLETE_TAGS = [
    "resolved", "target_id", "statement_type", "body_type", "control_type", "condition", "target", "iter", "exception", "value", "targets", "line", "line_start", "line_end", "path", "language",
    "assigned_value", "assigned_type", "resolved_type_qualified_name", "body_id", "callable_body_id", "source_call_name", "constructor_resolution", "constructor_target", "resolution",
    "unresolved_return_value", "unresolved_exception_type_target", "annotation", "function", "method", "class_name", "base_name", "source_class", "kind",
]
FORBIDDEN_TAGS = [
    "body_id", "callable_body_id", "source_call_name", "constructor_resolution", "constructor_target", "resolution", "unresolved_return_value", "unresolved_exception_type_target", "decorators", "decorator_0",
    "declared_type", "resolved_type", "parameter_kind", "parameter_index", "method_kind", "signature", "return_type", "resolved_return_type", "modifiers", "annotations", "json_type", "qualified_signature",
    "source_line", "relationship_type", "called_signature", "resolution_status", "unresolved_target_name", "line_start", "line_end", "assigned_value_kind",
]
ACTIONS = ("ActionElement", "TryUnit", "CatchUnit", "FinallyUnit")
#: Relation -> metaclasses that its target may have.
TARGETS = {
    "Calls": ["CallableUnit", "MethodUnit", "ClassUnit"], "Creates": ["ClassUnit", "CallableUnit"], "Reads": ["StorableUnit"], "Writes": ["StorableUnit"], "Throws": ["StorableUnit"],
    "HasType": DATATYPE_CLASSES, "Extends": ["ClassUnit", "InterfaceUnit"], "Imports": ["CompilationUnit", "Module", "ClassUnit", "CallableUnit", "Package"], "ExceptionFlow": ["CatchUnit"], "ExitFlow": ["FinallyUnit"],
    "HasValue": ["Value", "ActionElement"], "Flow": ["ActionElement", "TryUnit"], "implementation": None, "from": None, "to": None,
}


def validate(node: DataFrame, relation: DataFrame, attribute: DataFrame, region: DataFrame) -> DataFrame:
    """All findings (rule_id, level, element, message)."""
    inventories = node.where("metaclass = 'InventoryModel'").agg(F.count("*").alias("n")).withColumn("element", F.lit("inventory"))
    files = node.where("metaclass = 'SourceFile'").agg(F.count("*").alias("n")).withColumn("element", F.lit("inventory"))
    meta = node.select("id", "metaclass", "parent_id", "kind")
    parent = meta.select(F.col("id").alias("parent_id"), F.col("metaclass").alias("parent_class"))
    placed = meta.where(F.col("metaclass").isin(*ACTIONS)).join(parent, "parent_id", "left")
    # an action's first region tells it from others of its parent; actions without one are told apart by name and kind alone
    at = region.groupBy(F.col("owner_id").alias("id")).agg(F.min(F.struct("path", "start_line", "end_line")).alias("at"))
    same = node.where(F.col("metaclass").isin(*ACTIONS) & F.col("parent_id").isNotNull()).select("id", "parent_id", "metaclass", "name", "kind").join(at, "id", "left")
    target = meta.select(F.col("id").alias("target_id"), F.col("metaclass").alias("target_class"))
    aimed = relation.join(target, "target_id", "left")
    allowed = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in TARGETS.items() if kv[1] for x in kv))
    out = [
        violates("KDM-INV-01", "error", inventories, "element", F.col("n") == 0, "no inventory model"),
        violates("KDM-INV-02", "warning", inventories, "element", F.col("n") > 1, "several inventory models"),
        violates("KDM-INV-03", "error", files, "element", F.col("n") == 0, "no source file"),
        violates("KDM-REG-01", "error", region, "owner_id", F.col("path").isNull(), "region without file"),
        violates("KDM-REG-02", "error", region, "owner_id", F.col("start_line") > F.col("end_line"), "region ends before it starts"),
        duplicate_key("KDM-DUP-01", "error", attribute, ["owner_id", "tag", "value"]),
        duplicate_key("KDM-DUP-02", "error", region, ["owner_id", "path", "start_line", "end_line"]),
        duplicate_key("KDM-DUP-03", "error", node, ["id"]),
        violates("KDM-ACT-01", "error", placed, "id", ~F.coalesce(F.col("parent_class").isin("BlockUnit", *ACTIONS), F.lit(False)), "action outside a block"),
        duplicate_key("KDM-ACT-02", "error", node.where("metaclass = 'BlockUnit' and name = 'body'"), ["parent_id"]),
        duplicate_key("KDM-ACT-03", "error", same.select("parent_id", "metaclass", "name", "kind", "at.*"), ["parent_id", "metaclass", "name", "kind", "path", "start_line", "end_line"]),
        violates("KDM-REL-01", "error", aimed, "owner_id", F.col("target_class").isNull(), F.concat("type", F.lit(" has no target: "), "target_id")),
        violates("KDM-REL-02", "error", aimed, "owner_id", F.col("target_class").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("type")), F.col("target_class")), F.lit(True)), F.concat("type", F.lit(" targets a "), "target_class")),
        violates("KDM-REL-03", "warning", relation, "owner_id", ~F.col("type").isin(*TARGETS), F.concat(F.lit("unknown relation type "), "type")),
        violates("KDM-INV-04", "error", node.where("metaclass = 'SourceFile'"), "id", F.coalesce("name", F.lit("")) == "", "a source file without a path"),
        violates("KDM-BLOCK-01", "warning", node.where("metaclass = 'BlockUnit'"), "id", F.coalesce("name", F.lit("")) != "body", "a block that is not named body"),
        finding("KDM-BLOCK-02", "warning", node.where("metaclass = 'BlockUnit'").join(node.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti"), "id", F.lit("an empty block")),
        violates("KDM-TAG-01", "error", attribute, "owner_id", F.col("tag").isin(*OBSOLETE_TAGS), F.concat(F.lit("obsolete tag "), "tag")),
    ]
    left = lambda kind, types, tag: meta.where(F.col("kind") == kind).select("id").join(relation.where(F.col("type").isin(*types)).select(F.col("owner_id").alias("id")), "id", "left_anti").join(attribute.where(F.col("tag") == tag).select(F.col("owner_id").alias("id")), "id", "left_anti")
    out.append(finding("KDM-RAISE", "error", left("raise", ["Throws"], "exception_flow"), "id", F.lit("raise without Throws or rethrow")))
    out.append(finding("KDM-RETURN", "error", left("return", ["Reads"], "return_flow"), "id", F.lit("return without Reads or void")))
    for kind, flow in (("CatchUnit", "ExceptionFlow"), ("FinallyUnit", "ExitFlow")):
        bare = meta.where(F.col("metaclass") == kind).select("id").join(relation.where(F.col("type") == flow).select(F.col("target_id").alias("id")), "id", "left_anti")
        out.append(finding(f"KDM-{flow}", "error", bare, "id", F.lit(f"{kind} without {flow}")))
    return reduce(DataFrame.unionByName, out)


def regression(node: DataFrame, relation: DataFrame, attribute: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """Forbidden tags, actions directly under callables, and metaclasses below their minimum count."""
    meta = node.select(F.col("id").alias("parent_id"), F.col("metaclass").alias("parent_class"))
    direct = node.where("metaclass = 'ActionElement'").join(meta, "parent_id").where("parent_class in ('MethodUnit', 'CallableUnit')")
    counts = node.select("metaclass").unionByName(relation.select(F.col("type").alias("metaclass"))).groupBy("metaclass").agg(F.count("*").alias("n"))
    least = node.sparkSession.createDataFrame(list(minimum.items()) or [("Segment", 0)], "metaclass string, least long")
    few = least.join(counts, "metaclass", "left").where(F.coalesce("n", F.lit(0)) < F.col("least"))
    return (
        violates("REG-TAG", "error", attribute, "owner_id", F.col("tag").isin(*FORBIDDEN_TAGS), F.concat(F.lit("forbidden tag "), "tag"))
        .unionByName(finding("REG-ACTION", "error", direct, "id", F.lit("action directly under a callable")))
        .unionByName(finding("REG-COUNT", "error", few, "metaclass", F.concat(F.lit("fewer than "), F.col("least").cast("string"))))
    )
