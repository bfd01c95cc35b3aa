"""Review rules over components, loops, subsystems and relationships: one query per rule, united as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.matching import duplicate_key, finding, violates
from factgraph.rules import tables as R


def _live(df: DataFrame) -> DataFrame:
    """Rows that are materialised; a missing flag means yes."""
    return df.where(F.coalesce("materialize", F.lit(True)))


def component_findings(components: DataFrame, known_code: DataFrame | None = None) -> DataFrame:
    """ARV-F-01, F-02, W-02, W-03, W-04, W-08, OK-01, OK-02. A component with an invalid role gets no further findings."""
    bad = ~F.coalesce(F.col("role").isin(*R.ALLOWED_ROLES), F.lit(False))
    live = _live(components)
    fine = live.where(~bad)
    accepted = F.col("review_status") == "accepted"
    out = [
        violates("ARV-F-01", "forbidden", live, "id", bad, "role is not allowed"),
        duplicate_key("ARV-F-02", "forbidden", live, ["id"]),
        violates("ARV-W-02", "warning", fine, "id", F.size(F.coalesce("implemented_by", F.array().cast("array<string>"))) == 0, "no implementation"),
        violates("ARV-W-08", "warning", fine, "id", accepted & (F.col("confidence") < 0.6), "accepted with low confidence"),
        violates("ARV-OK-01", "ok", fine, "id", accepted, "accepted"),
        violates("ARV-OK-02", "ok", components, "id", ~F.coalesce("materialize", F.lit(True)), "not materialised"),
    ]
    code = fine.select("id", "role", F.explode("implemented_by").alias("code"))
    many = code.groupBy("code").agg(F.array_sort(F.collect_set("role")).alias("roles")).where("size(roles) > 1")
    out.append(finding("ARV-W-04", "warning", many, "code", F.concat(F.lit("roles: "), F.array_join("roles", ", "))))
    if known_code is not None and not known_code.isEmpty():
        lost = code.join(known_code.select(F.col("id").alias("code")).distinct(), "code", "left_anti")
        out.append(finding("ARV-W-03", "warning", lost, "id", F.concat(F.lit("unknown code element "), "code")))
    return reduce(DataFrame.unionByName, out)


def edge_findings(edges: DataFrame, components: DataFrame) -> DataFrame:
    """ARV-F-03 to F-05, F-07, F-08, F-10, W-05, W-06, W-07, OK-04. Of the forbidding rules only the first that fails speaks."""
    node = components.groupBy("id").agg(F.min("role").alias("role"), F.bool_or(F.coalesce("materialize", F.lit(True))).alias("live"))
    s = node.select(F.col("id").alias("source"), F.col("role").alias("s_role"), F.col("live").alias("s_live"))
    t = node.select(F.col("id").alias("target"), F.col("role").alias("t_role"), F.col("live").alias("t_live"))
    rows = _live(edges).join(s, "source", "left").join(t, "target", "left")
    stop = (
        F.when(F.col("s_live").isNull(), "ARV-F-03").when(F.col("t_live").isNull(), "ARV-F-04").when(~F.col("s_live") | ~F.col("t_live"), "ARV-F-05")
        .when(~F.coalesce(F.col("type").isin(*R.ALLOWED_RELATIONS), F.lit(False)), "ARV-F-08")
    )
    rows = rows.withColumn("stop", stop)
    blocked = rows.where("stop is not null").select(F.col("stop").alias("rule_id"), F.lit("forbidden").alias("level"), F.col("id").alias("element"), F.concat_ws(" -> ", "source", "target").alias("message"))
    fine = rows.where("stop is null")
    flow = F.col("type") == "mapek_flow"
    pair = F.concat_ws(">", "s_role", "t_role")
    standard = pair.isin([f"{a}>{b}" for a, b in R.STANDARD_FLOW])
    out = [
        blocked,
        violates("ARV-F-07", "forbidden", fine, "id", (F.col("type") == "uses_knowledge") & (F.coalesce("t_role", F.lit("")) != "Knowledge"), "the target is not Knowledge"),
        duplicate_key("ARV-F-10", "forbidden", _live(edges), ["source", "type", "target"]),
        violates("ARV-W-05", "warning", fine, "id", flow & ~standard & (pair != "Monitor>Executor"), "unusual flow"),
        violates("ARV-W-06", "warning", fine, "id", flow & (pair == "Monitor>Executor"), "the flow skips roles"),
        violates("ARV-W-07", "warning", fine, "id", (F.col("source_level") == "technical") & (F.col("relationship_level") == "architectural"), "technical relationship promoted"),
        violates("ARV-OK-04", "ok", fine, "id", F.col("review_status") == "accepted", "accepted"),
    ]
    return reduce(DataFrame.unionByName, out)


def loop_findings(loops: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """ARV-F-06, F-09, W-01, W-09, W-10, W-11 over loops (id, level, materialize) and members (loop_id, component_id)."""
    live = _live(loops).select(F.col("id").alias("loop_id"), "level")
    node = components.groupBy("id").agg(F.min("role").alias("role"), F.bool_or(F.coalesce("materialize", F.lit(True))).alias("live")).withColumnRenamed("id", "component_id")
    rows = live.join(members.select("loop_id", "component_id").distinct(), "loop_id").join(node, "component_id")
    kept = rows.where("live")
    per_loop = live.join(kept.groupBy("loop_id").agg(F.collect_set("role").alias("roles")), "loop_id", "left")
    core = F.array(*map(F.lit, R.CORE_ROLES))
    missing = F.array_sort(F.array_except(core, F.coalesce("roles", F.array().cast("array<string>"))))
    per_loop = per_loop.withColumn("missing", missing)
    twice = kept.where(F.col("role").isin(*R.SINGLE_ROLES)).groupBy("loop_id", "role").agg(F.count("*").alias("n")).where("n > 1")
    shared = kept.where("role = 'Knowledge'").groupBy("component_id").agg(F.countDistinct("loop_id").alias("n")).where("n > 1")
    several = live.agg(F.count("*").alias("n_loops"))
    out = [
        finding("ARV-F-06", "forbidden", rows.where("not live"), "loop_id", F.concat(F.lit("member is not materialised: "), "component_id")),
        violates("ARV-F-09", "forbidden", per_loop, "loop_id", F.col("roles").isNull(), "no materialised components"),
        finding("ARV-W-01", "warning", per_loop.where("size(missing) > 0"), "loop_id", F.concat(F.lit("missing: "), F.array_join("missing", ", "))),
        finding("ARV-W-09", "warning", twice, "loop_id", F.concat(F.lit("several of role "), "role")),
        finding("ARV-W-10", "warning", shared, "component_id", F.lit("Knowledge of several loops")),
        violates("ARV-W-11", "warning", live.crossJoin(several), "loop_id", (F.col("n_loops") > 1) & F.col("level").isNull(), "no hierarchy level"),
    ]
    return reduce(DataFrame.unionByName, out)


def subsystem_findings(members: DataFrame, components: DataFrame) -> DataFrame:
    """ARV-W-12: subsystems (subsystem_id, component_id) that mix managing and managed roles."""
    rows = members.join(_live(components).select(F.col("id").alias("component_id"), "role"), "component_id")
    mixed = rows.groupBy("subsystem_id").agg(F.bool_or(F.col("role").isin(*R.MANAGING_ROLES)).alias("a"), F.bool_or(F.col("role").isin(*R.MANAGED_ROLES)).alias("b"))
    return violates("ARV-W-12", "warning", mixed, "subsystem_id", F.col("a") & F.col("b"), "managing and managed elements")


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings by level, and whether none forbids."""
    n = lambda level: F.count_if(F.col("level") == level)
    return findings.agg(n("ok").alias("n_ok"), n("warning").alias("n_warning"), n("forbidden").alias("n_forbidden"), (n("forbidden") == 0).alias("valid"))
