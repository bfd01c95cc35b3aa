"""Edges, closures and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.lineage import cut


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth): every ancestor at its least depth, however deep. Cycles end because a pair that is known is not
    added again.

    Semi-naive: each round joins only the pairs that the last one found, until there are none. The loop runs on the driver, but
    only whether a round found pairs comes back."""
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    step = cut(step)
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next"))
    known = new = step.withColumn("depth", F.lit(1))
    d = 1
    while not new.isEmpty():
        d += 1
        found = new.select("node", "ancestor").join(up, "ancestor").select("node", F.col("__next").alias("ancestor")).distinct()
        new = cut(found.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(new)
        if d % 16 == 0:  # deep graphs: one table instead of a union of many
            known = cut(known)
    return known


def levels(edges: DataFrame, roots: DataFrame, root: str, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, level): breadth-first level from the roots; the first visit wins. Each round joins the last level only, and only
    nodes that no round has visited go on."""
    down = cut(edges.select(F.col(parent).alias("node"), F.col(child).alias("__next")).where("node is not null and __next is not null").distinct())
    known = new = cut(roots.select(F.col(root).alias("node"), F.lit(0).alias("level")).where("node is not null").distinct())
    d = 0
    while not new.isEmpty():
        d += 1
        found = new.join(down, "node").select(F.col("__next").alias("node")).distinct()
        new = cut(found.join(known.select("node"), "node", "left_anti").withColumn("level", F.lit(d)))
        known = known.unionByName(new)
        if d % 16 == 0:
            known = cut(known)
    return known


def prefixes(df: DataFrame, column: str, separator: str = ".", name: str = "prefix") -> DataFrame:
    """(prefix, parent): every dotted prefix of the column once, with the prefix above it."""
    parts = F.split(F.col(column), F.concat(F.lit(r"\Q"), F.lit(separator), F.lit(r"\E")), -1)
    each = df.where(F.col(column).isNotNull()).select(parts.alias("__p")).distinct().select("__p", F.explode(F.sequence(F.lit(1), F.size("__p"))).alias("__n"))
    join = lambda n: F.array_join(F.slice("__p", F.lit(1), n), separator)
    return each.select(join(F.col("__n")).alias(name), F.when(F.col("__n") > 1, join(F.col("__n") - 1)).alias("parent")).distinct()


def aggregate_edges(edges: DataFrame, source: str = "source", target: str = "target", relation: str = "type") -> DataFrame:
    """One aggregated relationship per (source, target): its sorted relation kinds and its density."""
    return edges.groupBy(source, target).agg(F.array_sort(F.collect_set(relation)).alias("relations"), F.count("*").alias("density"))


def consecutive(df: DataFrame, group: list[str], order: list[str], role: str, skip_equal: bool = True) -> DataFrame:
    """(group..., source, target) of neighbouring rows in the given order; equal neighbours are skipped."""
    pairs = df.withColumn("target", F.lead(role).over(Window.partitionBy(*group).orderBy(*order))).withColumnRenamed(role, "source")
    pairs = pairs.where("target is not null")
    return (pairs.where("source <> target") if skip_equal else pairs).select(*group, "source", "target")


def call_pairs(trace: DataFrame, thread: list[str], order: str, kind: str = "type", name: str = "qualified_name") -> DataFrame:
    """(source, target) of calls by depth: a call's caller is the last open call of its thread that is one level up.

    The depth is a running sum of +1 per call and -1 per return; the caller is the latest call at depth - 1. Both are window
    functions over the thread's event order, without user code."""
    calls = F.when(F.col(kind) == "call", 1).when(F.col(kind) == "return", -1).otherwise(0)
    run = Window.partitionBy(*thread).orderBy(order)
    rows = trace.withColumn("__depth", F.sum(calls).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col(kind) == "call")
    both = rows.select(*thread, order, F.col(name).alias("target"), F.col("__depth").alias("level"), F.lit(False).alias("opens"))
    both = both.unionByName(rows.select(*thread, order, F.col(name).alias("target"), (F.col("__depth") + 1).alias("level"), F.lit(True).alias("opens")))
    at = Window.partitionBy(*thread, "level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    caller = F.last(F.when(F.col("opens"), F.col("target")), ignorenulls=True).over(at)
    return both.withColumn("source", caller).where("not opens and source is not null").select(*thread, order, "source", "target")
