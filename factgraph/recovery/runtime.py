"""Runtime evidence against the code model: name resolution, new call edges, explained calls, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators.cascade import candidates


def normalised(name: Column) -> Column:
    """A runtime name in the form of qualified names: - as _, slashes as dots."""
    return F.translate(name, "-/\\", "_..")


def resolve_endpoints(seen: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """seen (name) with target_id, classification and tier: exact, then the normalised name, then a unique element that ends in the
    whole name, then one that ends in its last two segments, else null.

    known (id, qn). Every proper suffix of a known name is a key, so a suffix test is an equi-join; several matches leave the
    name to the next tier."""
    norm = normalised(F.col("qn"))
    parts = F.split(norm, r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    whole = known.select(F.lit("exact").alias("space"), F.col("qn").alias("key"), "id").unionByName(known.select(F.lit("normal").alias("space"), norm.alias("key"), "id"))
    dimension = whole.unionByName(known.where(F.size(parts) > 1).select(F.lit("suffix").alias("space"), F.explode(tails).alias("key"), "id"))
    dim = candidates(dimension, ["space", "key"], "id")
    dim = dim.withColumn("first", F.col("first").cast("string")).where("space <> 'suffix' or n = 1")  # an exact name takes the least id
    names_ = seen.select(F.col(name).alias("__name")).distinct()
    n = normalised(F.col("__name"))
    asked = [("exact", "exact", F.col("__name")), ("normal", "normal", n), ("suffix", "suffix", n), ("two", "suffix", F.when(n.contains("."), names.suffix(n, 2)))]
    rows = names_.select("__name", F.explode(F.array(*(F.struct(F.lit(k).alias("tier"), F.lit(space).alias("space"), key.alias("key"), F.lit(label).alias("label")) for k, (label, space, key) in enumerate(asked)))).alias("a")).select("__name", "a.*")
    hit = rows.join(dim, ["space", "key"]).groupBy("__name").agg(F.min(F.struct("tier", "label", "first")).alias("h"))
    out = seen.join(hit, F.col(name) == F.col("__name"), "left")
    return out.select(*seen.columns, F.coalesce("h.label", F.lit("unresolved")).alias("classification"), F.col("h.first").alias("target_id"))


def component_names(seen: DataFrame, implemented: DataFrame, name: str = "name") -> DataFrame:
    """(name, component) of runtime names: the components whose reference is the name; if there are none, all whose normalised
    reference equals the name, is a dotted tail of it, has it as a tail, or shares its last two segments.

    implemented (reference, component). Each test is an equi-join of its own space of keys, so only rows that fit meet: a last segment
    that all names share is a tail on both sides, which is no test. Both sides grow with the input, and keys are more than the
    optimizer guesses, so no side may be broadcast (merge hints)."""

    def keyed(df: DataFrame, text: Column, whole: list[str], tail: str, *more: str) -> DataFrame:
        """Keys by space: the whole text in the given spaces, its tails in one of them, its last two segments in a third."""
        parts = F.split(normalised(text), r"\.")
        key = lambda space, k: F.struct(F.lit(space).alias("space"), k.alias("key"))
        tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: key(tail, F.array_join(F.slice(parts, k, F.size(parts)), ".")))
        two = F.when(F.size(parts) >= 2, key("two", F.array_join(F.slice(parts, -2, 2), ".")))
        keys = F.concat(F.array_compact(F.array(*(key(space, F.array_join(parts, ".")) for space in whole), two)), F.when(F.size(parts) >= 2, tails).otherwise(F.array().cast("array<struct<space:string,key:string>>")))
        return df.select(*more, F.explode(keys).alias("k")).select(*more, "k.space", "k.key")

    asked = seen.select(F.col(name).alias("name")).where("name is not null").distinct()
    exact = asked.join(implemented.select(F.col("reference").alias("name"), "component").hint("merge"), "name").distinct()
    # in "in" a name or its tails meet a whole reference, in "out" a name meets the tails of a reference
    a = keyed(asked.join(exact.select("name").distinct().hint("merge"), "name", "left_anti"), F.col("name"), ["in", "out"], "in", "name")
    b = keyed(implemented, F.col("reference"), ["in"], "out", "component")
    return exact.unionByName(a.join(b.hint("merge"), ["space", "key"]).select("name", "component")).distinct()


def runtime_call_actions(edges: DataFrame, known: DataFrame, static: DataFrame) -> DataFrame:
    """(source_id, target_id) of runtime edges (source, target) between known callables that no static call has."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    ids = resolve_endpoints(ends, known).where("target_id is not null").select("name", F.col("target_id").alias("id"))
    named = edges.select("source", "target").distinct().join(ids.toDF("source", "source_id"), "source").join(ids.toDF("target", "target_id"), "target")
    have = static.select(F.col("source").alias("source_id"), F.col("target").alias("target_id")).distinct()
    return named.select("source_id", "target_id").distinct().join(have, ["source_id", "target_id"], "left_anti")


def unexplained(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved static calls (source, target) whose last segments no runtime edge has: a left anti join on suffix keys."""
    keyed = lambda df: df.withColumn("__s", names.last_segment(F.col("source"))).withColumn("__t", names.last_segment(F.col("target")))
    return keyed(calls).join(keyed(edges).select("__s", "__t").distinct(), ["__s", "__t"], "left_anti").select(*calls.columns)


def summary(edges: DataFrame, owner: DataFrame, k: int = 20, pairs: int = 25) -> dict[str, DataFrame]:
    """Totals by scenario, the most frequent sources and targets, and the most frequent pairs of owners (name, component).

    Ties go to the least name. Edges with an end that no component owns are counted as unmapped."""
    top = lambda c: edges.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)
    a, b = owner.toDF("source", "source_component"), owner.toDF("target", "target_component")
    mapped = edges.join(a, "source", "left").join(b, "target", "left")
    both = mapped.where("source_component is not null and target_component is not null")
    return {
        "by_scenario": edges.groupBy("scenario").agg(F.count("*").alias("n")),
        "sources": top("source"),
        "targets": top("target"),
        "pairs": both.groupBy("source_component", "target_component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_component", "target_component").limit(pairs),
        "unmapped": mapped.agg(F.count_if(F.col("source_component").isNull() | F.col("target_component").isNull()).alias("n_unmapped")),
    }
