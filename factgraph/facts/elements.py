"""Flat elements, data edges, interfaces, external types, packages and edge locations of the fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators import graphs, selection

Tables = dict[str, DataFrame]


def elements(t: Tables, project: str) -> DataFrame:
    """(id, kind, name, parent_id, qualified_name, safe_name): every project, module, class, callable, attribute, context variable
    and body node; the first row of an id in walk order wins."""
    one = t["module"].sparkSession.range(1)

    def rows(df: DataFrame, walk: int, kind, id_, name, parent, qn, ord_) -> DataFrame:
        return df.select(F.lit(walk).alias("walk"), ord_.cast("long").alias("ord"), id_.alias("id"), kind.alias("kind"), name.alias("name"), parent.cast("string").alias("parent_id"), qn.alias("qualified_name"))

    root = F.lit(f"project:{project}")
    c, v, b = t["callable_fact"], t["variable"].where("scope <> 'local'"), t["body_node"]
    attribute = F.concat_ws(".", F.regexp_replace("owner_id", "^class:", ""), "name")
    with_items = b.where("control_type in ('with', 'async_with')").select("node_id", "walk_ord", F.explode(F.filter("targets", lambda x: x != "")).alias("name"))
    context = F.concat(F.lit("variable:"), "node_id", F.lit("."), "name")
    out = [
        rows(one, 0, F.lit("project"), root, F.lit(project), F.lit(None), F.lit(project), F.lit(0)),
        rows(t["module"], 1, F.lit("module"), F.col("module_id"), F.col("name"), root, F.col("qn"), F.lit(0)),
        rows(t["class_fact"], 2, F.lit("class"), F.col("class_id"), F.col("name"), F.col("module_id"), F.col("qn"), F.col("ord")),
        rows(v, 3, F.lit("attribute"), F.concat(F.lit("attribute:"), attribute), F.col("name"), F.col("owner_id"), attribute, F.col("ord")),
        rows(c, 4, F.when(F.col("class_id").isNull(), "function").otherwise("method"), F.col("callable_id"), F.col("name"), F.coalesce("class_id", "module_id"), F.col("qn"), F.col("ord")),
        rows(with_items, 5, F.lit("context_variable"), context, F.col("name"), F.col("node_id"), F.col("name"), F.col("walk_ord")),
        rows(b, 6, F.coalesce("statement_type", "control_type", "type"), F.col("node_id"), F.coalesce("statement_type", "control_type", "type"), F.when(F.col("depth") == 0, F.col("callable_id")).otherwise(F.col("parent_id")), F.col("node_id"), F.col("walk_ord")),
    ]
    first = selection.keep_first(reduce(DataFrame.unionByName, out), ["id"], ["walk", "ord"])
    return first.select("id", "kind", "name", "parent_id", "qualified_name", names.safe_name(F.col("qualified_name")).alias("safe_name"))


def packages(t: Tables, imports: DataFrame) -> DataFrame:
    """(prefix, parent) of every dotted package prefix of modules and resolved imports."""
    used = t["module"].select("qn").unionByName(imports.where("classification = 'external'").select(F.coalesce("module", "name").alias("qn")))
    return graphs.prefixes(used.select(F.regexp_replace("qn", r"\.?[^.]*$", "").alias("qn")).where("qn <> ''"), "qn")


def data_edges(t: Tables) -> DataFrame:
    """(type, source, target, line): writes, reads, creates, throws and uses_type from the body nodes and annotations.

    Names that no attribute of the class has become local_or_unresolved targets; constructor-like callees give creates."""
    b = t["body_node"].select("callable_id", "statement_type", "targets", "value", "value_kind", "condition", "iter", "exception", F.col("line_start").alias("line"))
    own = t["callable_fact"].select("callable_id", "class_id")
    fields = t["variable"].where("scope = 'instance_attribute'").select(F.col("owner_id").alias("class_id"), F.col("name").alias("field")).distinct()
    written = b.where("statement_type in ('assignment', 'annotated_assignment')").select("callable_id", F.lit("writes").alias("type"), F.explode("targets").alias("key"), "line")
    read = b.select("callable_id", F.lit("reads").alias("type"), F.explode(names.identifiers(F.concat_ws(" ", F.when(F.col("value_kind") != "literal", F.col("value")), "condition", "iter"))).alias("key"), "line")
    both = written.unionByName(read).where(~F.col("key").isin("and", "or", "not", "in", "is", "True", "False", "None", "self"))
    both = both.join(own, "callable_id", "left").withColumn("field", F.when(F.col("key").startswith("self."), F.get(F.split("key", r"\."), F.lit(1))).otherwise(F.substring_index("key", ".", 1)))
    known = fields.withColumn("known", F.lit(True))
    both = both.join(known, ["class_id", "field"], "left")
    target = F.when(F.col("known"), F.concat(F.regexp_replace("class_id", "^class:", ""), F.lit("."), "field")).otherwise(F.concat(F.lit("local_or_unresolved:"), "field"))
    out = both.select("type", F.col("callable_id").alias("source"), target.alias("target"), "line")
    classes = t["class_fact"].groupBy(F.col("name").alias("callee")).agg(F.min("qn").alias("target"))
    made = b.where("value_kind = 'call_result'").select("callable_id", names.last_segment(F.col("value")).alias("callee"), "line").join(classes, "callee")
    thrown = b.where("statement_type = 'raise' and exception is not null").select(F.lit("throws").alias("type"), F.col("callable_id").alias("source"), F.col("exception").alias("target"), "line")
    typed = t["parameter"].where(names.is_valid_type(F.col("annotation"))).select(F.lit("uses_type").alias("type"), F.col("callable_id").alias("source"), F.col("annotation").alias("target"), "line")
    created = made.select(F.lit("creates").alias("type"), F.col("callable_id").alias("source"), "target", "line")
    return out.unionByName(created).unionByName(thrown).unionByName(typed).dropDuplicates(["type", "source", "target", "line"])


def interfaces(t: Tables) -> DataFrame:
    """class_fact with is_interface: a base Protocol or ABC, or at least one method and all of them abstract-like: decorated so, or
    with a body that is empty or only pass, ..., or raise NotImplemented. __init__, __repr__ and __str__ never are."""
    body = t["body_node"].groupBy("callable_id").agg(F.count("*").alias("n"), F.first("statement_type").alias("s"), F.first("exception").alias("e"), F.first("value").alias("v"))
    methods = t["callable_fact"].where("class_id is not null").join(body, "callable_id", "left")
    marked = F.exists("decorators", lambda d: d.endswith("abstractmethod"))
    stub = F.col("n").isNull() | ((F.col("n") == 1) & ((F.col("s") == "pass") | ((F.col("s") == "raise") & F.coalesce(F.col("e").contains("NotImplemented"), F.lit(False))) | ((F.col("s") == "expression") & F.coalesce(F.col("v").isin("...", "Ellipsis"), F.lit(False)))))
    like = ~F.col("name").isin("__init__", "__repr__", "__str__") & (marked | stub)
    abstract = methods.groupBy("class_id").agg(F.bool_and(F.coalesce(like, F.lit(False))).alias("all_abstract"))
    out = t["class_fact"].join(abstract, "class_id", "left")
    return out.withColumn("is_interface", F.arrays_overlap("bases", F.array(F.lit("Protocol"), F.lit("ABC"))) | F.coalesce("all_abstract", F.lit(False))).drop("all_abstract")


def external_types(t: Tables, data: DataFrame) -> DataFrame:
    """(name, n_mentions) of plausible types that no class of the project has: annotations, bases, thrown and used types."""
    mention = lambda df, c: df.select(F.col(c).alias("name"))
    all_ = mention(t["parameter"], "annotation").unionByName(mention(t["callable_fact"], "return_annotation")).unionByName(t["class_fact"].select(F.explode("bases").alias("name"))).unionByName(mention(data.where("type in ('throws', 'uses_type')"), "target"))
    good = all_.where(names.is_valid_type(F.col("name")) & names.is_plausible_external(F.col("name")))
    inside = t["class_fact"].select(F.col("name")).unionByName(t["class_fact"].select(F.col("qn").alias("name"))).distinct()
    return good.join(inside, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n_mentions"))


def located(edges: DataFrame, index: DataFrame) -> DataFrame:
    """edges whose missing line comes from the location (id, line) of their source, by id or by id without its prefix, else of their
    target in the same way."""
    bare = lambda c: F.regexp_replace(c, "^[a-z_]+:", "")
    exact = index.groupBy("id").agg(F.min("line").alias("at"))
    loose = index.groupBy(bare(F.col("id")).alias("id")).agg(F.min("line").alias("at"))
    out = edges
    for k, end in enumerate(("source", "target")):
        out = out.join(exact.select(F.col("id").alias(end), F.col("at").alias(f"__e{k}")), end, "left")
        out = out.withColumn("__bare", bare(F.col(end))).join(loose.select(F.col("id").alias("__bare"), F.col("at").alias(f"__l{k}")), "__bare", "left").drop("__bare")
    return out.withColumn("line", F.coalesce("line", "__e0", "__l0", "__e1", "__l1")).select(*edges.columns)


def traced(edges: DataFrame, runtime: DataFrame, element: str, most_edges: int = 30, most_runtime: int = 20, suggestions: DataFrame | None = None) -> DataFrame:
    """What touches one element: up to 30 static edges and 20 runtime edges whose names contain each other, in a stable order, and
    the suggestions (id, affected, message) that name it."""
    static = edges.where((F.col("source") == element) | (F.col("target") == element)).orderBy("type", "source", "target").limit(most_edges)
    name = F.lit(element.partition(":")[2] or element)
    near = lambda c: F.col(c).contains(name) | name.contains(F.col(c))
    seen = runtime.where(near("source") | near("target")).orderBy("source", "target").limit(most_runtime)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "source", "target")
    out = pick(static, "static").unionByName(pick(seen, "runtime"))
    if suggestions is not None:
        named = suggestions.where(F.array_contains("affected", element) | F.col("message").contains(element))
        out = out.unionByName(named.select(F.lit("suggestion").alias("kind"), F.col("id").alias("source"), F.lit(element).alias("target")))
    return out


def architectural(edges: DataFrame) -> DataFrame:
    """Relationships of the architectural level: those that say so, or name no level and are materialised."""
    level = F.col("relationship_level")
    return edges.where((level == "architectural") | (level.isNull() & F.coalesce("materialize", F.lit(True))))


def reference_like(c) -> Column:
    """Whether a value's text is a name or dotted name, and no literal or keyword."""
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$") & ~c.isin("True", "False", "None")


def external_calls(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls that a model stubs as external: those classified so whose library an import of their module names, and no builtin."""
    seen = imports.where("classification = 'external'").select("module_id", F.coalesce("alias", F.when(F.col("import_type") == "from_import", F.col("name")), F.substring_index("module", ".", 1)).alias("root")).distinct()
    rows = calls.where("classification = 'external'").withColumn("root", F.substring_index("name", ".", 1))
    return rows.join(seen, ["module_id", "root"], "left_semi").drop("root")
