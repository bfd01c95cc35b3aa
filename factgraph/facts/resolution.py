"""Import, type and call resolution over the fact tables, as ordered tiers of joins."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators import graphs, selection
from factgraph.operators.cascade import Probe, Tier, resolve_cascade, resolve_probes
from factgraph.operators.lineage import cut
from factgraph.operators.matching import occurrence
from factgraph.rules import tables as R

BUILTIN_NAMES = sorted(n for n in dir(builtins) if not n.startswith("_"))

Tables = dict[str, DataFrame]


def symbols(t: Tables) -> DataFrame:
    """(id, qn, name, kind, class_id) of all modules, classes and callables."""
    none = F.lit(None).cast("string")
    out = t["module"].where("parse_error is null").select(F.col("module_id").alias("id"), "qn", "name", F.lit("module").alias("kind"), none.alias("class_id"))
    out = out.unionByName(t["class_fact"].select(F.col("class_id").alias("id"), "qn", "name", F.lit("class").alias("kind"), none.alias("class_id")))
    return out.unionByName(t["callable_fact"].select(F.col("callable_id").alias("id"), "qn", "name", F.when(F.col("class_id").isNull(), "function").otherwise("method").alias("kind"), "class_id"))


def resolve_imports(t: Tables, project: str) -> DataFrame:
    """import_fact with classification (internal or external), target_id, target_type and the candidate names tried.

    Candidates in order: the relative module, the module as written, the module under the project. A from-import prefers, per
    candidate, a class, then a function, then a submodule, then the module itself."""
    module = F.coalesce("module", F.lit(""))
    package = F.regexp_replace(F.col("module_id"), "^module:", "")
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    relative = F.when(F.col("level") > 0, F.when(module == "", base).otherwise(F.concat(base, F.lit("."), module)))
    tried = F.array_compact(F.array(relative, F.when(module != "", module), F.when(module != "", F.concat(F.lit(project + "."), module))))
    rows = t["import_fact"].withColumn("resolution_candidates", tried)
    at = rows.select("module_id", "ord", F.col("import_type") == "from_import", "name", F.posexplode("resolution_candidates").alias("pos", "cand")).toDF("module_id", "ord", "is_from", "name", "pos", "cand")
    member = at.where("is_from and name <> '*'").select("module_id", "ord", "pos", F.concat_ws(".", "cand", "name").alias("qn"))
    known = symbols(t).where("kind <> 'method'").select("qn", "id", "kind")
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2)
    hits = member.join(known, "qn").select("module_id", "ord", "pos", rank.alias("rank"), "id", "kind")
    whole = at.select("module_id", "ord", "pos", F.col("cand").alias("qn")).join(known.where("kind = 'module'"), "qn").select("module_id", "ord", "pos", F.lit(3).alias("rank"), "id", "kind")
    best = hits.unionByName(whole).groupBy("module_id", "ord").agg(F.min(F.struct("pos", "rank", "id", "kind")).alias("b"))
    best = best.select("module_id", "ord", F.col("b.id").alias("target_id"), F.col("b.kind").alias("target_type"))
    out = rows.join(best, ["module_id", "ord"], "left")
    out = out.withColumn("target_type", F.when((F.col("name") == "*") & F.col("target_id").isNotNull(), "wildcard").otherwise(F.col("target_type")))
    return out.withColumn("classification", F.when(F.col("target_id").isNotNull(), "internal").otherwise("external"))


def visible_imports(imports: DataFrame) -> DataFrame:
    """(module_id, root, import_target, import_kind): the first import of each visible name in a module."""
    root = names.visible_name(F.col("alias"), F.col("module"), F.when(F.col("import_type") == "from_import", F.col("name")))
    rows = imports.select("module_id", root.alias("root"), "ord", F.col("target_id").alias("import_target"), F.col("target_type").alias("import_kind")).where("root is not null")
    return selection.keep_first(rows, ["module_id", "root"], ["ord"]).drop("ord")


def ancestors(t: Tables) -> DataFrame:
    """(class_id, ancestor_id, depth): a base names the class of that qualified name, else every class of that simple name."""
    classes = t["class_fact"].select("class_id", "qn", "name")
    bases = t["class_fact"].select(F.col("class_id").alias("child"), F.explode("bases").alias("base")).distinct()
    exact = bases.join(classes.select(F.col("qn").alias("base"), F.col("class_id").alias("parent")), "base")
    rest = bases.join(classes.select(F.col("qn").alias("base")).distinct(), "base", "left_anti")
    simple = rest.join(classes.select(F.col("name").alias("base"), F.col("class_id").alias("parent")), "base")
    edges = exact.unionByName(simple).select("child", "parent").where("child <> parent")
    return graphs.closure(edges).select(F.col("node").alias("class_id"), F.col("ancestor").alias("ancestor_id"), "depth")


def class_methods(t: Tables, up: DataFrame) -> DataFrame:
    """(class_id, method, id, depth): own methods at depth 0 and those of every ancestor."""
    own = t["callable_fact"].where("class_id is not null").select("class_id", F.col("name").alias("method"), F.col("callable_id").alias("id"))
    inherited = up.join(own.withColumnRenamed("class_id", "ancestor_id"), "ancestor_id").select("class_id", "method", "id", "depth")
    return own.withColumn("depth", F.lit(0)).select("class_id", "method", "id", "depth").unionByName(inherited)


def type_methods(spark: SparkSession) -> DataFrame:
    """(type, method, kind, returns) of the builtin and external type registries."""
    rows = [(k, m, "builtin_type_method", r) for k, ms in R.BUILTIN_METHODS.items() for m, r in ms.items()]
    rows += [(k, m, "external_type_method", None) for k, ms in R.EXTERNAL_METHODS.items() for m in ms]
    return spark.createDataFrame(rows, "type string, method string, kind string, returns string")


def normal_annotation(c: Column) -> Column:
    """The type that an annotation names: quotes, Optional[...], Union with None and `| None` are taken off, generics cut to their
    base, and the aliases of builtins named as these. A union of several types stays as it is."""
    bare = F.regexp_replace(F.trim(c), "^['\"]|['\"]$", "")
    bare = F.regexp_replace(bare, r"^(?:typing\.)?Optional\[(.*)\]$", "$1")
    parts = F.filter(names.split_arguments(F.regexp_extract(bare, r"^(?:typing\.)?Union\[(.*)\]$", 1)), lambda x: ~x.isin("None", "NoneType"))
    bare = F.when(F.size(parts) == 1, parts[0]).otherwise(bare)
    bare = F.regexp_replace(bare, r"\s*\|\s*(?:None|NoneType)$|^(?:None|NoneType)\s*\|\s*", "")
    bare = F.regexp_replace(bare, r"\[.*$", "")
    table = F.create_map(*(F.lit(x) for kv in names.TYPE_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, bare), bare)


def resolve_types(mentions: DataFrame, column: str, t: Tables, imports: DataFrame) -> DataFrame:
    """mentions (module_id, column...) with type_resolution, type_name and type_id (a class).

    Order: builtin, factory or external type, unique class by name, ambiguous, class by qualified name, import, unresolved."""
    spark = mentions.sparkSession
    classes = t["class_fact"].select(F.col("class_id").alias("tid"), F.col("name").alias("tname"), F.col("qn").alias("tqn"))
    known = spark.createDataFrame([(k, k, "builtin") for k in R.BUILTIN_METHODS] + [(k, v, "external_type") for k, v in R.FACTORIES.items()] + [(k, k, "external_type") for k in R.EXTERNAL_METHODS], "k string, type string, how string").dropDuplicates(["k"])
    rows = mentions.withColumn("__type", normal_annotation(F.col(column)))
    rows = rows.join(F.broadcast(known), F.col("__type") == F.col("k"), "left").drop("k")  # the registries: a fixed table
    rows = rows.withColumn("__root", F.substring_index("__type", ".", 1))
    rows = rows.join(visible_imports(imports).withColumnRenamed("root", "__root"), ["module_id", "__root"], "left")
    found = resolve_cascade(
        rows,
        [
            Tier("name", classes, {"__type": "tname"}, "tid", "resolved", "ambiguous"),
            Tier("qualified", classes.select(F.col("tid").alias("tid2"), "tqn"), {"__type": "tqn"}, "tid2", "resolved", "ambiguous"),
        ],
    )
    how = (
        F.when(F.col("how").isNotNull(), F.col("how")).when(F.col("classification") != "unresolved", F.col("classification"))
        .when(F.col("import_kind") == "class", "internal").when(F.col("__root").isNotNull() & F.col("import_target").isNull() & F.col("__type").contains("."), "external").otherwise("unresolved")
    )
    id_ = F.when(F.col("how").isNull(), F.coalesce("target_id", F.when(F.col("import_kind") == "class", F.col("import_target"))))
    return found.select(*mentions.columns, F.when(F.col("__type").isNotNull(), how).alias("type_resolution"), F.coalesce("type", "__type").alias("type_name"), id_.alias("type_id"))


def resolve_function_calls(t: Tables, imports: DataFrame) -> DataFrame:
    """Function calls with classification and target_id: cls(), builtin, class, function, import, unresolved."""
    spark = t["call_fact"].sparkSession
    calls = t["call_fact"].where("kind = 'function_call'").join(t["callable_fact"].select("callable_id", F.col("class_id").alias("own_class")), "callable_id", "left")
    calls = calls.join(visible_imports(imports).withColumnRenamed("root", "function"), ["module_id", "function"], "left")
    fixed = spark.createDataFrame([(n,) for n in BUILTIN_NAMES], "builtin string")
    classes = t["class_fact"].select("class_id", F.col("name").alias("class_name"))
    functions = t["callable_fact"].where("class_id is null").select("callable_id", F.col("name").alias("function_name")).toDF("fid", "function_name")
    owner = t["class_fact"].select(F.col("class_id").alias("oid"))
    target = symbols(t).where("kind in ('class', 'function')").select(F.col("id").alias("sid"), F.col("kind").alias("skind"))
    out = resolve_cascade(
        calls,
        [
            Tier("cls", owner, {"own_class": "oid"}, "oid", "constructor", "constructor", when=F.col("function") == "cls"),
            Tier("builtin", fixed.withColumn("bid", F.concat(F.lit("builtin:"), "builtin")), {"function": "builtin"}, "bid", "builtin", "builtin"),
            Tier("class", classes, {"function": "class_name"}, "class_id", "constructor", "constructor_ambiguous"),
            Tier("function", functions, {"function": "function_name"}, "fid", "internal", "internal_ambiguous"),
            Tier("imported class", target.where("skind = 'class'"), {"import_target": "sid"}, "sid", "constructor", "constructor"),
            Tier("imported function", target.where("skind = 'function'").select(F.col("sid").alias("sid2")), {"import_target": "sid2"}, "sid2", "internal", "internal"),
        ],
    )
    visible = visible_imports(imports).select("module_id", F.col("root").alias("function"), F.lit(True).alias("import_visible"))
    out = out.join(visible, ["module_id", "function"], "left")
    label = F.when((F.col("classification") == "unresolved") & F.coalesce("import_visible", F.lit(False)), "external").otherwise(F.col("classification"))
    kind = F.when(label.startswith("constructor"), "constructor_call").otherwise(F.col("kind"))
    return out.withColumn("classification", label).withColumn("kind", kind).drop("import_visible", "own_class", "import_target", "import_kind")


def typed_names(t: Tables, imports: DataFrame) -> DataFrame:
    """(space, key, type_name, class_id): what a receiver's name means, one row for each name of a scope, by its first mention.

    Spaces: A instance attributes (class|self.x), L typed locals (callable|x), P parameters (callable|x; self and cls have the class),
    C variables of with statements (callable|x)."""
    owner = t["callable_fact"].select("callable_id", F.col("qn").alias("owner_qn"), "class_id")
    key = lambda a, b: F.concat_ws("|", a, b)
    text = F.coalesce("annotation", "assigned_type")
    v = t["variable"].withColumn("text", text)
    none = F.lit(None).cast("string")
    attrs = v.where("scope = 'instance_attribute'").select("module_id", F.lit("A").alias("space"), key(F.col("owner_id"), F.col("full_name")).alias("key"), "ord", "text", none.alias("implied"))
    local = v.where("scope = 'local' and text is not null").join(owner, "owner_qn").select("module_id", F.lit("L").alias("space"), key(F.col("callable_id"), F.col("name")).alias("key"), "ord", "text", F.when(F.col("text") == "cls", F.col("class_id")).alias("implied"))
    p = t["parameter"].join(owner.select("callable_id", F.col("class_id").alias("own")), "callable_id", "left")
    params = p.select("module_id", F.lit("P").alias("space"), key(F.col("callable_id"), F.col("name")).alias("key"), F.col("idx").alias("ord"), F.col("annotation").alias("text"), F.when(F.col("name").isin("self", "cls"), F.col("own")).alias("implied"))
    mentions = cut(attrs.unionByName(local).unionByName(params))
    rows = resolve_types(mentions, "text", t, imports)
    named = rows.select("space", "key", "ord", F.col("type_name"), F.coalesce("type_id", "implied").alias("class_id"))
    table = F.create_map(*(F.lit(x) for kv in R.FACTORIES.items() for x in kv))
    items = t["body_node"].where("control_type = 'with'").select("callable_id", F.col("walk_ord").alias("ord"), F.posexplode(F.arrays_zip("targets", F.split("value", ", ").alias("made"))).alias("nth", "i"))
    items = items.select("callable_id", (F.col("ord") * 1000 + F.col("nth")).alias("ord"), F.col("i.targets").alias("name"), F.col("i.made").alias("made")).where("name <> '' and made <> ''")
    context = items.select(F.lit("C").alias("space"), key(F.col("callable_id"), F.col("name")).alias("key"), "ord", F.coalesce(F.try_element_at(table, F.col("made")), F.col("made")).alias("type_name"), none.alias("class_id"))
    return selection.keep_first(named.unionByName(context), ["space", "key"], ["ord"]).select("space", "key", "type_name", "class_id")


def parameter_types(t: Tables, imports: DataFrame) -> DataFrame:
    """(callable_id, idx, name, type_resolution, type_name, type_id) of every parameter: self and cls have the class around them."""
    own = t["callable_fact"].select("callable_id", F.col("class_id").alias("own")).dropDuplicates(["callable_id"])
    rows = resolve_types(t["parameter"], "annotation", t, imports).join(own, "callable_id", "left")
    implied = F.col("name").isin("self", "cls") & F.col("own").isNotNull()
    return rows.select("callable_id", "idx", "name", F.when(implied, F.col("name")).otherwise(F.col("type_resolution")).alias("type_resolution"), F.when(implied, F.regexp_replace("own", "^class:", "")).otherwise(F.col("type_name")).alias("type_name"), F.when(implied, F.col("own")).otherwise(F.col("type_id")).alias("type_id"))


def variable_types(t: Tables, imports: DataFrame) -> DataFrame:
    """(owner_id, scope, name, type_resolution, type_name, type_id) of every variable with a type mention; a local that cls() made has
    the class of its callable (cls_constructor)."""
    own = t["callable_fact"].select(F.col("qn").alias("owner_id"), F.col("class_id").alias("own")).dropDuplicates(["owner_id"])
    rows = resolve_types(t["variable"].withColumn("text", F.coalesce("annotation", "assigned_type")), "text", t, imports).where("text is not null").join(own, "owner_id", "left")
    made = (F.col("text") == "cls") & F.col("own").isNotNull()
    return rows.select("owner_id", "scope", "name", F.when(made, "cls_constructor").otherwise(F.col("type_resolution")).alias("type_resolution"), F.when(made, F.regexp_replace("own", "^class:", "")).otherwise(F.col("type_name")).alias("type_name"), F.when(made, F.col("own")).otherwise(F.col("type_id")).alias("type_id"))


def unresolved_summary(calls: DataFrame, k: int = 10, examples: int = 15) -> tuple[DataFrame, DataFrame]:
    """The k most frequent groups of unresolved calls (prefix, n), and the first examples (callable_id, name, line) by position."""
    lost = calls.where(~is_resolved(F.col("classification")) & (F.col("classification") != "external"))
    groups = selection.top_k(lost.select(names.receiver_prefix(F.col("name")).alias("prefix")), ["prefix"], k)
    return groups, lost.select("callable_id", "ord", "name", "line").orderBy("callable_id", "ord").limit(examples).drop("ord")


def with_receivers(calls: DataFrame, typed: DataFrame) -> DataFrame:
    """calls (row, own_class, callable_id, receiver) with what the receiver is in each space (a, p, c, l) and the type of a chain's
    base: all looked up by one join."""
    r, base = F.col("receiver"), F.when(F.col("receiver").contains("."), F.regexp_replace("receiver", r"\.[^.]*$", ""))
    ask = [("a", "A", F.when(r.startswith("self."), F.concat_ws("|", "own_class", r))), ("p", "P", F.concat_ws("|", "callable_id", r)), ("c", "C", F.concat_ws("|", "callable_id", r)), ("l", "L", F.concat_ws("|", "callable_id", r))]
    ask += [("ba", "A", F.when(base.startswith("self."), F.concat_ws("|", "own_class", base))), ("bl", "L", F.when(base.isNotNull(), F.concat_ws("|", "callable_id", base))), ("bp", "P", F.when(base.isNotNull(), F.concat_ws("|", "callable_id", base)))]
    asked = F.array_compact(F.array(*(F.when(key.isNotNull(), F.struct(F.lit(slot).alias("slot"), F.lit(space).alias("space"), key.alias("key"))) for slot, space, key in ask)))
    rows = calls.select("row", F.explode(asked).alias("x")).select("row", "x.*").join(typed, ["space", "key"])
    slot = lambda s: F.max(F.when(F.col("slot") == s, F.struct(F.col("type_name").alias("type"), F.col("class_id").alias("class")))).alias(s)
    return calls.join(rows.groupBy("row").agg(*(slot(s) for s, _, _ in ask)), "row", "left")


def resolve_method_calls(t: Tables, imports: DataFrame) -> DataFrame:
    """Method calls with classification, target_id, n_candidates and tier: import receiver, super, self, self.attribute, parameter,
    chain on a builtin, with variable, local variable, Class.method, method name alone, unresolved.

    Three joins over the calls, whatever the number of tiers: visible imports, receivers, and one for all tiers together. The
    candidates of ambiguous calls are in method_candidates."""
    own = t["callable_fact"].select("callable_id", F.col("class_id").alias("own_class")).dropDuplicates(["callable_id"])
    own = own.join(t["class_fact"].select(F.col("class_id").alias("own_class"), F.size("bases").alias("n_bases")).dropDuplicates(["own_class"]), "own_class", "left")
    calls = t["call_fact"].where("kind = 'method_call'").join(own, "callable_id", "left")
    calls = calls.withColumn("root", F.substring_index("receiver", ".", 1)).join(visible_imports(imports).withColumn("visible", F.lit(True)), ["module_id", "root"], "left")
    calls = cut(calls.withColumn("row", F.monotonically_increasing_id()))
    calls = with_receivers(calls, typed_names(t, imports))
    chained = {f"{k}.{m}": r for k, ms in R.BUILTIN_METHODS.items() for m, r in ms.items() if r in R.BUILTIN_METHODS}
    returns = F.create_map(*(F.lit(x) for kv in chained.items() for x in kv))
    first_type = F.coalesce(F.col("ba.type"), F.col("bl.type"), F.col("bp.type"))
    calls = calls.withColumn("chain", F.try_element_at(returns, F.concat_ws(".", first_type, names.last_segment(F.col("receiver")))))

    recv, method = F.col("receiver"), F.col("method")
    key = lambda c: F.when(c.isNotNull(), F.concat_ws("|", c, method))
    in_class, is_super = F.col("own_class").isNotNull(), recv == "super"
    yes, has = F.lit(True), {s: F.col(s).isNotNull() for s in "apcl"}
    reg = lambda name, space, slot: Probe(name, space, key(F.col(f"{slot}.type")), has[slot], "builtin_type_method" if space == "B" else "external_type_method", "builtin_type_method")
    end = lambda name, when, label: Probe(name, None, None, when, missing=label)
    probes = [
        Probe("imported", "M", key(F.col("import_target")), F.col("visible") & (F.col("import_kind") == "class")), end("import", F.col("visible"), "external"),
        end("super without bases", is_super & in_class & (F.col("n_bases") == 0), "unresolved_super_call"),
        Probe("super", "U", key(F.col("own_class")), is_super & in_class, missing="unresolved_super_method"),
        Probe("self", "M", key(F.col("own_class")), recv == "self"),
        reg("attr builtin", "B", "a"), reg("attr external", "X", "a"), Probe("attr", "M", key(F.col("a.class")), has["a"]),
        end("untyped attr", has["a"] & F.col("a.type").isNull() & F.col("a.class").isNull(), "unresolved_attribute_type"), end("typed attr", has["a"], "unresolved_method_on_attribute"),
        reg("param builtin", "B", "p"), reg("param external", "X", "p"), Probe("param exact", "O", key(F.col("p.class")), has["p"]), Probe("param", "M", key(F.col("p.class")), has["p"]),
        end("typed param", F.coalesce(F.col("p.class"), F.col("p.type")).isNotNull(), "unresolved_method_on_parameter"),
        Probe("chain", "B", key(F.col("chain")), F.col("chain").isNotNull(), "builtin_type_method"),
        Probe("context external", "X", key(F.col("c.type")), has["c"], "external_type_method"), end("context", has["c"], "unresolved_method_on_context_variable"),
        reg("local builtin", "B", "l"), reg("local external", "X", "l"), Probe("local", "M", key(F.col("l.class")), has["l"]),
        Probe("class name", "N", F.concat_ws(".", recv, method), yes), Probe("method name", "Y", method, yes, "internal_candidate"),
    ]
    out = resolve_probes(calls, "row", probes, method_keys(t))
    out = out.withColumn("target_id", F.when(F.col("classification") != "internal_candidate", F.col("target_id")))
    return out.select(*t["call_fact"].columns, "classification", "target_id", "n_candidates", "tier")


def method_keys(t: Tables) -> DataFrame:
    """(space, key, id) of all tiers of method calls: M methods of a class and its ancestors, O its own, U those of its ancestors, N by
    class name, Y by method name, B and X the registries of builtin and external types."""
    up = ancestors(t)
    every = class_methods(t, up)
    own = every.where("depth = 0").select("class_id", "method", "id")
    above = up.join(own.withColumnRenamed("class_id", "ancestor_id"), "ancestor_id").select("class_id", "method", "id")
    part = lambda df, space, key, id_="id": df.select(F.lit(space).alias("space"), key.alias("key"), F.col(id_).alias("id"))
    pair = F.concat_ws("|", "class_id", "method")
    named = own.join(t["class_fact"].select("class_id", "name", "qn"), "class_id")
    fixed = type_methods(t["call_fact"].sparkSession).withColumn("id", F.concat(F.when(F.col("kind") == "builtin_type_method", "builtin_type:").otherwise("external_type:"), F.concat_ws(".", "type", "method")))
    rows = part(every, "M", pair).unionByName(part(own, "O", pair)).unionByName(part(above, "U", pair)).unionByName(part(named, "N", F.concat_ws(".", "name", "method"))).unionByName(part(named, "N", F.concat_ws(".", "qn", "method"))).unionByName(part(own, "Y", F.col("method")))
    kind = F.when(F.col("kind") == "builtin_type_method", "B").otherwise("X")
    return rows.unionByName(fixed.select(kind.alias("space"), F.concat_ws("|", "type", "method").alias("key"), "id"))


def method_candidates(t: Tables, calls: DataFrame) -> DataFrame:
    """(method, candidate) for the method names of calls that only their name matched: every method of that name, once."""
    asked = calls.where("classification in ('internal_candidate', 'internal_ambiguous')").select("method").distinct()
    return asked.join(t["callable_fact"].where("class_id is not null").select(F.col("name").alias("method"), F.col("callable_id").alias("candidate")).distinct(), "method")


def is_resolved(classification: Column) -> Column:
    return classification.isin("builtin", "constructor", "internal", "builtin_type_method", "external_type_method")


def edges(t: Tables, imports: DataFrame, calls: DataFrame, project: str | None = None) -> DataFrame:
    """(edge_id, type, source, target, line): contains (project to body), imports, inherits, uses, calls, instantiates and their
    unresolved kinds. Edges are one if type, source, target, line, call name, import type, attribute name and base are."""
    c, m = t["callable_fact"], t["class_fact"]
    meta = ("line", "call_name", "import_type", "attribute_name", "base")

    def row(df: DataFrame, kind: Column | str, source: Column, target: Column, **given: Column) -> DataFrame:
        own = [given[k].cast("string").alias(k) if k in given else F.lit(None).cast("string").alias(k) for k in meta]
        return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), source.alias("source"), target.alias("target"), *own, F.array(*(F.lit(k in given) for k in meta)).alias("has"))

    out = row(m, "contains", F.col("module_id"), F.col("class_id"))
    out = out.unionByName(row(c, "contains", F.coalesce("class_id", "module_id"), F.col("callable_id")))
    if project is not None:
        out = out.unionByName(row(t["module"], "contains", F.lit(f"project:{project}"), F.col("module_id")))
    b = t["body_node"]
    out = out.unionByName(row(b, "contains", F.when(F.col("depth") == 0, F.col("callable_id")).otherwise(F.col("parent_id")), F.col("node_id"), line=F.col("line_start")))
    outside = F.concat(F.lit("external:"), F.concat_ws(".", "module", "name"))
    out = out.unionByName(row(imports, "imports", F.col("module_id"), F.coalesce("target_id", outside), line=F.col("line"), import_type=F.col("import_type")))
    out = out.unionByName(row(m.select("class_id", F.explode("bases").alias("b")), "inherits", F.col("class_id"), F.concat(F.lit("class_or_external:"), "b"), base=F.col("b")))
    attrs = t["variable"].where("scope = 'instance_attribute'").select("module_id", "owner_id", "name", "assigned_type", F.col("line"), F.coalesce("annotation", "assigned_type").alias("text"))
    typed = resolve_types(attrs, "text", t, imports)
    known = F.coalesce("type_id", F.when(F.col("type_resolution").isin("builtin", "external_type"), F.concat(F.when(F.col("type_resolution") == "builtin", "builtin_type:").otherwise("external_type:"), "type_name")))
    typed = typed.withColumn("to", F.coalesce(known, F.concat(F.lit("class_or_external:"), "assigned_type"))).where(F.col("to").isNotNull())
    for kind, rows in (("uses", typed), ("instantiates", typed.where("assigned_type is not null"))):
        out = out.unionByName(row(rows, kind, F.col("owner_id"), F.col("to"), line=F.col("line"), attribute_name=F.col("name")))
    made = F.col("classification").startswith("constructor")
    good = is_resolved(F.col("classification")) & F.col("target_id").isNotNull()
    outside = F.col("classification") == "external"
    of = lambda rows, kind, to: row(rows, kind, F.col("callable_id"), to, line=F.col("line"), call_name=F.col("name"))
    lost = F.concat(F.lit("unresolved:"), "name")
    out = out.unionByName(of(calls.where(good | outside), "calls", F.when(good, F.col("target_id")).otherwise(F.concat(F.lit("external:"), "name"))))
    out = out.unionByName(of(calls.where(made & good), "instantiates", F.col("target_id")))
    out = out.unionByName(of(calls.where(~good & ~outside), F.when(made, "instantiates_unresolved").otherwise("calls_unresolved"), lost))
    keyed = out.withColumn("edge_id", names.relationship_id(F.col("type"), F.col("source"), F.col("target"), [(F.col(k), F.get("has", F.lit(i))) for i, k in enumerate(meta)]))
    return keyed.where("source is not null and target is not null").dropDuplicates(["edge_id"]).select("edge_id", "type", "source", "target", F.col("line").cast("int").alias("line"))


def synchronised(t: Tables, calls: DataFrame) -> DataFrame:
    """body_call rows with the classification and target of the flat call of the same (callable, name, line), first in first out."""
    flat = occurrence(calls, ["callable_id", "name", "line"], ["ord"]).select("callable_id", "name", "line", "occurrence", F.col("classification").alias("call_classification"), "target_id")
    body = occurrence(t["body_call"], ["callable_id", "name", "line"], ["walk_ord"])
    return body.join(flat, ["callable_id", "name", "line", "occurrence"], "left").withColumn("matched", F.col("call_classification").isNotNull())


def summary(t: Tables, calls: DataFrame) -> DataFrame:
    """One row of counts over all levels: tables are aggregated one by one and joined as single rows."""
    out = t["module"].agg(F.count("*").alias("files"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"), F.count_if("is_init").alias("packages"))
    control = [F.count_if(F.col("control_type") == c).alias(f"{c}s") for c in ("if", "for", "while", "try", "with")]
    statements = [F.count_if(F.col("statement_type") == c).alias(f"{c}s") for c in ("return", "raise", "assignment")]
    parts = {
        "import_fact": [F.count("*").alias("imports")], "class_fact": [F.count("*").alias("classes")],
        "callable_fact": [F.count_if(F.col("class_id").isNull()).alias("functions"), F.count_if(F.col("class_id").isNotNull()).alias("methods"), F.count_if(F.col("kind") == "constructor").alias("constructors"), F.count_if("is_async").alias("async_callables"), F.count_if(F.size("decorators") > 0).alias("decorated")],
        "parameter": [F.count("*").alias("parameters")],
        "variable": [F.count_if(F.col("scope") == s).alias(f"{s}s") for s in ("class_attribute", "instance_attribute", "local")],
        "body_node": [F.count("*").alias("body_nodes"), F.count_if(F.col("type") == "control_structure").alias("control_structures"), F.count_if(F.col("type") == "exception_handler").alias("exception_handlers"), F.count_if(F.col("statement_type") == "unknown").alias("unknown_statements"), *control, *statements],
    }
    for name, aggregates in parts.items():
        out = out.crossJoin(t[name].agg(*aggregates))
    return out.crossJoin(calls.agg(F.count("*").alias("calls"), F.count_if(is_resolved(F.col("classification"))).alias("resolved_calls"), F.count_if(F.col("classification") == "external").alias("external_calls"), F.count_if(F.col("classification").startswith("constructor")).alias("constructor_calls")))
