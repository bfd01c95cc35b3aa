"""Queries of extraction, resolution and model building over source text that is composed from the part table.

Each brand becomes a module, each kind of part in it a class, each part a method whose body is one of CASES; two fixed modules
hold what they import and inherit. Facts, resolutions, edges and model elements to expect follow from the table by plain SQL,
which is composed from the same CASES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.facts import elements, normalised, resolution
from factgraph.kdm import model, validation, xmi
from factgraph.operators.lineage import Written, cut, written
from factgraph.plans.registry import Tables, query
from factgraph.sources import python_source

BASE = """from typing import Protocol

class Base:
    def save(self):
        return True

    def common(self):
        pass

class Lone:
    def go(self):
        super().go()

    def common(self):
        pass

class Dup:
    pass

class Face(Protocol):
    def show(self):
        ...

def helper(x):
    return x
"""
OTHER = "class Dup:\n    pass\n"
HEAD = "import os\nfrom base import Base, helper\n\n"
OPENING = "(Base):\n    def __init__(self):\n        self.items = []\n        self.mystery = make()\n        self.blank = 1 + 2\n"
SAVE, METHOD = "method:shop.base.Base.save", "method:{m}.{c}.m_{k}"


@dataclass(frozen=True)
class Case:
    """The body of a method, and what follows from it: its calls (name, classification, target, candidates), the labels of its
    statements, and how many Reads, Writes, Throws, HasType, HasValue and Flow relations it adds."""

    lines: tuple[str, ...]
    calls: tuple[tuple[str, str, str | None, int], ...] = ()
    labels: tuple[str, ...] = ("expression",)
    reads: int = 0
    writes: int = 0
    throws: int = 0
    typed: int = 0
    values: int = 0
    flows: int = 0
    contexts: int = 0


CASES = (
    Case(("self.m_{k}(size)",), (("self.m_{k}", "internal", METHOD, 0),)),
    Case(("self.save()",), (("self.save", "internal", SAVE, 0),)),
    Case(("super().save()",), (("super.save", "internal", SAVE, 0), ("super", "builtin", "builtin:super", 0))),
    Case(("super().nothing()",), (("super.nothing", "unresolved_super_method", None, 0), ("super", "builtin", "builtin:super", 0))),
    Case(("self.items.append(size)",), (("self.items.append", "builtin_type_method", "builtin_type:list.append", 0),), reads=1),
    Case(("self.mystery.run()",), (("self.mystery.run", "unresolved_method_on_attribute", None, 0),), reads=1),
    Case(("self.blank.run()",), (("self.blank.run", "unresolved_attribute_type", None, 0),), reads=1),
    Case(("size.strip().title()",), (("size.strip.title", "builtin_type_method", "builtin_type:str.title", 0), ("size.strip", "builtin_type_method", "builtin_type:str.strip", 0))),
    Case(("other.save()",), (("other.save", "internal", SAVE, 0),)),
    Case(("other.fly()",), (("other.fly", "unresolved_method_on_parameter", None, 0),)),
    Case(("thing.walk()",), (("thing.walk", "unresolved", None, 0),)),
    Case(("with open(size) as f:", "    f.read()"), (("open", "builtin", "builtin:open", 0), ("f.read", "external_type_method", "external_type:io.TextIOWrapper.read", 0)), ("with", "expression"), contexts=1),
    Case(("with size as g:", "    g.read()"), (("g.read", "unresolved_method_on_context_variable", None, 0),), ("with", "expression"), contexts=1),
    Case(("os.remove(size)",), (("os.remove", "external", None, 0),)),
    Case(("x = Base()", "x.save()"), (("Base", "constructor", "class:shop.base.Base", 0), ("x.save", "internal", SAVE, 0)), ("assignment", "expression"), reads=1, writes=1, typed=1, flows=1),
    Case(("z.m_{k}()",), (("z.m_{k}", "internal_candidate", None, 0),)),
    Case(("z.common()",), (("z.common", "internal_ambiguous", None, 2),)),
    Case(("helper(size)",), (("helper", "internal", "function:shop.base.helper", 0),)),
    Case(("unknown_fn(size)",), (("unknown_fn", "unresolved", None, 0),)),
    Case(("print(size)",), (("print", "builtin", "builtin:print", 0),)),
    Case(("Dup(size)",), (("Dup", "constructor_ambiguous", None, 2),)),
    Case(("raise ValueError(size)",), (("ValueError", "builtin", "builtin:ValueError", 0),), ("raise",), throws=1, typed=1),
    Case(("return True",), (), ("return",), reads=1, values=1),
    Case(("Base.save(other)",), (("Base.save", "internal", SAVE, 0),)),
)
_N = len(CASES)
_PART = "SELECT p_partkey AS k, 'shop.' || replace(lower(p_brand), '#', '_') AS m, 'C_' || p_type AS c FROM part"
_SIZES = "SELECT count(DISTINCT p_brand) AS nb, count(DISTINCT p_brand || p_type) AS nc, count(*) AS np FROM part"
_GOOD = ("internal", "builtin", "builtin_type_method", "external_type_method")


def _sum(of) -> str:
    """SQL of the sum of of(case) over all parts."""
    some = [(k, of(c)) for k, c in enumerate(CASES) if of(c)]
    return "coalesce((SELECT sum(CASE p_partkey % %d %s ELSE 0 END) FROM part), 0)::BIGINT".replace("% %d", f"% {_N}").replace("%s", " ".join(f"WHEN {k} THEN {n}" for k, n in some) or "WHEN -1 THEN 0")


def _calls(*kinds: str):
    return lambda case: sum(c[1] in kinds for c in case.calls)


def sources(t: Tables) -> DataFrame:
    """(path, content) of one file per brand, and of the two fixed ones."""
    key = F.col("p_partkey").cast("string")
    bodies = F.array(*(F.lit("".join(f"        {x}\n" for x in c.lines)) for c in CASES))
    body = F.replace(F.get(bodies, (F.col("p_partkey") % _N).cast("int")), F.lit("{k}"), key)
    method = F.concat(F.lit("    def m_"), key, F.lit("(self, size: str, other: Base, thing):\n"), body)
    classes = t.part.groupBy("p_brand", "p_type").agg(F.array_join(F.array_sort(F.collect_list(method)), "").alias("methods"))
    text = F.concat(F.lit("class C_"), "p_type", F.lit(OPENING), "methods")
    files = classes.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("content"))
    files = files.select(F.concat(F.translate(F.lower("p_brand"), "#", "_"), F.lit(".py")).alias("path"), F.concat(F.lit(HEAD), "content").alias("content"))
    one = files.sparkSession.range(1)
    for path, content in (("base.py", BASE), ("other.py", OTHER)):
        files = files.unionByName(one.select(F.lit(path).alias("path"), F.lit(content).alias("content")))
    return files.select("path", F.encode("content", "utf-8").alias("content"))


def facts(t: Tables) -> dict[str, DataFrame]:
    return python_source.tables(cut(python_source.parsed(sources(t), "shop")))


def model_facts(t: Tables) -> dict[str, DataFrame]:
    """The facts for a whole model, which reads each of their tables many times: they are written, calls without their arguments."""
    f = python_source.tables(written(python_source.parsed(sources(t), "shop")))
    return Written(f | {"call_fact": f["call_fact"].drop("arguments", "keyword_arguments")})


def _all_calls(f: dict[str, DataFrame], imports: DataFrame) -> DataFrame:
    columns = [*f["call_fact"].columns, "classification", "target_id", "n_candidates"]
    return cut(resolution.resolve_function_calls(f, imports).select(*columns).unionByName(resolution.resolve_method_calls(f, imports).select(*columns)))


def _resolved(t: Tables) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    f = facts(t)
    imports = cut(resolution.resolve_imports(f, "shop"))
    return f, imports, _all_calls(f, imports)


@query(f"""
SELECT m AS module, count(DISTINCT c) AS n_classes, count(*) + count(DISTINCT c) AS n_methods, 4 * count(*) + count(DISTINCT c) AS n_parameters,
  (sum(CASE k % {_N} {" ".join(f"WHEN {k} THEN {len(c.calls)}" for k, c in enumerate(CASES))} END) + count(DISTINCT c))::BIGINT AS n_calls,
  (sum(CASE k % {_N} {" ".join(f"WHEN {k} THEN {len(c.labels)}" for k, c in enumerate(CASES))} END) + 3 * count(DISTINCT c))::BIGINT AS n_statements
FROM ({_PART}) GROUP BY m UNION ALL SELECT 'shop.base', 4, 6, 6, 2, 6 UNION ALL SELECT 'shop.other', 1, 0, 0, 0, 0""")
def extracted_facts(t: Tables) -> DataFrame:
    f = facts(t)
    name = F.regexp_replace("module_id", "^module:", "").alias("module")
    out = f["module"].select(name)
    for table, label in (("class_fact", "n_classes"), ("callable_fact", "n_methods"), ("parameter", "n_parameters"), ("call_fact", "n_calls"), ("body_node", "n_statements")):
        out = out.join(f[table].groupBy(name).agg(F.count("*").alias(label)), "module", "left")
    return out.fillna(0)


_CALLS = ", ".join(f"({k}, '{n}', '{label}', {'NULL' if target is None else repr(target)}, {many})" for k, c in enumerate(CASES) for n, label, target, many in c.calls)
_EACH_CALL = f"""
WITH p AS ({_PART}), f(i, name, classification, target, n) AS (VALUES {_CALLS})
SELECT 'method:' || m || '.' || c || '.m_' || k AS callable_id, replace(name, '{{k}}', k::VARCHAR) AS name, classification, replace(replace(replace(target, '{{k}}', k::VARCHAR), '{{m}}', m), '{{c}}', c) AS target_id, n::BIGINT AS n_candidates FROM p JOIN f ON k % {_N} = i
UNION ALL SELECT DISTINCT 'method:' || m || '.' || c || '.__init__', 'make', 'unresolved', NULL, 0 FROM p
UNION ALL VALUES ('method:shop.base.Lone.go', 'super.go', 'unresolved_super_call', NULL, 0), ('method:shop.base.Lone.go', 'super', 'builtin', 'builtin:super', 0)"""


@query(_EACH_CALL)
def call_resolution(t: Tables) -> DataFrame:
    """All outcome labels of calls, each in the bodies that lead to it."""
    return _resolved(t)[2].select("callable_id", "name", "classification", "target_id", F.col("n_candidates").cast("long").alias("n_candidates"))


@query(f"SELECT name, classification, target_id FROM ({_EACH_CALL}) WHERE contains(name, '.')")
def resolved_method_calls(t: Tables) -> DataFrame:
    f = facts(t)
    imports = cut(resolution.resolve_imports(f, "shop"))
    return resolution.resolve_method_calls(f, imports).select("name", "classification", "target_id")


@query(f"""
SELECT 'module:' || m AS module_id, unnest(['os', 'base', 'base']) AS module, unnest([NULL, 'Base', 'helper']) AS name, unnest(['external', 'internal', 'internal']) AS classification,
  unnest([NULL, 'class:shop.base.Base', 'function:shop.base.helper']) AS target_id, unnest([NULL, 'class', 'function']) AS target_type FROM (SELECT DISTINCT m FROM ({_PART}))
UNION ALL SELECT 'module:shop.base', 'typing', 'Protocol', 'external', NULL, NULL""")
def import_resolution(t: Tables) -> DataFrame:
    return resolution.resolve_imports(facts(t), "shop").select("module_id", "module", "name", "classification", "target_id", "target_type")


@query(f"""
SELECT nb + 2 AS files, 0::BIGINT AS parse_errors, nc + 5 AS classes, 1::BIGINT AS functions, np + nc + 5 AS methods, nc AS constructors, 4 * np + nc + 6 AS parameters, 3 * nc AS instance_attributes,
  {_sum(lambda c: len(c.labels))} + 3 * nc + 6 AS body_nodes, {_sum(lambda c: c.contexts)} AS withs, {_sum(lambda c: c.throws)} AS raises, {_sum(lambda c: len(c.calls))} + nc + 2 AS calls,
  {_sum(_calls("constructor", *_GOOD))} + 1 AS resolved_calls, {_sum(_calls("external"))} AS external_calls FROM ({_SIZES})""")
def extraction_summary(t: Tables) -> DataFrame:
    f, _, calls = _resolved(t)
    names = "files parse_errors classes functions methods constructors parameters instance_attributes body_nodes withs raises calls resolved_calls external_calls"
    return resolution.summary(f, calls).select(*names.split())


@query(f"""
SELECT type, n FROM ({_SIZES}), LATERAL (SELECT unnest(['contains', 'imports', 'inherits', 'uses', 'instantiates', 'calls', 'calls_unresolved', 'instantiates_unresolved']) AS type, unnest([
  nb + 2 + nc + 5 + np + nc + 6 + {_sum(lambda c: len(c.labels))} + 3 * nc + 6, 3 * nb + 1, nc + 1, 2 * nc, 2 * nc + {_sum(_calls("constructor"))}, {_sum(_calls("constructor", "external", *_GOOD))} + 1,
  {_sum(lambda c: sum(x[1] not in ("constructor", "constructor_ambiguous", "external", *_GOOD) for x in c.calls))} + nc + 1, {_sum(_calls("constructor_ambiguous"))}]) AS n) WHERE n > 0""")
def code_edges(t: Tables) -> DataFrame:
    f, imports, calls = _resolved(t)
    return resolution.edges(f, imports, calls, "shop").groupBy("type").agg(F.count("*").alias("n"))


_LABELS = sorted({x for c in CASES for x in c.labels})


@query(f"""
SELECT kind, n FROM ({_SIZES}), LATERAL (SELECT unnest(['project', 'module', 'class', 'function', 'method', 'attribute', 'context_variable', 'pass', {", ".join(map(repr, _LABELS))}]) AS kind, unnest([
  1, nb + 2, nc + 5, 1, np + nc + 5, 3 * nc, {_sum(lambda c: c.contexts)}, 2, {", ".join(_sum(lambda c, x=x: c.labels.count(x)) + {"assignment": " + 3 * nc", "expression": " + 2", "return": " + 2"}.get(x, "") for x in _LABELS)}]) AS n) WHERE n > 0""")
def flat_elements(t: Tables) -> DataFrame:
    return elements.elements(facts(t), "shop").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""
SELECT m || '.' || c || '.' || unnest(['items', 'mystery', 'blank']) AS qualified_name, unnest(['list', 'make', NULL]) AS resolved_type, unnest([3, 4, 5]) - 3 AS nth FROM (SELECT DISTINCT m, c FROM ({_PART}))""")
def merged_fields(t: Tables) -> DataFrame:
    f = normalised.fields(facts(t))
    first = F.min("line_start").over(Window.partitionBy("class_id"))
    return f.select("qualified_name", "resolved_type", (F.col("line_start") - first).alias("nth"))


@query(f"""
SELECT 'method:' || m || '.' || c || '.m_' || k AS callable_id, 'm_' || k || '(str,Base,thing)' AS signature FROM ({_PART}) UNION ALL SELECT DISTINCT 'method:' || m || '.' || c || '.__init__', '__init__()' FROM ({_PART})
UNION ALL VALUES ('method:shop.base.Base.save', 'save()'), ('method:shop.base.Base.common', 'common()'), ('method:shop.base.Lone.go', 'go()'), ('method:shop.base.Lone.common', 'common()'), ('method:shop.base.Face.show', 'show()'), ('function:shop.base.helper', 'helper(x)')""")
def callable_signatures(t: Tables) -> DataFrame:
    return normalised.signatures(facts(t)).select("callable_id", "signature")


@query(f"""
SELECT 'class:' || m || '.' || c AS class_id, 'extends' AS relation, 'class:shop.base.Base' AS target FROM (SELECT DISTINCT m, c FROM ({_PART})) UNION ALL VALUES ('class:shop.base.Face', 'implements', 'external:Protocol')""")
def class_relations(t: Tables) -> DataFrame:
    return normalised.class_relations(elements.interfaces(facts(t)))


@query(f"SELECT 'class:' || m || '.' || c AS class_id, false AS is_interface FROM (SELECT DISTINCT m, c FROM ({_PART})) UNION ALL VALUES ('class:shop.base.Base', false), ('class:shop.base.Lone', false), ('class:shop.base.Dup', false), ('class:shop.base.Face', true), ('class:shop.other.Dup', false)")
def interface_detection(t: Tables) -> DataFrame:
    return elements.interfaces(facts(t)).select("class_id", "is_interface")


@query(f"""
SELECT type, n FROM ({_SIZES}), LATERAL (SELECT unnest(['uses_type', 'throws', 'creates']) AS type, unnest([2 * np, {_sum(lambda c: c.throws)}, {_sum(lambda c: sum(x[0] in ("Base", "Dup") for x in c.calls))}]) AS n) WHERE n > 0""")
def data_edges(t: Tables) -> DataFrame:
    return elements.data_edges(facts(t)).where("type in ('uses_type', 'throws', 'creates')").groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT name, n_mentions FROM (SELECT 'ValueError' AS name, {_sum(lambda c: c.throws)} AS n_mentions UNION ALL SELECT 'Protocol', 1) WHERE n_mentions > 0")
def external_type_catalogue(t: Tables) -> DataFrame:
    f = facts(t)
    return elements.external_types(f, cut(elements.data_edges(f)))


@query("SELECT 'shop' AS prefix, NULL::VARCHAR AS parent")
def package_prefixes(t: Tables) -> DataFrame:
    f = facts(t)
    return elements.packages(f, resolution.resolve_imports(f, "shop"))


@query(f"SELECT classification IS NOT NULL AS matched, classification AS call_classification, count(*) AS n FROM ({_EACH_CALL}) GROUP BY ALL")
def body_call_matching(t: Tables) -> DataFrame:
    f, _, calls = _resolved(t)
    return resolution.synchronised(f, calls).groupBy("matched", "call_classification").agg(F.count("*").alias("n"))


@query(f"""
SELECT metaclass, n FROM ({_SIZES}), LATERAL (SELECT unnest(['Segment', 'InventoryModel', 'CodeModel', 'SourceFile', 'CompilationUnit', 'ClassUnit', 'MethodUnit', 'CallableUnit', 'ParameterUnit', 'StorableUnit', 'BlockUnit', 'ActionElement']) AS metaclass,
  unnest([1, 1, 1, nb + 2, nb + 2, nc + 5, np + nc + 5, 1, 4 * np + nc + 6, 3 * nc + {_sum(lambda c: c.writes)}, np + nc + 6, {_sum(lambda c: len(c.labels))} + 3 * nc + 6]) AS n)""")
def model_metaclass_counts(t: Tables) -> DataFrame:
    nodes = model.nodes(facts(t), "shop")
    return nodes.groupBy("metaclass").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT 'sourcefile:' || substr(sha1(x), 1, 12) AS file_id, x AS name FROM (SELECT replace(lower(p_brand), '#', '_') || '.py' AS x FROM part UNION ALL VALUES ('base.py'), ('other.py'))")
def inventory(t: Tables) -> DataFrame:
    return model.source_files(sources(t)).select(F.col("id").alias("file_id"), "name")


def _model_relations(f: dict[str, DataFrame], imports: DataFrame, calls: DataFrame, more: DataFrame) -> DataFrame:
    return model.relations(f, imports, calls, written(resolution.synchronised(f, calls))).unionByName(more)


@query(f"""
SELECT type, n FROM ({_SIZES}), LATERAL (SELECT unnest(['Calls', 'Creates', 'Imports', 'Extends', 'Reads', 'Writes', 'Throws', 'HasType', 'HasValue', 'Flow']) AS type, unnest([
  {_sum(_calls("external", *_GOOD))} + 1, {_sum(_calls("constructor"))}, 3 * nb + 1, nc + 1, {_sum(lambda c: c.reads)} + 2, 3 * nc + {_sum(lambda c: c.writes)}, {_sum(lambda c: c.throws)},
  2 * np + nc + {_sum(lambda c: c.typed)}, {_sum(lambda c: c.values)} + 1, 2 * nc + {_sum(lambda c: c.flows)}]) AS n) WHERE n > 0""")
def model_relations(t: Tables) -> DataFrame:
    f = model_facts(t)
    imports = cut(resolution.resolve_imports(f, "shop"))
    relations = _model_relations(f, imports, _all_calls(f, imports), model.detail(f, imports)[1])
    return relations.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('KDM-BLOCK-01', 'warning', 0)) AS x(rule_id, level, n) WHERE n > 0")
def model_findings(t: Tables) -> DataFrame:
    """The validators over the whole model: it has no error."""
    f = model_facts(t)
    imports = cut(resolution.resolve_imports(f, "shop"))
    calls = _all_calls(f, imports)
    nodes, more = model.detail(f, imports)
    nodes = written(model.nodes(f, "shop").unionByName(model.external_nodes(calls, imports)).unionByName(nodes))
    relations = written(_model_relations(f, imports, calls, more))
    found = validation.validate(nodes, relations, written(model.attributes(f)), written(model.regions(f)))
    return found.groupBy("rule_id", "level").agg(F.count("*").cast("int").alias("n"))


@query(f"""
SELECT 'method:' || m || '.' || c || '.m_' || k AS callable_id, CASE k % {_N} {" ".join(f"WHEN {k} THEN {len(c.lines) - 1}" for k, c in enumerate(CASES))} END AS lines FROM ({_PART})""")
def body_spans(t: Tables) -> DataFrame:
    spans = model.body_spans(facts(t)).where("callable_id like '%.m\\_%'")
    return spans.select("callable_id", (F.col("end_line") - F.col("start_line")).alias("lines"))


@query(f"SELECT 'Creates' AS type, n FROM (SELECT {_sum(lambda c: sum(x[0] == 'Base' for x in c.calls))} AS n) WHERE n > 0")
def recovered_constructors(t: Tables) -> DataFrame:
    f = facts(t)
    none = f["module"].limit(0).select(F.lit("").alias("owner_id"), F.lit("").alias("type"), F.lit("").alias("target_id"))
    return model.recovered_creates(f, none).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""
SELECT feature, n FROM ({_SIZES}), LATERAL (SELECT unnest(['segment', 'model', 'inventoryElement', 'parameterUnit', 'codeElement']) AS feature, unnest([1, 2, nb + 2, 4 * np + nc + 6,
  nb + 2 + nc + 5 + np + nc + 6 + 3 * nc + {_sum(lambda c: c.writes)} + np + nc + 6 + {_sum(lambda c: len(c.labels))} + 3 * nc + 6]) AS n)""")
def xmi_elements(t: Tables) -> DataFrame:
    f = model_facts(t)
    nodes = model.nodes(f, "shop")
    none = nodes.limit(0).select(F.col("id").alias("owner_id"), F.lit("").alias("type"), F.lit("").alias("target_id"))
    return xmi.lines(nodes, none, model.attributes(f)).groupBy("feature").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS parent, count(DISTINCT f || s || (l_linenumber % 2)) AS n_left, count(*) - count(DISTINCT f || s || (l_linenumber % 2)) AS n_gone FROM l GROUP BY 1""")
def merged_actions(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    id_, odd = F.concat_ws("#", "l_orderkey", "l_linenumber"), F.col("l_linenumber") % 2
    node = rows.select(id_.alias("id"), F.col("l_orderkey").cast("string").alias("parent_id"), F.lit("codeElement").alias("feature"), F.col("l_linenumber").cast("long").alias("ord"), F.lit("ActionElement").alias("metaclass"), F.col("f").alias("name"), F.col("s").alias("kind"))
    region = rows.select(id_.alias("owner_id"), F.lit("p").alias("path"), odd.alias("start_line"), odd.alias("end_line"))
    relation = node.limit(0).select(F.col("id").alias("owner_id"), F.col("name").alias("type"), F.col("id").alias("target_id"))
    left = model.merge_actions(node, relation, region)[0].groupBy(F.col("parent_id").cast("long").alias("parent")).agg(F.count("*").alias("n_left"))
    whole = rows.groupBy(F.col("l_orderkey").alias("parent")).agg(F.count("*").alias("n"))
    return whole.join(left, "parent").select("parent", "n_left", (F.col("n") - F.col("n_left")).alias("n_gone"))


@query("SELECT 'class:' || p_partkey || '' AS owner, unnest(['loop.' || lower(p_type), 'cached']) AS name, unnest([0, 1]) AS nth FROM part WHERE p_size % 2 = 0")
def annotation_nodes(t: Tables) -> DataFrame:
    given = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("loop."), F.lower("p_type")), F.lit("cached"))).otherwise(F.array().cast("array<string>"))
    classes = t.part.select(F.concat(F.lit("class:"), F.col("p_partkey").cast("string")).alias("class_id"), given.alias("decorators"))
    node, _ = model.annotations({"class_fact": classes, "callable_fact": classes.limit(0).withColumnRenamed("class_id", "callable_id")})
    return node.select(F.col("parent_id").alias("owner"), "name", F.col("ord").cast("int").alias("nth"))


@query("""
(SELECT 'static' AS kind, l_orderkey::VARCHAR AS source, l_partkey::VARCHAR AS target FROM lineitem WHERE l_partkey = 7 OR l_orderkey = 7 ORDER BY l_returnflag, source, target LIMIT 30)
UNION ALL (SELECT 'runtime', event_type, user_id::VARCHAR FROM events WHERE contains(user_id::VARCHAR, '7') OR contains('7', user_id::VARCHAR) ORDER BY event_type, user_id::VARCHAR LIMIT 20)""")
def traceability(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    edges = t.lineitem.select(F.col("l_returnflag").alias("type"), text("l_orderkey").alias("source"), text("l_partkey").alias("target"))
    seen = t.events.select(F.col("event_type").alias("source"), text("user_id").alias("target"))
    return elements.traced(edges, seen, "7")


@query(f"SELECT type_resolution, n FROM ({_SIZES}), LATERAL (SELECT unnest(['self', 'builtin', 'resolved', NULL]) AS type_resolution, unnest([np + nc + 5, np, np, np + 1]) AS n)")
def parameter_types(t: Tables) -> DataFrame:
    f = facts(t)
    types = resolution.parameter_types(f, cut(resolution.resolve_imports(f, "shop")))
    return types.groupBy("type_resolution").agg(F.count("*").alias("n"))


_LOST = f"SELECT name FROM ({_EACH_CALL}) WHERE classification NOT IN {('constructor', 'external', *_GOOD)}"


@query(f"""
SELECT CASE WHEN starts_with(name, 'self.') THEN 'self.*' WHEN starts_with(name, 'super') THEN 'super.*' WHEN contains(name, '.') THEN split_part(name, '.', 1) || '.*' ELSE name END AS prefix, count(*) AS n FROM ({_LOST}) GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10""")
def unresolved_call_groups(t: Tables) -> DataFrame:
    return resolution.unresolved_summary(_resolved(t)[2])[0]
