"""XMI text of model rows, and its reading back. The text of each element is made on the executors and sorted by tree path,
so the sink writes parts in document order; only a file's own lines are joined on the driver, and only by write_file."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators.lineage import cut, written

# Packages of the metaclasses and namespace addresses of the format.
PACKAGE = {
    "Segment": "kdm", "InventoryModel": "source", "SourceFile": "source", "CodeModel": "code", "CompilationUnit": "code", "ClassUnit": "code", "MethodUnit": "code", "CallableUnit": "code", "ParameterUnit": "code",
    "StorableUnit": "code", "Module": "code", "Datatype": "code", "BooleanType": "code", "IntegerType": "code", "StringType": "code", "FloatType": "code", "VoidType": "code", "Value": "code",
    "StructureModel": "structure", "SoftwareSystem": "structure", "ArchitectureView": "structure", "Subsystem": "structure", "Component": "structure", "AggregatedRelationship": "core", "BlockUnit": "action", "ActionElement": "action", "TryUnit": "action", "CatchUnit": "action", "FinallyUnit": "action",
}
NAMESPACES = {
    "xmi": "http://www.omg.org/XMI", "xsi": "http://www.w3.org/2001/XMLSchema-instance", "kdm": "http://www.omg.org/spec/KDM/20160201/kdm", "code": "http://www.omg.org/spec/KDM/20160201/code",
    "action": "http://www.omg.org/spec/KDM/20160201/action", "source": "http://www.omg.org/spec/KDM/20160201/source",
    "structure": "http://www.omg.org/spec/KDM/20160201/structure", "core": "http://www.omg.org/spec/KDM/20160201/core",
}
#: Feature and package of each relation; what is not here is a relation of code.
RELATION_FEATURE = {
    "Calls": ("actionRelation", "action"), "Creates": ("actionRelation", "action"), "Reads": ("actionRelation", "action"), "Writes": ("actionRelation", "action"), "Throws": ("actionRelation", "action"),
    "Flow": ("actionRelation", "action"), "ExceptionFlow": ("actionRelation", "action"), "ExitFlow": ("actionRelation", "action"),
    "HasType": ("codeRelation", "code"), "HasValue": ("codeRelation", "code"), "Imports": ("codeRelation", "code"), "Extends": ("codeRelation", "code"),
}
#: References of structure elements: attributes that hold ids.
REFERENCES = ("implementation", "from", "to")


def _quoted(c):
    out = F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def lines(node: DataFrame, relation: DataFrame, attribute: DataFrame) -> DataFrame:
    """(path, depth, feature, opening, inner) of each element; path sorts elements in document order.

    Relations and tagged values are elements of the features that the metamodel gives them, references of structure elements are
    attributes. Paths grow level by level, one join for each level of the tree, until no level is left, so no depth is cut. Only the
    elements that hold others take part in that, with their ids alone; all elements meet the paths of their parents once, at the end."""
    package = F.create_map(*(F.lit(x) for kv in PACKAGE.items() for x in kv))
    feature = F.create_map(*(F.lit(x) for k, (f, p) in RELATION_FEATURE.items() for x in (k, f"{f} xsi:type=\"{p}:{k}\"")))
    part = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    start = F.coalesce(F.try_element_at(feature, F.col("type")), F.concat(F.lit('codeRelation xsi:type="code:'), "type", F.lit('"')))
    plain = relation.where(~F.col("type").isin(*REFERENCES))
    rel = plain.groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("<"), start, F.lit(" to="), _quoted(F.col("target_id")), F.lit("/>")))).alias("rels"))
    held = relation.where(F.col("type").isin(*REFERENCES)).groupBy(F.col("owner_id").alias("id"), "type").agg(F.array_join(F.array_sort(F.collect_set("target_id")), " ").alias("ids"))
    held = held.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(" "), "type", F.lit("="), _quoted(F.col("ids"))))), "").alias("refs"))
    att = attribute.groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("<attribute tag="), _quoted(F.col("tag")), F.lit(" value="), _quoted(F.col("value")), F.lit("/>")))).alias("atts"))
    none = F.array().cast("array<string>")
    full = node.join(rel, "id", "left").join(att, "id", "left").join(held, "id", "left")
    kind = F.concat(F.lit(' xsi:type="'), F.coalesce(F.try_element_at(package, F.col("metaclass")), F.lit("code")), F.lit(":"), "metaclass", F.lit('"'))
    opening = F.concat(F.lit("<"), "feature", kind, F.lit(" xmi:id="), _quoted(F.col("id")), F.coalesce(F.concat(F.lit(" name="), _quoted(F.col("name"))), F.lit("")), F.coalesce(F.concat(F.lit(" kind="), _quoted(F.col("kind"))), F.lit("")), F.coalesce("refs", F.lit("")))
    full = written(full.select("id", "parent_id", "feature", F.concat(part("ord"), F.lit(":"), "id").alias("step"), opening.alias("opening"), F.concat(F.coalesce("atts", none), F.coalesce("rels", none)).alias("inner")))
    root, rest = full.where("parent_id is null"), full.where("parent_id is not null")
    holds = cut(full.select("id", "parent_id", "step").join(rest.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi"))
    level = holds.where("parent_id is null").select("id", F.col("step").alias("path"), F.lit(0).alias("depth"))
    paths, d = level, 0
    while not level.isEmpty():
        d += 1
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = cut(holds.join(above, "parent_id").select("id", F.concat_ws("/", "above", "step").alias("path"), F.lit(d).alias("depth")))
        paths = paths.unionByName(level)
        if d % 16 == 0:
            paths = cut(paths)
    columns = ["path", "depth", "feature", "opening", "inner"]
    above = paths.select(F.col("id").alias("parent_id"), F.col("path").alias("above"), (F.col("depth") + 1).alias("depth"))
    below = rest.join(above, "parent_id").withColumn("path", F.concat_ws("/", "above", "step"))
    return root.select(F.col("step").alias("path"), F.lit(0).alias("depth"), *columns[2:]).unionByName(below.select(*columns)).orderBy("path")


def write_file(node: DataFrame, relation: DataFrame, attribute: DataFrame, path: str) -> None:
    """One XMI file on the driver, streamed from the sorted lines partition by partition."""
    open_: list[str] = []
    with open(path, "w", encoding="utf-8") as f:
        f.write("<?xml version='1.0' encoding='UTF-8'?>\n<kdm:Model" + "".join(f" xmlns:{k}={quoteattr(v)}" for k, v in NAMESPACES.items()) + ">\n")
        for r in lines(node, relation, attribute).toLocalIterator():
            while len(open_) > r.depth:
                f.write("  " * len(open_) + f"</{open_.pop()}>\n")
            f.write("  " * (r.depth + 1) + r.opening + ">\n" + "".join("  " * (r.depth + 2) + x + "\n" for x in r.inner))
            open_.append(r.feature)
        while open_:
            f.write("  " * len(open_) + f"</{open_.pop()}>\n")
        f.write("</kdm:Model>\n")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(metaclass, n) of an XMI text, by its type attributes; relations count by their type, references by their name."""
    text = spark.read.text(path)
    kinds = F.regexp_extract_all("value", F.lit(r'xsi:type="(?:\w+:)?(\w+)"'), F.lit(1))
    return text.select(F.explode(kinds).alias("metaclass")).groupBy("metaclass").agg(F.count("*").alias("n"))


def _value(c, name: str):
    raw = F.regexp_extract(c, rf'\s{name}="([^"]*)"', 1)
    for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.when(F.col(c).rlike(rf'\s{name}="'), raw)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, metaclass, feature, name, kind) of the elements of an XMI text written by write_file."""
    rows = spark.read.text(path).where(F.col("value").contains(" xmi:id="))
    return rows.select(_value("value", "xmi:id").alias("id"), F.regexp_extract("value", r'xsi:type="(?:\w+:)?(\w+)"', 1).alias("metaclass"), F.regexp_extract("value", r"<(\w+)\s", 1).alias("feature"), _value("value", "name").alias("name"), _value("value", "kind").alias("kind"))


def ecore_metaclasses(spark: SparkSession, path: str) -> DataFrame:
    """(name, abstract, supertypes) of the classes that an .ecore file declares."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.regexp_extract_all("value", F.lit(r'(<eClassifiers\s[^>]*xsi:type="ecore:EClass"[^>]*>)'), F.lit(1))).alias("x"))
    name = F.regexp_extract("x", r'\sname="([^"]*)"', 1)
    supers = F.transform(F.filter(F.split(F.regexp_extract("x", r'eSuperTypes="([^"]*)"', 1), r"\s+"), lambda s: s != ""), lambda s: F.regexp_extract(s, r"([^/#]+)$", 1))
    return each.select(name.alias("name"), F.col("x").contains('abstract="true"').alias("abstract"), supers.alias("supertypes"))

