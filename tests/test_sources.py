"""Parsing by statement, rows of bounded size, and sizes that the optimizer may trust."""

import ast

import pytest
from pyspark.sql import functions as F

from factgraph.kdm import model
from factgraph.operators.lineage import cut
from factgraph.plans import code
from factgraph.recovery import runtime, structure
from factgraph.sources import python_source

TEXTS = [
    "", "\n\n# only this\n", "x = 1", "import os\r\nx = '''\r\ndef no():\n# '''\r\ny = 2\r", "@a\n# c\n@b\ndef f(x):\n    return x\n\nclass A:\n    z = [\n1,\n2]\n",
    "if x:\n    pass\n# c\nelse:\n    y = 1\nelsewhere = 2\ntry:\n    a()\nexcept E:\n    b()\nfinally:\n    c()\n", "x = 1 + \\\n2\ny = (\n1\n)\nfor i in (\na,\nb): pass\n", "\tx = 1", "f(\n\ndef g(): pass\n", "x = 1\ny = = 2\nz = 3\n",
    "x = 1 \\\ny = 2\n", "x = 1\n\f\ndef f():\n    '''a\nb'''\n", "x = 1\n    y = 2\n", "é = 1\nx = 'ü\u2028'\ny = 2\n", "x = '''\nopen\nand\nopen\n", "a = 1\x00\nb = 2\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_statements_are_those_of_the_whole_text(text):
    def read(f):
        try:
            return [ast.dump(node, include_attributes=True) for node in f(text)]
        except (SyntaxError, ValueError) as e:
            return f"{type(e).__name__}: {e}"

    assert read(lambda t: [ast.increment_lineno(node, n) for node, n in python_source.statements(t)]) == read(lambda t: ast.parse(t).body)


def test_no_row_grows_with_its_file(spark, monkeypatch):
    methods = "".join(f"    def m_{k}(self, a, b):\n        self.x = g(a)\n" for k in range(9000))
    text = f"import os\nclass A:\n{methods}\ndef last():\n    return 1\n"
    wrong = [("good.py", bytearray(text.encode())), ("bad.py", bytearray(f"{text}x = = 1\n".encode()))]
    files = cut(python_source.parsed(spark.createDataFrame(wrong, "path string, content binary"), "p"))
    assert files.select(F.max(F.greatest(*(F.size(k) for k in python_source.KINDS)))).first()[0] <= python_source.PIECE
    t = python_source.tables(files)
    assert {(r.qn, r.parse_error is None) for r in t["module"].collect()} == {("p.good", True), ("p.bad", False)} and t["module"].count() == 2
    assert [t[k].count() for k in ("import_fact", "class_fact", "callable_fact", "parameter", "variable", "call_fact", "body_node")] == [1, 1, 9001, 27000, 9000, 9000, 9001]
    assert t["callable_fact"].agg(F.countDistinct("ord"), F.max("ord"), F.max("line_end")).first()[:] == (9001, 9000, 18005)
    assert t["body_node"].agg(F.countDistinct("walk_ord"), F.countDistinct("node_id")).first()[:] == (9001, 9001)


def test_facts_are_not_broadcast_by_a_guessed_size(spark):
    """The part table is a few KB, its facts are not: no join of facts may be planned as a broadcast of them."""

    class Few:
        part = spark.range(50).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'T' as p_type")

    f = code.facts(Few())
    for table in ("parameter", "call_fact", "body_node"):
        assert "BroadcastHashJoin" not in f[table]._jdf.queryExecution().executedPlan().toString()


def test_the_inventory_does_not_read_its_files(spark):
    files = spark.createDataFrame([("a/x.py", "a/x.py"), ("b/x.py", "b/x.py"), ("b/x.py", "b/x.py")], "path string, text string").withColumn("content", F.raise_error("text"))
    t = {"module": spark.createDataFrame([("a/x.py", None), ("b/x.py", "SyntaxError")], "path string, parse_error string")}
    assert sorted(r[:] for r in model.source_files(files).collect()) == sorted(r[:] for r in model.source_files(t["module"]).collect())
    assert [r.name for r in model.source_files(files).collect()] == ["x.py", "x.py"]


def test_names_that_share_a_tail_do_not_meet(spark):
    """Names and references all end in run; only what fits may come out of the join, whose rows are counted."""
    asked = spark.range(300).selectExpr("concat('a.P', id, '.run') as name").unionByName(spark.sql("select 'run' as name"))
    implemented = spark.range(300).selectExpr("concat('b.Q', id, '.run') as reference", "concat('c', id) as component")
    out = runtime.component_names(asked, implemented)
    assert {(r.name, r.component) for r in out.collect()} == {("run", f"c{k}") for k in range(300)}
    plan, joined, seen = out._jdf.queryExecution().executedPlan(), [], []
    seen.append(plan.executedPlan() if hasattr(plan, "executedPlan") else plan)
    while seen:
        node = seen.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            seen.append(node.plan())
        seen += [node.children().apply(k) for k in range(node.children().size())]
    assert joined and max(joined) <= 600


def test_knowledge_edges_need_no_shuffle_of_pairs(spark):
    """Loops overlap, so pairs meet in several of them; each comes out once, and no exchange or aggregate stands above the last join."""
    rows = [(f"L{k % 5}", f"u{k}", "Monitor") for k in range(40)] + [(loop, "all", "Planner") for loop in ("L0", "L1", "L2", "L3", "L4")]
    rows += [("L0", "k0", "Knowledge"), ("L1", "k0", "Knowledge"), ("L4", "k4", "Knowledge"), ("L4", "all", "Knowledge"), ("a,1:b", "v", "Monitor"), ("a", "k4", "Knowledge"), (None, "v", "Monitor"), (None, "k0", "Knowledge")]
    members = spark.createDataFrame(rows, "loop string, component_id string, role string")
    wanted = {(a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[2] != "Knowledge" and b[2] == "Knowledge" and a[1] != b[1]}
    out = structure.knowledge_edges(members)
    assert sorted((r.source, r.target) for r in out.collect()) == sorted(wanted)
    above = out._jdf.queryExecution().sparkPlan().toString().partition("Join")[0]
    assert "Aggregate" not in above and "Exchange" not in above
