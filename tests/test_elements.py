"""Elements, data edges, interfaces, external types and runtime evidence on small authored inputs."""

import pytest

from factgraph.facts import elements, resolution
from factgraph.recovery import runtime
from factgraph.sources import python_source

CODE = """
import os
from typing import Protocol

class Shape(Protocol):
    def area(self): ...

class Box:
    def __init__(self, side: float):
        self.side = side

    def grow(self, by: "Missing"):
        self.side = by
        other = Box(by)
        if other.side > 3:
            raise SizeError("big")
        with open(by) as f:
            pass
        return self.side
"""


def local(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def t(spark):
    files = local(python_source.parsed(spark.createDataFrame([("pkg/m.py", bytearray(CODE.encode()))], "path string, content binary"), "p"))
    return {k: local(v) for k, v in python_source.tables(files).items()}


def test_elements(t):
    rows = {r.id: r for r in elements.elements(t, "p").collect()}
    assert rows["module:p.pkg.m"].parent_id == "project:p" and rows["attribute:p.pkg.m.Box.side"].kind == "attribute"
    assert sum(r.kind == "context_variable" for r in rows.values()) == 1
    assert all(r.parent_id in rows for r in rows.values() if r.kind != "project")


def test_data_edges_and_types(t):
    data = elements.data_edges(t)
    got = {(r.type, r.source.rpartition(".")[2], r.target) for r in data.collect()}
    assert {("writes", "grow", "p.pkg.m.Box.side"), ("reads", "grow", "p.pkg.m.Box.side"), ("creates", "grow", "p.pkg.m.Box"), ("throws", "grow", "SizeError"), ("uses_type", "__init__", "float"), ("reads", "grow", "local_or_unresolved:by")} <= got
    assert {r.name: r.is_interface for r in elements.interfaces(t).collect()} == {"Shape": True, "Box": False}
    assert {r.name for r in elements.external_types(t, data).collect()} == {"Protocol", "SizeError"}
    imports = local(resolution.resolve_imports(t, "p"))
    assert {(r.prefix, r.parent) for r in elements.packages(t, imports).collect()} == {("p", None), ("p.pkg", "p")}


def test_locations_and_traces(spark, t):
    edges = spark.createDataFrame([("calls", "a", "b", None), ("calls", "b", "c", 7), ("calls", "x", "a", None), ("calls", "x", "y", None)], "type string, source string, target string, line int")
    index = spark.createDataFrame([("a", 3), ("a", 2), ("b", 9)], "id string, line int")
    assert {(r.source, r.target): r.line for r in elements.located(edges, index).collect()} == {("a", "b"): 2, ("b", "c"): 7, ("x", "a"): 2, ("x", "y"): None}
    seen = spark.createDataFrame([("m.b", "q"), ("z", "w")], "source string, target string")
    got = {(r.kind, r.source, r.target) for r in elements.traced(edges, seen, "b").collect()}
    assert got == {("static", "a", "b"), ("static", "b", "c"), ("runtime", "m.b", "q")}


def test_runtime_evidence(spark):
    known = spark.createDataFrame([("1", "p.a.C.run"), ("2", "p.a.D.run"), ("3", "p.b.stop"), ("4", "p.c.E.go")], "id string, qn string")
    seen = spark.createDataFrame([("p.a.C.run",), ("x.D.run",), ("y.stop",), ("z.run",), ("none",), ("stop",), ("run",), ("p/a.C.run",), ("E.go",)], "name string")
    want = {"p.a.C.run": "1", "x.D.run": "2", "y.stop": None, "z.run": None, "none": None, "stop": "3", "run": None, "p/a.C.run": "1", "E.go": "4"}
    assert {r.name: r.target_id for r in runtime.resolve_endpoints(seen, known).collect()} == want
    implemented = spark.createDataFrame([("p.a.C.run", "k1"), ("C.run", "k2"), ("z.C.run", "k3"), ("p.q.other", "k4")], "reference string, component string")
    asked = spark.createDataFrame([("C.run",), ("x.C.run",), ("other",), ("no.such",)], "name string")
    assert {(r.name, r.component) for r in runtime.component_names(asked, implemented).collect()} == {("C.run", "k2"), ("x.C.run", "k1"), ("x.C.run", "k2"), ("x.C.run", "k3"), ("other", "k4")}
    edges = spark.createDataFrame([("C.run", "stop", "s"), ("C.run", "stop", "s"), ("stop", "E.go", "t"), ("lost", "stop", "t")], "source string, target string, scenario string")
    static = spark.createDataFrame([("3", "4")], "source string, target string")
    assert [(r.source_id, r.target_id) for r in runtime.runtime_call_actions(edges, known, static).collect()] == [("1", "3")]
    calls = spark.createDataFrame([("q.run", "stop"), ("q.run", "start")], "source string, target string")
    assert [r.target for r in runtime.unexplained(calls, edges).collect()] == ["start"]
    owner = spark.createDataFrame([("C.run", "k1"), ("stop", "k2")], "name string, component string")
    s = runtime.summary(edges, owner)
    assert s["unmapped"].first().n_unmapped == 2 and [(r.source_component, r.target_component, r.n) for r in s["pairs"].collect()] == [("k1", "k2", 2)]
    assert {r.scenario: r.n for r in s["by_scenario"].collect()} == {"s": 2, "t": 2} and s["sources"].first().source == "C.run"
