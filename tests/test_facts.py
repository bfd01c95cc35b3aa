"""Extraction and resolution on a small authored project."""

import pytest

from factgraph.facts import resolution
from factgraph.sources import python_source

FILES = {
    "base.py": """
class Base:
    def save(self):
        return True

    def reset(self, hard=False):
        pass
""",
    "app/__init__.py": "",
    "app/main.py": """
import os
import logging
from base import Base
from .util import helper, Missing

class Service(Base):
    limit: int = 3

    def __init__(self, name: str, other: "Base" = None):
        self.name = name
        self.log = logging.getLogger("x")
        self.parts = []

    def run(self, item: str, *args, flag=True, **kw):
        self.save()
        self.parts.append(item)
        self.name.upper()
        self.log.info("hi")
        item.strip()
        os.remove(item)
        total = helper(item)
        x = Base()
        x.reset()
        super().reset()
        self.nothing()
        print(total)
        unknown_name(total)
        for k in range(3):
            if k > 1 and flag:
                self.save()
        try:
            raise ValueError("no")
        except ValueError as e:
            return e
        finally:
            x.save()
""",
    "app/util.py": """
async def helper(x):
    with open(x) as f:
        y = f.read()
    return y
""",
    "bad.py": "def broken(:\n",
}


def local(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(p, bytearray(c.encode())) for p, c in FILES.items()]
    files = local(python_source.parsed(spark.createDataFrame(rows, "path string, content binary"), "proj"))
    return {k: local(v) for k, v in python_source.tables(files).items()}


@pytest.fixture(scope="module")
def resolved(facts):
    imports = local(resolution.resolve_imports(facts, "proj"))
    calls = resolution.resolve_function_calls(facts, imports).select("callable_id", "ord", "name", "line", "classification", "target_id", "module_id")
    methods = resolution.resolve_method_calls(facts, imports).select("callable_id", "ord", "name", "line", "classification", "target_id", "module_id")
    return imports, local(calls.unionByName(methods))


def test_modules_and_errors(facts):
    rows = {r.path: r for r in facts["module"].collect()}
    assert rows["app/main.py"].qn == "proj.app.main" and rows["app/__init__.py"].qn == "proj.app"
    assert rows["bad.py"].parse_error.startswith("SyntaxError") and rows["base.py"].parse_error is None


def test_definitions(facts):
    classes = {r.qn: r for r in facts["class_fact"].collect()}
    assert list(classes["proj.app.main.Service"].bases) == ["Base"]
    kinds = {r.qn: (r.kind, r.is_async) for r in facts["callable_fact"].collect()}
    assert kinds["proj.app.main.Service.__init__"] == ("constructor", False)
    assert kinds["proj.app.util.helper"] == ("function", True)
    params = [(r.name, r.kind, r.default_value) for r in facts["parameter"].where("callable_id = 'method:proj.app.main.Service.run'").orderBy("idx").collect()]
    assert params == [("self", "positional_or_keyword", None), ("item", "positional_or_keyword", None), ("args", "var_positional", None), ("flag", "keyword_only", "True"), ("kw", "var_keyword", None)]
    scopes = {(r.scope, r.name): r.assigned_type for r in facts["variable"].collect()}
    assert scopes[("instance_attribute", "log")] == "logging.getLogger" and scopes[("class_attribute", "limit")] == "int" and ("local", "total") in scopes


def test_imports(resolved):
    got = {(r.module, r.name): (r.classification, r.target_id) for r in resolved[0].collect()}
    assert got[("os", None)] == ("external", None)
    assert got[("base", "Base")] == ("internal", "class:proj.base.Base")
    assert got[("util", "helper")] == ("internal", "function:proj.app.util.helper")
    assert got[("util", "Missing")] == ("internal", "module:proj.app.util")


def test_calls(resolved):
    got = {(r.name, r.line): (r.classification, r.target_id) for r in resolved[1].where("callable_id = 'method:proj.app.main.Service.run'").collect()}
    by_name = {}
    for (name, _), v in sorted(got.items(), key=lambda x: x[0][1]):
        by_name.setdefault(name, v)
    assert by_name["self.save"] == ("internal", "method:proj.base.Base.save")
    assert by_name["self.parts.append"] == ("builtin_type_method", "builtin_type:list.append")
    assert by_name["self.log.info"] == ("external_type_method", "external_type:logging.Logger.info")
    assert by_name["item.strip"] == ("builtin_type_method", "builtin_type:str.strip")
    assert by_name["os.remove"] == ("external", None)
    assert by_name["helper"] == ("internal", "function:proj.app.util.helper")
    assert by_name["Base"] == ("constructor", "class:proj.base.Base")
    assert by_name["x.reset"] == ("internal", "method:proj.base.Base.reset")
    assert by_name["super.reset"] == ("internal", "method:proj.base.Base.reset")
    assert by_name["self.nothing"] == ("unresolved_method_on_parameter", None)
    assert by_name["print"] == ("builtin", "builtin:print")
    assert by_name["unknown_name"] == ("unresolved", None)


def test_no_row_is_lost_or_doubled(facts, resolved):
    assert resolved[1].count() == facts["call_fact"].count()


def test_body_tree(facts):
    rows = facts["body_node"].where("callable_id = 'method:proj.app.main.Service.run'").orderBy("walk_ord").collect()
    ids = {r.node_id for r in rows}
    assert all(r.parent_id in ids or r.depth == 0 for r in rows)
    loop = next(r for r in rows if r.control_type == "for")
    assert (loop.target, loop.iter) == ("k", "range")
    test = next(r for r in rows if r.control_type == "if")
    assert test.parent_id == loop.node_id and test.condition == "k > 1 and flag"
    handler = next(r for r in rows if r.type == "exception_handler")
    assert (handler.exception, handler.branch) == ("ValueError", "handlers")
    assert [r.branch for r in rows if r.depth == 1 and r.statement_type == "expression"] == ["finalbody"]


def test_edges_and_summary(facts, resolved):
    imports, calls = resolved
    rows = resolution.edges(facts, imports, calls).collect()
    assert len({r.edge_id for r in rows}) == len(rows)
    kinds = {(r.type, r.source, r.target) for r in rows}
    assert ("instantiates", "method:proj.app.main.Service.run", "class:proj.base.Base") in kinds
    assert ("contains", "class:proj.app.main.Service", "method:proj.app.main.Service.run") in kinds
    assert ("inherits", "class:proj.app.main.Service", "class_or_external:Base") in kinds
    s = resolution.summary(facts, calls).first()
    assert (s.files, s.parse_errors, s.classes, s.constructors) == (5, 1, 2, 1)
    matched = resolution.synchronised(facts, calls)
    assert matched.where("matched").count() > 10


def test_scan_skips_ignored_folders(spark, tmp_path):
    for p in ("a.py", "pkg/b.py", "venv/c.py", "pkg/__pycache__/d.py", "note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert sorted(r.path for r in python_source.scan(spark, str(tmp_path)).collect()) == ["a.py", "pkg/b.py"]


def test_receivers_of_every_tier(spark):
    """Chains on builtins, with variables, cls(), inherited methods of several bases, and super without bases."""
    code = """
class A:
    def one(self):
        pass

class B:
    def one(self):
        pass

class C(A, B):
    @classmethod
    def make(cls, name: "Optional[str]", rows: List[int]):
        x = cls()
        x.own()
        x.one()
        name.strip().title()
        rows.append(1)
        with open(name) as f, lock as g:
            f.read()
            g.release()
        return x

    def own(self):
        super().one()

class D:
    def go(self, c: C):
        super().go()
        c.one()
        c.make("a", [])
"""
    files = local(python_source.parsed(spark.createDataFrame([("m.py", bytearray(code.encode()))], "path string, content binary"), "p"))
    t = {k: local(v) for k, v in python_source.tables(files).items()}
    imports = local(resolution.resolve_imports(t, "p"))
    got = {(r.callable_id.rpartition(".")[2], r.name): (r.classification, r.target_id, r.n_candidates) for r in resolution.resolve_method_calls(t, imports).collect()}
    assert got[("make", "x.own")] == ("internal", "method:p.m.C.own", 0) and got[("make", "x.one")] == ("internal_ambiguous", None, 2)
    assert got[("make", "name.strip.title")][:2] == ("builtin_type_method", "builtin_type:str.title") and got[("make", "name.strip")][1] == "builtin_type:str.strip"
    assert got[("make", "rows.append")][1] == "builtin_type:list.append"
    assert got[("make", "f.read")][1] == "external_type:io.TextIOWrapper.read" and got[("make", "g.release")][0] == "unresolved_method_on_context_variable"
    assert got[("own", "super.one")] == ("internal_ambiguous", None, 2) and got[("go", "super.go")][0] == "unresolved_super_call"
    assert got[("go", "c.one")] == ("internal_ambiguous", None, 2) and got[("go", "c.make")][1] == "method:p.m.C.make"
    types = {(r.name, r.type_resolution, r.type_id) for r in resolution.variable_types(t, imports).collect()}
    assert ("x", "cls_constructor", "class:p.m.C") in types
    kinds = {(r.name, r.type_resolution, r.type_name) for r in resolution.parameter_types(t, imports).collect()}
    assert {("cls", "cls", "p.m.C"), ("self", "self", "p.m.D"), ("c", "resolved", "C"), ("name", "builtin", "str"), ("rows", "builtin", "list")} <= kinds
    calls = resolution.resolve_method_calls(t, imports)
    assert {r.candidate for r in resolution.method_candidates(t, calls.where("name = 'x.one'")).collect()} == {"method:p.m.A.one", "method:p.m.B.one"}
