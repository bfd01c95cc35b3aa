"""Model rows, validators, XMI, recovery, review and traces on small authored inputs."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from factgraph.facts import resolution
from factgraph.kdm import model, validation, xmi
from factgraph.operators import graphs
from factgraph.operators.lineage import written
from factgraph.plans import catalog, code
from factgraph.plans.registry import Tables
from factgraph.recovery import roles, structure
from factgraph.review import findings
from factgraph.sources import documents, python_source
from factgraph.streaming import trace

CODE = """
class Monitor:
    def __init__(self):
        self.value = 0

    def read(self):
        y = self.value
        try:
            return helper(y)
        except ValueError:
            raise
        finally:
            y = 1
        return

def helper(x):
    return x
"""


def local(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def built(spark):
    files = local(python_source.parsed(spark.createDataFrame([("m.py", bytearray(CODE.encode()))], "path string, content binary"), "p"))
    t = {k: local(v) for k, v in python_source.tables(files).items()}
    imports = local(resolution.resolve_imports(t, "p"))
    cols = ["callable_id", "ord", "name", "line", "classification", "target_id", "module_id"]
    calls = local(resolution.resolve_function_calls(t, imports).select(*cols).unionByName(resolution.resolve_method_calls(t, imports).select(*cols)))
    more, related = model.detail(t, imports)
    node = local(model.nodes(t, "p").unionByName(model.external_nodes(calls, imports)).unionByName(more))
    relation = local(model.relations(t, imports, calls, local(resolution.synchronised(t, calls))).unionByName(related))
    return t, node, relation, local(model.attributes(t)), local(model.regions(t))


def test_model_is_valid(built):
    _, node, relation, attribute, region = built
    assert [r for r in validation.validate(node, relation, attribute, region).collect() if r.level == "error"] == []
    counts = {r.metaclass: r.n for r in model.metaclass_counts(node, relation).collect()}
    assert counts["ClassUnit"] == 1 and counts["MethodUnit"] == 2 and counts["TryUnit"] == counts["CatchUnit"] == counts["FinallyUnit"] == 1
    assert counts["ExceptionFlow"] == counts["ExitFlow"] == 1 and counts["Calls"] == 1
    tags = {(r.tag, r.value) for r in attribute.collect()}
    assert ("return_flow", "void") in tags and ("exception_flow", "rethrow") in tags
    assert relation.where("type = 'Writes'").count() == 3


def test_validators_fire(spark, built):
    _, node, relation, attribute, region = built
    bad_relation = relation.unionByName(spark.createDataFrame([("x", "Calls", "nowhere"), ("x", "Writes", "segment")], "owner_id string, type string, target_id string"))
    bad_attribute = attribute.unionByName(spark.createDataFrame([("x", "body_id", "1")], "owner_id string, tag string, value string"))
    bad_region = region.unionByName(spark.createDataFrame([("x", None, 1, 2), ("x", "m.py", 3, 2)], "owner_id string, path string, start_line int, end_line int"))
    rules = {r.rule_id for r in validation.validate(node, bad_relation, bad_attribute, bad_region).where("level = 'error'").collect()}
    assert {"KDM-REL-01", "KDM-REL-02", "KDM-TAG-01", "KDM-REG-01", "KDM-REG-02"} <= rules
    found = validation.regression(node, relation, bad_attribute, {"ClassUnit": 2, "MethodUnit": 1}).collect()
    assert {(r.rule_id, r.element) for r in found} == {("REG-TAG", "x"), ("REG-COUNT", "ClassUnit")}


def test_builtin_calls_have_targets(spark):
    source = "def go(size):\n    items = []\n    items.append(size)\n    print(size)\n    with open(size) as f:\n        f.read()\n    raise ValueError(size)\n"
    t = {k: local(v) for k, v in python_source.tables(local(python_source.parsed(spark.createDataFrame([("m.py", bytearray(source.encode()))], "path string, content binary"), "p"))).items()}
    imports = local(resolution.resolve_imports(t, "p"))
    cols = ["callable_id", "ord", "name", "line", "classification", "target_id", "module_id"]
    calls = local(resolution.resolve_function_calls(t, imports).select(*cols).unionByName(resolution.resolve_method_calls(t, imports).select(*cols)))
    more, related = model.detail(t, imports)
    node = local(model.nodes(t, "p").unionByName(model.external_nodes(calls, imports)).unionByName(more))
    relation = local(model.relations(t, imports, calls, local(resolution.synchronised(t, calls))).unionByName(related))
    called = {r.target_id: (r.metaclass, r.name) for r in relation.where("type = 'Calls'").join(node.withColumnRenamed("id", "target_id"), "target_id", "left").collect()}
    assert called == {
        "builtin_type:list.append": ("CallableUnit", "append"), "builtin:print": ("CallableUnit", "print"), "builtin:open": ("CallableUnit", "open"),
        "external_type:io.TextIOWrapper.read": ("ClassUnit", "read"), "builtin:ValueError": ("ClassUnit", "ValueError")}
    region = local(model.regions(t))
    assert validation.validate(node, relation, local(model.attributes(t)), region).collect() == []
    twin = node.unionByName(node.where("name = 'raise'").withColumn("id", F.lit("twin")))
    at = region.unionByName(region.join(node.where("name = 'raise'").select(F.col("id").alias("owner_id")), "owner_id").withColumn("owner_id", F.lit("twin")))
    assert "KDM-ACT-03" in {r.rule_id for r in validation.validate(twin, relation, local(model.attributes(t)), at).collect()}


def test_model_findings_hold_relations_without_target(spark, monkeypatch):
    """No rule's findings are left out: without the stubs of what lies outside, the query tells of each relation to them."""
    stubs = model.external_nodes
    monkeypatch.setattr(model, "external_nodes", lambda calls, imports: stubs(calls, imports).where("false"))
    found = {r.rule_id: (r.level, r.n) for r in catalog.queries()["model_findings"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {"KDM-REL-01"} and found["KDM-REL-01"][0] == "error" and found["KDM-REL-01"][1] > 78


def test_xmi_round_trip(spark, built, tmp_path):
    _, node, relation, attribute, _ = built
    path = str(tmp_path / "model.xmi")
    xmi.write_file(node, relation, attribute, path)
    tree = ET.parse(path)
    ids = [e.get("{http://www.omg.org/XMI}id") for e in tree.iter() if e.get("{http://www.omg.org/XMI}id")]
    assert len(ids) == node.count() == len(set(ids))
    assert {r.metaclass: r.n for r in xmi.read_counts(spark, path).collect()} == {r.metaclass: r.n for r in model.metaclass_counts(node, relation).collect()}
    cols = ["id", "metaclass", "feature", "name", "kind"]
    assert sorted(map(tuple, xmi.read_nodes(spark, path).select(*cols).collect()), key=repr) == sorted(map(tuple, node.select(*cols).collect()), key=repr)
    assert tree.find(".//actionRelation[@{http://www.w3.org/2001/XMLSchema-instance}type='action:Throws']") is None  # a bare raise throws nothing
    again = str(tmp_path / "again.xmi")
    xmi.write_file(node.repartition(7), relation, attribute, again)
    assert open(path).read() == open(again).read()


def test_xmi_levels_carry_only_what_holds_others(spark, monkeypatch):
    rows = [("root", None, 0), *((f"n{k}", f"n{k - 1}" if k else "root", 0) for k in range(20)), *((f"leaf{k}", f"n{k % 20}", k) for k in range(200)), ("lost", "nowhere", 0), ("own", "own", 0)]
    node = spark.createDataFrame([(i, p, "codeElement", o, "ActionElement", i, None) for i, p, o in rows], "id string, parent_id string, feature string, ord long, metaclass string, name string, kind string")
    seen = []
    monkeypatch.setattr(xmi, "cut", lambda df: seen.append(df) or local(df))
    none = spark.createDataFrame([], "owner_id string, type string, target_id string")
    got = xmi.lines(node, none, spark.createDataFrame([], "owner_id string, tag string, value string")).collect()
    assert [r.path for r in got] == sorted(r.path for r in got) and len(got) == 1 + 20 + 200
    assert {r.depth for r in got if "leaf19\"" in r.opening or "leaf0\"" in r.opening} == {21, 2}
    assert seen and not any("opening" in df.columns for df in seen) and max(len(df.collect()) for df in seen[:3]) <= 22


def test_model_reads_only_the_columns_of_written_facts(spark):
    t = code.model_facts(Tables(spark, "/root/testdata/sf0.001"))
    assert "arguments" not in t["call_fact"].columns and t["body_node"] is t["body_node"]
    for rows, wide in ((model.flows(t), "walk_ord"), (model.regions(t), "condition"), (model.accesses(t), "decorators")):  # relations, findings, both
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan and "explode(body" not in plan and "parse_error" not in plan and wide not in plan


def test_written_tables_are_not_small_because_they_compress(spark):
    rows = spark.range(60000).select(F.col("id"), F.lit("x" * 1000).alias("text"))
    back = written(rows)
    join = back.join(spark.range(10**8).withColumnRenamed("id", "other"), F.col("text") == F.col("other").cast("string"))
    assert back.count() == 60000 and "BroadcastHashJoin" not in join._jdf.queryExecution().executedPlan().toString()


def test_gate(spark):
    rows = [("low", "helper"), ("mid", "adaptive-loop"), ("mid", "sensor.read"), ("mid", "state"), ("all", "self_adaptive monitor analyzer planner"), ("all", "sensor apply knowledge")]
    got = {r.project: r for r in roles.gate(spark.createDataFrame(rows, "project string, text string")).collect()}
    assert (got["low"].score, got["low"].decision) == (0.0, "not_applicable")
    assert got["mid"].decision == "needs_review" and got["mid"].score == 0.65
    assert got["all"].decision == "mapek_recovery_enabled" and got["all"].score == 0.9


def test_role_scores(spark):
    classes = spark.createDataFrame([("c1", "LoadMonitor", "a/monitor.py"), ("c2", "Thing", "a/x.py"), ("c3", "Plain", "a/y.py")], "class_id string, name string, path string")
    methods = spark.createDataFrame([("c1", "collect"), ("c1", "measure"), ("c1", "observe"), ("c2", "decide")], "class_id string, name string")
    got = {r.class_id: (r.role, r.confidence, r.status) for r in roles.class_roles(classes, methods).collect()}
    assert got["c1"] == ("Monitor", 0.9, "auto_accepted")
    assert got["c2"] == ("Planner", 0.1, "weak_suggestion")
    assert "c3" not in got
    deco = spark.createDataFrame([("f1", "watch", ["loop.monitor"]), ("f2", "go", ["app.loop.execute", "x"])], "callable_id string, name string, decorators array<string>")
    assert {(r.callable_id, r.role, r.loop_hint) for r in roles.decorator_roles(deco).collect()} == {("f1", "Monitor", "loop"), ("f2", "Executor", "app")}


def test_control_io_caps_and_exclusions(spark):
    rows = [(f"v{k:02d}", f"target_{k}", "variable", "a/b.py") for k in range(12)] + [("s1", "read_sensor", "function", "a.b"), ("s2", "read_sensor", "function", "app.utils.x"), ("s3", "_read", "variable", "a.b"), ("e1", "brake", "method", "a.c"), ("g1", "get", "method", "a.sensor")]
    got = roles.control_io(spark.createDataFrame(rows, "id string, name string, kind string, qualified_name string")).collect()
    by_role = {}
    for r in got:
        by_role.setdefault(r.role, []).append(r.id)
    assert sorted(by_role["ReferenceInput"]) == [f"v{k:02d}" for k in range(8)] and sorted(by_role["Sensor"]) == ["s1", "s3"] and by_role["Effector"] == ["e1"]


COMPONENT = "id string, name string, role string, loop_hint string, confidence double, status string, ord int, tokens array<string>, implemented_by array<string>, materialize boolean, review_status string"


@pytest.fixture(scope="module")
def components(spark):
    row = lambda k, role, hint, **m: (f"c{k}", f"n{k}", role, hint, 0.9, "auto_accepted", k, m.get("tokens", []), m.get("by", [f"code{k}"]), m.get("live"), m.get("review"))
    return spark.createDataFrame(
        [row(1, "Monitor", "L"), row(2, "Analyzer", "L"), row(3, "Planner", "L"), row(4, "Executor", "L", tokens=["gas", "pedal"]), row(5, "Knowledge", None), row(6, "Monitor", "one"), row(7, "Effector", None, tokens=["gas"]), row(8, "Sensor", None, by=["code1"])],
        COMPONENT)


def test_loops_and_edges(spark, components):
    members = local(structure.loop_members(components))
    loops = {r.name: r for r in structure.control_loops(members).collect()}
    assert sorted(loops) == ["L", "one"] and loops["L"].completeness == "complete" and loops["L"].n_members == 5 and loops["one"].completeness == "weak"
    assert {(r.source, r.target) for r in structure.flow_edges(members).collect()} == {("c1", "c2"), ("c2", "c3"), ("c3", "c4")}
    assert {(r.source, r.target) for r in structure.knowledge_edges(members).collect()} == {(f"c{k}", "c5") for k in (1, 2, 3, 4, 6)}
    edge = structure.boundary_edges(components).collect()
    assert [(r.source, r.target, r.type, r.confidence) for r in edge] == [("c4", "c7", "acts_through", 0.85)]
    assert {r.subsystem_id: r.n_components for r in structure.subsystems(components).collect()} == {"subsystem:managing_subsystem": 6, "subsystem:managed_subsystem": 2}
    warned = {r.rule_id for r in structure.construction_warnings(structure.control_loops(members), components).collect()}
    assert warned == {"LOOP-OK01", "LOOP-W01", "CTRL-W01", "CTRL-W02"}
    said = structure.suggestions(components, structure.control_loops(members), spark.createDataFrame([("c1", "c8", "s"), ("c2", "c1", "s")], "source string, target string, scenario string")).collect()
    assert sorted(r.suggestion_type for r in said) == ["dynamic_relation", "role_disambiguation"]
    pairs = spark.createDataFrame([("s", "Managing Subsystem", "l", "Control Loop", True), ("m", "CL Manager", "l", "Control Loop", True), ("l", "Control Loop", "x", "Sensor", True)], "source string, source_role string, target string, target_role string, has_loop_manager boolean")
    ok, blocked = structure.containment(pairs)
    assert [(r.source, r.target) for r in ok.collect()] == [("m", "l")] and sorted(r.rule_id for r in blocked.collect()) == ["CONTAIN-FORBIDDEN", "CONTAIN-FORBIDDEN", "CONTAIN-OK"]


def test_review_rules(spark, components):
    extra = [("c1", "dup", "Monitor", None, 0.5, "x", 9, [], [], True, "accepted"), ("c9", "n9", "Wizard", None, 0.9, "x", 10, [], ["k"], None, None), ("c10", "n10", "Planner", None, 0.9, "x", 11, [], ["k"], False, None)]
    all_ = components.unionByName(spark.createDataFrame(extra, COMPONENT))
    got = {(r.rule_id, r.element) for r in findings.component_findings(all_, spark.createDataFrame([(f"code{k}",) for k in range(8)], "id string")).collect()}
    assert {("ARV-F-01", "c9"), ("ARV-F-02", "c1"), ("ARV-W-02", "c1"), ("ARV-W-08", "c1"), ("ARV-OK-01", "c1"), ("ARV-OK-02", "c10"), ("ARV-W-04", "code1")} <= got
    schema = "id string, source string, target string, type string, materialize boolean, review_status string, source_level string, relationship_level string"
    edges = [
        ("e1", "gone", "c1", "mapek_flow", None, None, None, None), ("e2", "c1", "gone", "bad", None, None, None, None), ("e3", "c1", "c10", "mapek_flow", None, None, None, None), ("e4", "c1", "c2", "bad", None, None, None, None),
        ("e5", "c1", "c2", "uses_knowledge", None, None, None, None), ("e6", "c1", "c4", "mapek_flow", None, None, None, None), ("e7", "c2", "c1", "mapek_flow", None, "accepted", "technical", "architectural"), ("e8", "c2", "c1", "mapek_flow", True, None, None, None),
        ("e9", "gone", "c1", "bad", False, None, None, None),
    ]
    got = {(r.rule_id, r.element) for r in findings.edge_findings(spark.createDataFrame(edges, schema), all_).collect()}
    assert {("ARV-F-03", "e1"), ("ARV-F-04", "e2"), ("ARV-F-05", "e3"), ("ARV-F-08", "e4"), ("ARV-F-07", "e5"), ("ARV-W-06", "e6"), ("ARV-W-05", "e7"), ("ARV-W-07", "e7"), ("ARV-OK-04", "e7"), ("ARV-F-10", "c2|mapek_flow|c1")} <= got
    assert not any(e == "e9" for _, e in got) and ("ARV-F-08", "e2") not in got
    loops = spark.createDataFrame([("L", None, None), ("M", 1, None), ("gone", 1, False)], "id string, level int, materialize boolean")
    members = spark.createDataFrame([("L", "c1"), ("L", "c2"), ("L", "c5"), ("L", "c10")], "loop_id string, component_id string")
    got = {(r.rule_id, r.element) for r in findings.loop_findings(loops, members, all_).collect()}
    assert got == {("ARV-F-06", "L"), ("ARV-F-09", "M"), ("ARV-W-01", "L"), ("ARV-W-01", "M"), ("ARV-W-11", "L")}
    s = findings.summary(findings.loop_findings(loops, members, all_)).first()
    assert (s.n_forbidden, s.valid) == (2, False)
    mixed = spark.createDataFrame([("s1", "c1"), ("s1", "c7"), ("s2", "c1")], "subsystem_id string, component_id string")
    assert [r.element for r in findings.subsystem_findings(mixed, all_).collect()] == ["s1"]


TRACE = [(0, "call", "a"), (1, "call", "a.b"), (2, "call", "a.c"), (3, "return", "a.c"), (4, "call", "a.d"), (5, "return", "a.d"), (6, "return", "a.b"), (7, "call", "a.e"), (8, "call", "lib.x")]
EXPECTED = {(1, "a", "a.b"), (2, "a.b", "a.c"), (4, "a.b", "a.d"), (7, "a", "a.e"), (8, "a.e", "lib.x")}


def events(spark):
    rows = [("t", o, kind, None, 1, "s", name) for o, kind, name in TRACE]
    return spark.createDataFrame(rows, trace.EVENT).withColumn("ts", F.timestamp_seconds(F.col("ord") * 60))


def test_batch_and_stream_give_the_same_edges(spark, tmp_path):
    batch = events(spark)
    assert {(r.ord, r.source, r.target) for r in trace.runtime_edges(batch).collect()} == EXPECTED
    for k in range(3):  # three micro-batches
        batch.where((F.col("ord") >= 3 * k) & (F.col("ord") < 3 * k + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = trace.streaming_edges(stream).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert {(r.ord, r.source, r.target) for r in spark.table("edges").collect()} == EXPECTED
        q = trace.windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sum(r.n for r in spark.table("counts").collect()) == len(TRACE)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_relevance_and_summary(spark):
    raw = events(spark)
    kept = trace.relevant(raw, ["a"], ["x"])
    assert kept.count() == 8
    known = spark.createDataFrame([("a", "a.b")], "source string, target string")
    s = trace.enrichment_summary(raw, kept, trace.runtime_edges(kept), known).first()
    assert (s.raw_events, s.kept_events, s.filtered_events, s.observed_edges, s.added_edges) == (9, 8, 1, 4, 3)


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"projectName": "p", "language": "python", "files": []}')
    assert documents.read_model(spark, str(tmp_path / "m.json")).first().projectName == "p"
    (tmp_path / "bad.json").write_text('{"projectName": "p"}')
    with pytest.raises(ValueError, match="bad.json: missing required fields: language, files"):
        documents.read_model(spark, str(tmp_path / "bad.json"))
    (tmp_path / "t.json").write_text('{"version": "1", "type": "runtime_trace", "events": [{"type": "call", "timestamp": 1.5, "qualified_name": "a"}, {"type": "return"}, {"type": "call"}]}')
    rows = documents.read_trace(spark, str(tmp_path / "t.json"), max_events=2).orderBy("ord").collect()
    assert [r.type for r in rows] == ["call", "return"] and rows[0].ts.microsecond == 500000
    bad = spark.createDataFrame([("a", None, 0.5), ("b", "Wizard", 2.0)], "id string, role string, confidence double")
    found = documents.schema_findings(bad, "id", ["role"], {"role": ["Monitor"]}, {"confidence": (0, 1)}).collect()
    assert sorted((r.element, r.message.split(" ")[0]) for r in found) == [("a", "role"), ("b", "confidence"), ("b", "role")]


def test_closure_and_levels_have_no_depth(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(3, 0)], "child int, parent int").coalesce(1)
    up = graphs.closure(chain)
    assert up.agg(F.max("depth")).first()[0] == 100 and up.where("node = 0").count() == 101 - 0
    down = graphs.levels(chain, spark.createDataFrame([(100,)], "root int"), "root")
    assert {r.node: r.level for r in down.collect()} == {k: 100 - k for k in range(101)}


def test_overrides_come_one_for_each_key(spark):
    from factgraph.operators import matching

    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id int, role string, name string")
    over = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (1, None, 3), (9, "n", 1), (9, "m", 2), (None, "q", 1)], "id int, role string, at int")
    got = sorted((r.id, r.role, r.name, r.review_status) for r in matching.apply_overrides(base, over, "id", ["role"], ["at"]).collect())
    assert got == [(1, "d", "x", "reviewed"), (2, "b", "y", "unchanged"), (3, None, "z", "unchanged"), (9, "m", None, "added")]
    edges = spark.createDataFrame([("e1", "t", "technical", None, None, None), ("e2", "t", None, None, True, None), ("e3", "t", None, None, None, None)], "id string, type string, relationship_level string, source_level string, materialize boolean, review_status string")
    said = spark.createDataFrame([("e1", None, None, True), ("e2", "rejected", None, None), ("e3", "accepted", "depends_on", None), ("e4", "accepted", None, None)], "id string, decision string, type string, promote_to_architectural boolean")
    got = {r.id: tuple(r)[1:] for r in matching.apply_decisions(edges, said, "id", ["type"], promote=True).collect()}
    assert got == {"e1": ("t", "architectural", "technical", True, "user_promoted"), "e2": ("t", None, None, False, "user_rejected"), "e3": ("depends_on", None, None, True, "user_modified")}


def test_suggestions_merge_with_the_deterministic_one_first(spark):
    from factgraph.operators import selection

    rows = [("a", "k", "llm:x", 0.95, ["p"]), ("b", "k", "dynamic_evidence", 0.9, ["q", "p"]), ("c", None, "llm:x", 0.1, None), ("d", None, "llm:x", 0.2, ["z"])]
    out = selection.merge_suggestions(spark.createDataFrame(rows, "id string, semantic_key string, source string, confidence double, evidence array<string>")).collect()
    assert sorted((r.id, r.confidence, r.evidence) for r in out) == [("b", 0.95, ["p", "q"]), ("c", 0.1, None), ("d", 0.2, ["z"])]


def test_knowledge_edges_of_all_components(spark, tmp_path):
    """Components without a hint are in every loop, with Knowledge members in lists of any length; without hints there is one loop."""
    import duckdb

    part = "p_partkey long, p_name string, p_brand string, p_size int"
    rows = [(1, "a", "x", 0), (2, "b", "x", 4), (3, "c", "y", 1), (5, "d", "y", 4), (4, "e", "x", 4), (8, "f", None, 2), (9, "g", None, 6)]
    expected = {(1, 2), (1, 4), (3, 5), (3, 4), (8, 2), (8, 5), (8, 4)}
    for name, some, wanted in (("hints", rows[:6], expected), ("none", [r for r in rows if r[0] % 4 == 0], {(8, 4)}), ("null", [(k, n, None, s) for k, n, _, s in rows], {(a, b) for a in (1, 3, 8) for b in (2, 5, 4)})):
        spark.createDataFrame(some, part).coalesce(1).write.parquet(str(tmp_path / name / "part.parquet"))
        got = sorted((int(r.source[10:]), int(r.target[10:]), r.confidence) for r in catalog.queries()["knowledge_edges"](spark, str(tmp_path / name)).collect())
        assert got == sorted((a, b, 0.8) for a, b in wanted)
        with duckdb.connect() as con:
            con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/{name}/part.parquet/*.parquet'")
            assert sorted((int(a[10:]), int(b[10:]), c) for a, b, c in con.sql(catalog.oracle_sql()["knowledge_edges"]).fetchall()) == got
    many = spark.range(2 * structure.CHUNK).selectExpr("'L' as loop", "concat('k', id) as component_id", "'Knowledge' as role").unionByName(spark.sql("select 'L' as loop, 'u' as component_id, 'Monitor' as role"))
    out = structure.knowledge_edges(many).select("source", "target").collect()
    assert len(out) == len(set(out)) == 2 * structure.CHUNK


def test_weak_loops_and_applied_suggestions(spark):
    members = spark.createDataFrame([("w", "c1", "Monitor", 0.9, 1), ("w", "c2", "Knowledge", 0.9, 2), ("x", "c3", "Monitor", 0.9, 1), ("x", "c4", "ReferenceInput", 0.9, 1)], "loop string, component_id string, role string, confidence double, ord int")
    loops = structure.control_loops(members).collect()
    assert [(r.name, r.completeness, r.role_counts, r.missing_roles) for r in loops] == [("w", "weak", {"Knowledge": 1, "Monitor": 1}, ["Analyzer", "Executor", "Planner"])]
    edges = spark.createDataFrame([("a", "b", "observes")], "source string, target string, type string")
    wanted = spark.createDataFrame([("add_relationship", "a", "b", "observes"), ("add_relationship", "a", "c", "observes"), ("rename", "a", None, None)], "operation string, source string, target string, relationship_type string")
    new, odd = structure.apply_suggestions(edges, wanted)
    assert [(r.source, r.target) for r in new.collect()] == [("a", "c")] and [r.element for r in odd.collect()] == ["rename"]


def test_detail_of_returns_raises_types_and_values(spark):
    code = "class Odd(Exception):\n    pass\n\nclass Box(Thing):\n    def __init__(self, size: int, other: 'Box', path: pathlib.Path):\n        self.size = 3\n        self.names = []\n    def go(self):\n        if self.size:\n            raise Odd('x')\n        raise ValueError('y')\n    def stop(self):\n        return True\n    def all(self):\n        return self.names\n    def none(self):\n        return\n"
    files = local(python_source.parsed(spark.createDataFrame([("m.py", bytearray(code.encode()))], "path string, content binary"), "p"))
    t = {k: local(v) for k, v in python_source.tables(files).items()}
    imports = local(resolution.resolve_imports(t, "p"))
    node, relation = map(local, model.detail(t, imports))
    name = {r.id: (r.metaclass, r.name) for r in node.collect()} | {f"class:p.m.{c}": ("ClassUnit", c) for c in ("Odd", "Box")}
    got = sorted((r.type, name[r.target_id]) for r in relation.collect())
    assert got == sorted([
        ("HasType", ("IntegerType", "int")), ("HasType", ("IntegerType", "int")), ("HasType", ("ClassUnit", "Box")), ("HasType", ("ClassUnit", "pathlib.Path")), ("HasType", ("Datatype", "list")),
        ("HasType", ("ClassUnit", "Odd")), ("HasType", ("ClassUnit", "ValueError")), ("Throws", ("StorableUnit", "Odd")), ("Throws", ("StorableUnit", "ValueError")),
        ("Reads", ("StorableUnit", "return")), ("Reads", ("StorableUnit", "return")), ("HasValue", ("Value", "True")), ("HasValue", ("Value", "3"))])
    extends = {(r.owner_id, name[r.target_id][1]) for r in model.extended(t).collect()}
    assert extends == {("class:p.m.Odd", "Exception"), ("class:p.m.Box", "Thing")}
    assert {(r.callable_id.rpartition(".")[2], r.start_line, r.end_line) for r in model.body_spans(t).collect()} >= {("go", 9, 11), ("none", 17, 17)}


def test_actions_merge(spark):
    node = spark.createDataFrame([("b", None, "f", 0, "BlockUnit", "body", None), ("x", "b", "f", 1, "ActionElement", "call", "call"), ("y", "b", "f", 2, "ActionElement", "call", "call"), ("z", "y", "f", 3, "ActionElement", "call", "call")], "id string, parent_id string, feature string, ord long, metaclass string, name string, kind string")
    relation = spark.createDataFrame([("x", "Calls", "m"), ("y", "Reads", "v"), ("y", "Calls", "m")], "owner_id string, type string, target_id string")
    region = spark.createDataFrame([("x", "p", 1, 1), ("y", "p", 1, 1), ("z", "p", 1, 1)], "owner_id string, path string, start_line int, end_line int")
    nodes, relations = model.merge_actions(node, relation, region)
    assert {(r.id, r.parent_id) for r in nodes.collect()} == {("b", None), ("x", "b"), ("z", "x")}
    assert {tuple(r) for r in relations.collect()} == {("x", "Calls", "m"), ("x", "Reads", "v")}
    assert model.cycles(node).count() == 0 and model.cycles(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")).count() == 2


def test_structure_model(spark, components):
    members = local(structure.loop_members(components))
    loops = local(structure.control_loops(members))
    edges = local(structure.flow_edges(members))
    code = spark.createDataFrame([(f"code{k}",) for k in range(1, 5)], "id string")
    node, relation, attribute = (local(x) for x in model.structure_model(components, loops, members, edges, code))
    parent = {r.id: r.parent_id for r in node.collect()}
    assert parent["c1"] == "control_loop:l" and parent["c7"] == "subsystem:managed_subsystem" and parent["control_loop:l"] == "subsystem:managing_subsystem"
    assert set(parent.values()) - set(parent) == {"segment"} and model.cycles(node).count() == 0
    assert relation.where("type = 'implementation'").count() >= 4 and attribute.where("tag = 'implemented_by'").count() >= 1
    assert ("c1", "stereotype", "Monitor") in {tuple(r) for r in attribute.collect()}
    counts = {r.metaclass: r.n for r in node.groupBy("metaclass").agg(F.count("*").alias("n")).collect()}
    assert counts["AggregatedRelationship"] == edges.count() and counts["Subsystem"] == 2


def test_configuration_and_folders(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"project": {"name": "p"}, "steps": [1]}')
    (tmp_path / "x.xmi").write_text("<a/>")
    assert documents.read_config(spark, str(tmp_path / "c.json")) == {"project": {"name": "p"}, "steps": [1]}
    assert [r.path.rpartition("/")[2] for r in documents.selected_inputs(spark, str(tmp_path)).collect()] == ["c.json"]
    assert {(r.kind, r.files, r.bytes) for r in documents.artifact_summary(spark, str(tmp_path)).collect()} == {("json", 1, 40), ("xmi", 1, 4)}


DOCUMENT = """{"projectName": "p", "language": "java", "files": [{"name": "A.java", "path": "a/A.java", "qualifiedName": "a.A", "imports": [{"import_type": "import", "module": "java.util", "line": 1}],
 "classes": [{"name": "A", "qualifiedName": "a.A", "extendsTypes": ["Base"], "implementsTypes": ["Face"], "annotations": ["Service"], "fields": [{"name": "n", "type": "int", "lineStart": 3}],
  "methods": [{"name": "foo", "qualifiedName": "a.A.foo", "parameters": [{"name": "x", "type": "List<String>"}], "calls": [{"name": "this.bar", "line": 5}],
   "body": [{"id": "b1", "type": "control_structure", "control_type": "try", "line_start": 4, "line_end": 9, "body": [{"id": "b2", "type": "statement", "statement_type": "raise", "exception": null, "exception_calls": [], "line_start": 5, "line_end": 5}],
     "handlers": [{"id": "b3", "type": "exception_handler", "exception": "E", "line_start": 6, "line_end": 7, "body": [{"id": "b4", "type": "statement", "statement_type": "return", "value": "True", "line_start": 7, "line_end": 7}]}]}]}]}]}]}"""


def test_documents_give_the_same_fact_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(DOCUMENT)
    t = {k: local(v) for k, v in python_source.tables(local(documents.document_files(spark, str(tmp_path / "m.json")))).items()}
    assert [(r.class_id, list(r.bases), list(r.decorators)) for r in t["class_fact"].collect()] == [("class:a.A", ["Base", "Face"], ["Service"])]
    assert [(r.callable_id, r.name) for r in t["callable_fact"].collect()] == [("method:a.A.foo", "foo")]
    assert {(r.node_id, r.parent_id, r.branch, r.depth) for r in t["body_node"].collect()} == {("b1", "a.A.foo", "body", 0), ("b2", "b1", "body", 1), ("b3", "b1", "handlers", 1), ("b4", "b3", "body", 2)}
    assert [(r.receiver, r.method) for r in t["call_fact"].collect()] == [("this", "bar")] and [r.annotation for r in t["parameter"].collect()] == ["List<String>"]
    node, relation = model.detail(t, local(resolution.resolve_imports(t, "p")))
    assert relation.where("type = 'HasValue'").count() == 1
    assert {(r.tag, r.value) for r in model.attributes(t).where("tag like '%flow'").collect()} == {("exception_flow", "rethrow")}
    notes, tags = model.annotations(t)
    assert [(r.parent_id, r.name) for r in notes.collect()] == [("class:a.A", "Service")] and tags.count() == 3
    assert documents.project_findings(spark, {"source": str(tmp_path / "no")}) == [("SETUP-01", "error", "project is required"), ("SETUP-03", "error", f"source: {tmp_path}/no does not exist")]
    assert documents.project_findings(spark, {"source": str(tmp_path), "project": "p"}) == []


def test_recovered_creates(spark):
    code = "class Odd(Exception):\n    pass\n\ndef go():\n    x = Odd()\n    raise Odd('a')\n"
    t = python_source.tables(local(python_source.parsed(spark.createDataFrame([("m.py", bytearray(code.encode()))], "path string, content binary"), "p")))
    none = spark.createDataFrame([], "owner_id string, type string, target_id string")
    found = model.recovered_creates(t, none)
    assert found.count() == 2 and {r.target_id for r in found.collect()} == {"class:p.m.Odd"} and model.recovered_creates(t, local(found)).count() == 0


def test_documents_against_a_schema(spark, tmp_path):
    schema = {"type": "object", "required": ["version", "parts"], "properties": {"version": {"type": ["string", "null"]}, "parts": {"type": "array", "items": {"$ref": "#/$defs/part"}}},
              "$defs": {"part": {"type": "object", "required": ["role"], "properties": {"role": {"enum": ["Monitor"]}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "inner": {"$ref": "#/$defs/part"}}}}}
    (tmp_path / "a.json").write_text('{"version": null, "parts": [{"role": "Monitor", "confidence": 1}]}')
    (tmp_path / "b.json").write_text('{"version": 3, "parts": [{"role": "Wizard", "inner": {"confidence": 2}}, 7, {"role": "Monitor", "confidence": true}]}')
    (tmp_path / "c.json").write_text("{")
    got = {(r.file.rpartition("/")[2], r.place) for r in documents.document_violations(spark, str(tmp_path), schema).collect()}
    assert got == {("b.json", "$.version"), ("b.json", "$.parts[0].role"), ("b.json", "$.parts[0].inner.role"), ("b.json", "$.parts[0].inner.confidence"), ("b.json", "$.parts[1]"), ("b.json", "$.parts[2].confidence"), ("c.json", "$")}


def test_first_seen_edges_on_a_stream(spark, tmp_path):
    """State is bounded by the watermark, and batches that run twice add nothing."""
    rows = [("a", "b", "calls", 0), ("a", "b", "calls", 10), ("a", "b", "returns", 20), ("c", "d", "calls", 30)]
    frame = spark.createDataFrame(rows, "source string, target string, type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = trace.first_seen(stream, late="1 hour").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.source, r.target, r.type) for r in spark.table("seen").collect()} == {r[:3] for r in rows}
    put = trace.merge_batches(str(tmp_path / "edges"))
    q = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    put(frame, 0)
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 3
