"""Queries of the rule engines: gates, roles, loops, relationships, findings and reviews, over components composed from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.kdm import model
from factgraph.operators import matching, scoring, selection
from factgraph.operators.lineage import cut
from factgraph.plans.registry import Tables, query
from factgraph.recovery import roles, structure
from factgraph.review import findings
from factgraph.rules import tables as R

_ROLES = ["Monitor", "Analyzer", "Planner", "Executor", "Knowledge", "ReferenceInput", "Sensor", "Effector", "MeasuredOutput", "LoopManager"]
_COMP = f"""comp AS (SELECT 'component:' || p_partkey AS id, p_name AS name, ({_ROLES})[1 + p_size % 10] AS role, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS loop_hint,
  (0.5 + 0.25 * (p_size % 3))::DOUBLE AS confidence, p_partkey AS ord, p_partkey // 3 AS grp, p_size, p_partkey AS k FROM part),
lr AS (SELECT * FROM comp WHERE role IN {tuple(R.LOOP_ROLES)}),
mem AS (SELECT loop_hint AS loop, id, role, confidence, ord FROM lr WHERE loop_hint IS NOT NULL
  UNION ALL SELECT h.loop, id, role, confidence, ord FROM lr, (SELECT DISTINCT loop_hint AS loop FROM lr WHERE loop_hint IS NOT NULL) h WHERE loop_hint IS NULL)"""
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_LOOP = f"""{_COMP}, per AS (SELECT loop, count(*) AS n_members, list_sort(list(DISTINCT role)) AS roles, coalesce(round(avg(confidence), 2), 0.0) AS confidence,
  count(DISTINCT role) FILTER (role IN {tuple(R.CORE_ROLES)}) AS core, bool_or(role = 'Knowledge') AS known FROM mem GROUP BY loop),
loops AS (SELECT 'control_loop:' || {_SLUG.format("loop")} AS loop_id, loop AS name, n_members, roles, list_filter({sorted(R.CORE_ROLES)}, lambda r: NOT list_contains(roles, r)) AS missing,
  CASE WHEN core = 4 THEN 'complete' WHEN core >= 2 THEN 'partial' ELSE 'weak' END AS completeness, confidence, known FROM per WHERE core + known::INT >= 2)"""


def _components(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    text = key.cast("string")
    one = F.concat(F.lit("t"), F.floor(key / 3).cast("string"))
    state = F.when(size % 3 == 2, "auto_accepted").when(size % 3 == 1, "needs_review").otherwise("weak_suggestion")
    return t.part.select(
        F.concat(F.lit("component:"), text).alias("id"), F.col("p_name").alias("name"), F.get(F.array(*map(F.lit, _ROLES)), size % 10).alias("role"), F.when(key % 4 != 0, F.col("p_brand")).alias("loop_hint"),
        (0.5 + 0.25 * (size % 3)).alias("confidence"), key.alias("ord"), F.when(size % 2 == 0, F.array(one)).otherwise(F.array(one, F.concat(F.lit("u"), size.cast("string")))).alias("tokens"), state.alias("status"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("code:"), F.floor(key / 2).cast("string")))).alias("implemented_by"),
        F.when(key % 11 != 0, key % 7 != 0).alias("materialize"), F.when(key % 3 == 0, "accepted").alias("review_status"))


def _loops(t: Tables) -> tuple[DataFrame, DataFrame]:
    members = structure.loop_members(_components(t))
    return members, structure.control_loops(members)


@query("""
WITH p AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS tok FROM part), q AS (SELECT DISTINCT p_type || ' ' || p_name AS q_name, list_distinct(string_split(lower(p_type) || ' ' || p_name, ' ')) AS tok FROM part WHERE p_size < 5)
SELECT q_name AS source, p_name AS target, CASE WHEN len(list_filter(p.tok, lambda x: NOT list_contains(q.tok, x))) = 0 THEN 0.85 WHEN len(list_filter(q.tok, lambda x: NOT list_contains(p.tok, x))) = 0 THEN 0.80 ELSE 0.70 END::DOUBLE AS confidence
FROM p, q WHERE len(list_intersect(p.tok, q.tok)) > 0 AND q_name <> p_name""")
def token_evidence(t: Tables) -> DataFrame:
    right = t.part.select(F.col("p_name").alias("id"), F.split("p_name", " ").alias("tokens")).distinct()
    left = t.part.where("p_size < 5").select(F.concat_ws(" ", "p_type", "p_name").alias("id"), F.split(F.concat_ws(" ", F.lower("p_type"), "p_name"), " ").alias("tokens")).distinct()
    return scoring.token_pairs(left, right, "id", "tokens")


@query("SELECT c_mktsegment AS role, coalesce(round(avg(CASE WHEN c_nationkey > 12 THEN c_custkey % 2 END), 2), 0.0) AS mean_confidence, count(*) AS n FROM customer GROUP BY 1")
def mean_confidence(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("c", F.when(F.col("c_nationkey") > 12, (F.col("c_custkey") % 2).cast("double")))
    return rows.groupBy(F.col("c_mktsegment").alias("role")).agg(scoring.mean_confidence("c").alias("mean_confidence"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' END AS lang FROM labels)
SELECT d.doc_id, coalesce(o.lang, d.lang) AS lang, CASE WHEN o.doc_id IS NOT NULL THEN 'reviewed' ELSE 'unchanged' END AS review_status FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
UNION ALL SELECT -1, 'accepted', 'added'""")
def review_overrides(t: Tables) -> DataFrame:
    state = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted")
    new = t.labels.select("doc_id", state.alias("lang"))
    extra = t.labels.select(F.lit(-1).cast("long").alias("doc_id"), F.lit("accepted").alias("lang")).limit(1)
    return matching.apply_overrides(t.documents.select("doc_id", "lang"), new.unionByName(extra), "doc_id", ["lang"])


@query(f"WITH {_COMP} SELECT loop, count(*) AS n_members, min(ord) AS first_member, max(ord) AS last_member FROM mem GROUP BY loop")
def loop_groups(t: Tables) -> DataFrame:
    return _loops(t)[0].groupBy("loop").agg(F.count("*").alias("n_members"), F.min("ord").alias("first_member"), F.max("ord").alias("last_member"))


@query(f"WITH {_LOOP} SELECT loop_id, name, n_members, array_to_string(roles, ',') AS roles, array_to_string(missing, ',') AS missing, completeness, confidence, CASE WHEN confidence >= 0.85 THEN 'auto_accepted' ELSE 'needs_review' END AS status FROM loops")
def loop_completeness(t: Tables) -> DataFrame:
    return _loops(t)[1].select("loop_id", "name", "n_members", F.array_join("roles", ",").alias("roles"), F.array_join("missing_roles", ",").alias("missing"), "completeness", "confidence", "status")


@query(f"WITH {_COMP} SELECT loop, role, count(*) AS n FROM mem GROUP BY ALL")
def loop_role_counts(t: Tables) -> DataFrame:
    return structure.loop_role_counts(_loops(t)[0])


@query(f"""
WITH {_COMP}, o AS (SELECT *, list_position({list(R.ROLE_ORDER)}, role) AS rank FROM mem WHERE role IN {tuple(R.CORE_ROLES)}),
f AS (SELECT id AS source, role, lead(id) OVER w AS target, lead(role) OVER w AS next FROM o WINDOW w AS (PARTITION BY loop ORDER BY rank, ord, id))
SELECT DISTINCT source, target, 'mapek_flow' AS type, 0.75::DOUBLE AS confidence FROM f WHERE target IS NOT NULL AND role <> next""")
def role_order_flow(t: Tables) -> DataFrame:
    return structure.flow_edges(_loops(t)[0]).select("source", "target", "type", "confidence")


@query(f"""
WITH {_COMP}, m AS (SELECT loop, id, role FROM mem UNION ALL SELECT '{structure.MAIN_LOOP}', id, role FROM lr WHERE NOT EXISTS (SELECT 1 FROM lr h WHERE h.loop_hint IS NOT NULL))
SELECT DISTINCT a.id AS source, b.id AS target, 0.8::DOUBLE AS confidence FROM m a JOIN m b ON a.loop = b.loop WHERE a.role <> 'Knowledge' AND b.role = 'Knowledge'""")
def knowledge_edges(t: Tables) -> DataFrame:
    """Over all components: those without a hint are members of every loop, of the main one if there is no hint."""
    return structure.knowledge_edges(_loops(t)[0]).select("source", "target", "confidence")


_PAIRS = ", ".join(map(str, R.BOUNDARY_PAIRS))


@query(f"""
WITH {_COMP}, p(a, b, type) AS (VALUES {_PAIRS})
SELECT s.id AS source, t.id AS target, p.type, CASE WHEN t.p_size % 2 = 0 OR s.p_size = t.p_size THEN 0.85 WHEN s.p_size % 2 = 0 THEN 0.80 ELSE 0.70 END::DOUBLE AS confidence FROM p JOIN comp s ON s.role = p.a JOIN comp t ON t.role = p.b AND t.grp = s.grp""")
def boundary_edges(t: Tables) -> DataFrame:
    return structure.boundary_edges(_components(t)).select("source", "target", "type", "confidence")


@query(f"""
WITH {_COMP} SELECT 'subsystem:' || side || '_subsystem' AS subsystem_id, count(DISTINCT id) AS n_components, round(avg(confidence), 2) AS confidence
FROM (SELECT *, CASE WHEN role IN {tuple(R.MANAGING_ROLES)} THEN 'managing' WHEN role IN {tuple(R.MANAGED_ROLES)} THEN 'managed' END AS side FROM comp) WHERE side IS NOT NULL GROUP BY side""")
def subsystems(t: Tables) -> DataFrame:
    return structure.subsystems(_components(t)).select("subsystem_id", "n_components", "confidence")


@query(f"""
WITH {_COMP} SELECT 'code:' || (k // 2) AS code, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, array_to_string(list_sort(list(DISTINCT id)), ',') AS affected FROM comp WHERE k % 5 <> 0 GROUP BY k // 2 HAVING count(DISTINCT role) > 1""")
def multi_role_implementations(t: Tables) -> DataFrame:
    return structure.multi_role_implementations(_components(t)).select("code", F.array_join("roles", ",").alias("roles"), F.array_join("affected", ",").alias("affected"))


@query(f"""
WITH {_COMP} SELECT id, CASE WHEN k % 5 <> 0 THEN 'code:' || (k // 2) END AS reference, CASE WHEN k % 5 <> 0 AND (k // 2) IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'code:' || (k // 2) END AS code_id FROM comp""")
def implementation_refs(t: Tables) -> DataFrame:
    code = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("code:"), F.col("c_custkey").cast("string")).alias("id"))
    return structure.implementation_refs(_components(t), code)


@query(f"""
WITH {_LOOP}, have AS (SELECT bool_or(role = 'ReferenceInput') AS r, bool_or(role = 'MeasuredOutput') AS m, bool_or(role = 'Sensor') AS s FROM comp)
SELECT 'LOOP-W01' AS rule_id, loop_id AS element FROM loops WHERE len(missing) > 0 UNION ALL SELECT 'LOOP-OK01', loop_id FROM loops WHERE len(missing) = 0 UNION ALL SELECT 'LOOP-W02', loop_id FROM loops WHERE NOT known
UNION ALL SELECT 'CTRL-W01', 'model' FROM have WHERE NOT r UNION ALL SELECT 'CTRL-W02', 'model' FROM have WHERE NOT m UNION ALL SELECT 'CTRL-W03', 'model' FROM have WHERE NOT s""")
def construction_warnings(t: Tables) -> DataFrame:
    return structure.construction_warnings(cut(_loops(t)[1]), _components(t)).select("rule_id", "element")


@query(f"""
WITH {_LOOP} SELECT (SELECT count(*) FROM comp) AS n_components, (SELECT count(*) FROM comp WHERE confidence = 1) AS auto_accepted, (SELECT count(*) FROM comp WHERE confidence = 0.75) AS needs_review, (SELECT count(*) FROM comp WHERE confidence = 0.5) AS weak_suggestion,
  (SELECT round(avg(confidence), 2) FROM comp) AS mean_confidence, (SELECT count(*) FROM loops) AS n_loops, (SELECT count(*) FROM loops WHERE completeness = 'complete') AS n_complete, (SELECT count(*) FROM part) AS n_relationships""")
def recovery_statistics(t: Tables) -> DataFrame:
    return structure.statistics(_components(t), _loops(t)[1], t.part)


_HOLDERS = ["Managing Subsystem", "CL Manager", "Control Loop", "Managed Subsystem"]
_HELD = ["CL Manager", "Control Loop", "Monitor", "Sensor", "Knowledge", "Effector"]


@query(f"""
WITH c AS (SELECT ({_HOLDERS})[1 + p_size % 4] AS s, ({_HELD})[1 + p_partkey % 6] AS t, p_partkey % 5 = 0 AS managed, 'x' || p_partkey AS target FROM part),
j AS (SELECT *, CASE s WHEN 'Managing Subsystem' THEN t = 'CL Manager' OR (t = 'Control Loop' AND NOT managed) WHEN 'CL Manager' THEN t = 'Control Loop' WHEN 'Control Loop' THEN t IN ('Monitor', 'Knowledge') ELSE t IN ('Sensor', 'Effector') END AS ok FROM c)
SELECT target AS element, CASE WHEN ok THEN 'CONTAIN-OK' ELSE 'CONTAIN-FORBIDDEN' END AS rule_id, s || CASE WHEN ok THEN ' contains ' ELSE ' cannot directly contain ' END || t AS message FROM j""")
def containment_rules(t: Tables) -> DataFrame:
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    key = F.col("p_partkey")
    rows = t.part.select(
        F.concat(F.lit("y"), key.cast("string")).alias("source"), pick(_HOLDERS, F.col("p_size") % 4).alias("source_role"), F.concat(F.lit("x"), key.cast("string")).alias("target"), pick(_HELD, key % 6).alias("target_role"), (key % 5 == 0).alias("has_loop_manager"))
    return structure.containment(rows)[1].select("element", "rule_id", "message")


_DYNAMIC = ", ".join(map(str, R.DYNAMIC_PAIRS))


@query(f"""
WITH {_COMP}, p(a, b, type) AS (VALUES {_DYNAMIC}), e AS (SELECT DISTINCT 'component:' || l_partkey AS source, 'component:' || (l_orderkey % 150 + 1) AS target, l_returnflag AS scenario FROM lineitem)
SELECT e.source, e.target, p.type, e.scenario FROM e JOIN comp s ON s.id = e.source JOIN comp t ON t.id = e.target JOIN p ON p.a = s.role AND p.b = t.role""")
def dynamic_relations(t: Tables) -> DataFrame:
    named = lambda c: F.concat(F.lit("component:"), c.cast("string"))
    pairs = t.lineitem.select(named(F.col("l_partkey")).alias("source"), named(F.col("l_orderkey") % 150 + 1).alias("target"), F.col("l_returnflag").alias("scenario"))
    return structure.dynamic_relations(_components(t), pairs)


@query(f"""
WITH {_LOOP}, d AS (SELECT 'code:' || (k // 2) AS code FROM comp WHERE k % 5 <> 0 GROUP BY k // 2 HAVING count(DISTINCT role) > 1)
SELECT suggestion_type, n, confidence FROM (SELECT 'role_disambiguation' AS suggestion_type, (SELECT count(*) FROM d) AS n, 0.75::DOUBLE AS confidence
  UNION ALL SELECT 'partial_control_loop', count(*), 0.70 FROM loops WHERE completeness = 'partial' UNION ALL SELECT 'missing_abstraction', count(*), 0.70 FROM loops WHERE NOT known) WHERE n > 0""")
def review_suggestions(t: Tables) -> DataFrame:
    none = t.lineitem.select(F.lit("x").alias("source"), F.lit("y").alias("target"), F.lit("s").alias("scenario")).limit(1)
    said = structure.suggestions(_components(t), cut(_loops(t)[1]), none)
    return said.groupBy("suggestion_type").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))


#: Words of a corpus, and what of the gate's vocabularies they hold: autonomic, sensor, effector, knowledge, role.
_WORDS = [
    ("adaptive", 1, 0, 1, 0, None), ("my-Monitor", 0, 0, 0, 0, "Monitor"), ("analyzer", 0, 0, 0, 0, "Analyzer"), ("planner", 0, 0, 0, 0, "Planner"), ("probe", 0, 1, 0, 0, None), ("actuator", 0, 0, 1, 0, None),
    ("knowledge", 0, 0, 0, 1, "Knowledge"), ("plain", 0, 0, 0, 0, None), ("history", 0, 0, 0, 1, None), ("sensor", 0, 1, 0, 0, "Sensor"), ("other", 0, 0, 0, 0, None),
]
_VALUES = ", ".join(f"({k}, {a}, {s}, {e}, {n}, {'NULL' if r is None else repr(r)})" for k, (_, a, s, e, n, r) in enumerate(_WORDS))


@query(f"""
WITH w(i, a, s, e, n, r) AS (VALUES {_VALUES}), f AS (SELECT 'p' || (p_partkey // 4) AS project, max(a) AS a, max(s) AS s, max(e) AS e, max(n) AS n, count(DISTINCT r) AS roles FROM part JOIN w ON p_size % {len(_WORDS)} = i GROUP BY 1),
g AS (SELECT project, round((0.20 * a + CASE WHEN roles >= 3 THEN 0.25 ELSE 0 END + 0.15 * s + 0.15 * e + 0.15 * n)::DOUBLE, 2) AS score FROM f)
SELECT project, score, CASE WHEN score >= 0.70 THEN 'mapek_recovery_enabled' WHEN score >= 0.40 THEN 'needs_review' ELSE 'not_applicable' END AS decision FROM g""")
def gate_score(t: Tables) -> DataFrame:
    word = F.get(F.array(*(F.lit(w[0]) for w in _WORDS)), F.col("p_size") % len(_WORDS))
    corpus = t.part.select(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("project"), word.alias("text"))
    return roles.gate(corpus).select("project", "score", "decision")


_CLASSES = ["LoadMonitor", "PathPlanner", "Thing", "GasEffector", "GoalKeeper", "RunLoopManager"]
_METHODS = [["collect", "observe"], ["decide"], ["restart", "apply_all"], ["zzz"], ["update", "read"], ["coordinate"]]
_CALLED = ["analyzer.run", "plain", "effector.on", "monitor.x"]


def _terms(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]::VARCHAR[]"


_RULES = ", ".join(f"({k}, '{role}', {_terms(n)}, {_terms(m)}, {_terms(R.HINT_TERMS.get(role, []))})" for k, (role, n, m, _) in enumerate(R.ROLE_RULES))


@query(f"""
WITH rule(o, role, names, methods, hints) AS (VALUES {_RULES}),
c AS (SELECT p_partkey AS k, lower(({_CLASSES})[1 + p_size % 6]) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'a/monitor.py' ELSE 'a/x.py' END AS path, ({_METHODS})[1 + p_partkey % 6] AS ms, lower(({_CALLED})[1 + p_partkey % 4]) AS called FROM part),
s AS (SELECT k, o, role, round(least(CASE WHEN len(list_filter(names, lambda x: contains(name, x))) > 0 THEN 0.45 ELSE 0 END + CASE WHEN len(list_filter(names, lambda x: contains(path, x))) > 0 THEN 0.20 ELSE 0 END
  + least(0.25, 0.10 * len(list_filter(ms, lambda y: len(list_filter(methods, lambda x: contains(y, x))) > 0))) + CASE WHEN len(list_filter(hints, lambda x: contains(called, x))) > 0 THEN 0.10 ELSE 0 END, 1.0)::DOUBLE, 2) AS confidence FROM c, rule)
SELECT k AS class_id, role, confidence, CASE WHEN confidence >= 0.85 THEN 'auto_accepted' WHEN confidence >= 0.60 THEN 'needs_review' ELSE 'weak_suggestion' END AS status FROM s WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY confidence DESC, o) = 1""")
def role_score(t: Tables) -> DataFrame:
    key = F.col("p_partkey").alias("class_id")
    pick = lambda values, at: F.get(F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values)), at.cast("int"))
    classes = t.part.select(key, pick(_CLASSES, F.col("p_size") % 6).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "a/monitor.py").otherwise("a/x.py").alias("path"))
    methods = t.part.select(key, F.explode(pick(_METHODS, F.col("p_partkey") % 6)).alias("name"))
    calls = t.part.select(key, pick(_CALLED, F.col("p_partkey") % 4).alias("name"))
    return roles.class_roles(classes, methods, calls).select("class_id", "role", "confidence", "status")


@query("""
SELECT p_partkey AS callable_id, CASE p_size % 4 WHEN 0 THEN 'Monitor' WHEN 1 THEN 'Executor' WHEN 2 THEN 'Planner' END AS role, CASE p_size % 4 WHEN 0 THEN 'loop' WHEN 1 THEN 'app' END AS loop_hint, 0.95::DOUBLE AS confidence FROM part WHERE p_size % 4 < 3""")
def decorator_roles(t: Tables) -> DataFrame:
    given = F.array(*(F.array(*map(F.lit, x)) for x in (["cached", "loop.monitor", "loop.plan"], ["app.loop.execute()"], ["plan"], ["monitors", "x.planner"])))
    rows = t.part.select(F.col("p_partkey").alias("callable_id"), F.col("p_name").alias("name"), F.get(given, F.col("p_size") % 4).alias("decorators"))
    return roles.decorator_roles(rows).select("callable_id", "role", "loop_hint", "confidence")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'my.Loop.Plan' WHEN 1 THEN 'print' WHEN 2 THEN 'loop.monitor_all' ELSE 'loop.execute' END AS name FROM lineitem)
SELECT l_orderkey AS callable_id, CASE l_linenumber % 4 WHEN 0 THEN 'Planner' WHEN 2 THEN 'Monitor' ELSE 'Executor' END AS role, split_part(name, '.', 1) AS loop_hint, 0.85::DOUBLE AS confidence
FROM c WHERE l_linenumber % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1""")
def registration_roles(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.when(n % 4 == 0, "my.Loop.Plan").when(n % 4 == 1, "print").when(n % 4 == 2, "loop.monitor_all").otherwise("loop.execute")
    rows = t.lineitem.select(F.col("l_orderkey").alias("callable_id"), n.alias("ord"), name.alias("name"))
    return roles.registration_roles(rows).select("callable_id", "role", "loop_hint", "confidence")


@query(f"WITH {_COMP} SELECT id FROM comp WHERE confidence >= 0.60")
def promoted_components(t: Tables) -> DataFrame:
    return roles.promoted(_components(t)).select("id")


_NAMES = [("target_speed", "variable"), ("read_level", "method"), ("on_brake", "function"), ("get", "method"), ("current", "attribute"), ("_sense", "variable"), ("camera", "class"), ("goal", "method")]
_IO = {0: ("ReferenceInput", 0.90), 1: ("Sensor", 0.85), 2: ("Effector", 0.85), 4: ("MeasuredOutput", 0.80), 6: ("Sensor", 0.85)}


@query(f"""
WITH e AS (SELECT 'e' || lpad(p_partkey::VARCHAR, 9, '0') AS id, p_partkey % 8 AS i, p_size % 10 = 0 AS away FROM part),
r AS (SELECT id, CASE i {" ".join(f"WHEN {k} THEN '{r}'" for k, (r, _) in _IO.items())} END AS role, CASE i {" ".join(f"WHEN {k} THEN {c}" for k, (_, c) in _IO.items())} END::DOUBLE AS confidence FROM e WHERE NOT away)
SELECT id, role, confidence FROM r WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY role ORDER BY confidence DESC, id) <= CASE role WHEN 'ReferenceInput' THEN 8 ELSE 10 END""")
def control_io(t: Tables) -> DataFrame:
    at = F.col("p_partkey") % 8
    pick = lambda k: F.get(F.array(*(F.lit(x[k]) for x in _NAMES)), at.cast("int"))
    path = F.when(F.col("p_size") % 10 == 0, "app.utils.x").otherwise("app.car")
    rows = t.part.select(F.concat(F.lit("e"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), pick(0).alias("name"), pick(1).alias("kind"), path.alias("qualified_name"))
    return roles.control_io(rows).select("id", "role", "confidence")


_LIVE = "coalesce(CASE WHEN k % 11 <> 0 THEN k % 7 <> 0 END, true)"


@query(f"""
WITH {_COMP}, c AS (SELECT *, {_LIVE} AS live, k % 3 = 0 AS accepted FROM comp UNION ALL SELECT *, {_LIVE}, false FROM comp WHERE k % 50 = 0), f AS (SELECT * FROM c WHERE live)
SELECT rule_id, count(*) AS n FROM (
  SELECT 'ARV-F-02' AS rule_id FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'ARV-W-02' FROM f WHERE k % 5 = 0 UNION ALL SELECT 'ARV-W-08' FROM f WHERE accepted AND confidence < 0.6 UNION ALL SELECT 'ARV-OK-01' FROM f WHERE accepted
  UNION ALL SELECT 'ARV-OK-02' FROM c WHERE NOT live UNION ALL SELECT 'ARV-W-04' FROM f WHERE k % 5 <> 0 GROUP BY k // 2 HAVING count(DISTINCT role) > 1
  UNION ALL SELECT 'ARV-W-03' FROM f WHERE k % 5 <> 0 AND (k // 2) NOT IN (SELECT c_custkey FROM customer)) GROUP BY 1""")
def review_component_findings(t: Tables) -> DataFrame:
    rows = _components(t)
    rows = rows.unionByName(rows.where("ord % 50 = 0").withColumn("review_status", F.lit(None).cast("string")))
    code = t.customer.select(F.concat(F.lit("code:"), F.col("c_custkey").cast("string")).alias("id"))
    return findings.component_findings(rows, code).groupBy("rule_id").agg(F.count("*").alias("n"))


_KINDS = ["mapek_flow", "uses_knowledge", "depends_on", "wizardry"]
_REVIEWED = f"""{_COMP}, e AS (SELECT o_orderkey AS k, 'component:' || (o_custkey + o_orderkey % 3) AS source, 'component:' || (o_orderkey % 260) AS target, ({_KINDS})[1 + o_orderkey % 4] AS type, o_orderkey % 13 <> 0 AS live, o_orderkey % 5 = 0 AS tech, o_orderkey % 6 = 0 AS accepted FROM orders),
n AS (SELECT id, role, {_LIVE} AS live FROM comp),
j AS (SELECT e.*, s.role AS a, t.role AS b, CASE WHEN s.id IS NULL THEN 'ARV-F-03' WHEN t.id IS NULL THEN 'ARV-F-04' WHEN NOT s.live OR NOT t.live THEN 'ARV-F-05' WHEN type = 'wizardry' THEN 'ARV-F-08' END AS stop FROM e LEFT JOIN n s ON s.id = e.source LEFT JOIN n t ON t.id = e.target WHERE e.live)"""


def _reviewed_edges(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    named = lambda c: F.concat(F.lit("component:"), c.cast("string"))
    return t.orders.select(
        k.cast("string").alias("id"), named(F.col("o_custkey") + k % 3).alias("source"), named(k % 260).alias("target"), F.get(F.array(*map(F.lit, _KINDS)), (k % 4).cast("int")).alias("type"), (k % 13 != 0).alias("materialize"),
        F.when(k % 5 == 0, "technical").alias("source_level"), F.lit("architectural").alias("relationship_level"), F.when(k % 6 == 0, "accepted").alias("review_status"))


@query(f"""
WITH {_REVIEWED}, fine AS (SELECT *, a || '>' || b AS pair FROM j WHERE stop IS NULL)
SELECT rule_id, count(*) AS n FROM (SELECT stop AS rule_id FROM j WHERE stop IS NOT NULL UNION ALL SELECT 'ARV-F-07' FROM fine WHERE type = 'uses_knowledge' AND b <> 'Knowledge'
  UNION ALL SELECT 'ARV-F-10' FROM e WHERE live GROUP BY source, type, target HAVING count(*) > 1 UNION ALL SELECT 'ARV-W-06' FROM fine WHERE type = 'mapek_flow' AND pair = 'Monitor>Executor'
  UNION ALL SELECT 'ARV-W-05' FROM fine WHERE type = 'mapek_flow' AND pair NOT IN ('Monitor>Analyzer', 'Monitor>Planner', 'Analyzer>Planner', 'Planner>Executor', 'Monitor>Executor')
  UNION ALL SELECT 'ARV-W-07' FROM fine WHERE tech UNION ALL SELECT 'ARV-OK-04' FROM fine WHERE accepted) GROUP BY 1""")
def review_edge_findings(t: Tables) -> DataFrame:
    return findings.edge_findings(_reviewed_edges(t), _components(t)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"""
WITH {_COMP}, n AS (SELECT id, role, {_LIVE} AS live FROM comp), l AS (SELECT DISTINCT p_brand AS loop_id, right(p_brand, 1)::INT % 2 AS lv FROM part),
m AS (SELECT p_brand AS loop_id, 'component:' || p_partkey AS id FROM part WHERE p_size < 20 UNION SELECT p_brand, 'component:' || (p_partkey + 1) FROM part WHERE p_size < 10),
r AS (SELECT m.loop_id, n.* FROM m JOIN n ON n.id = m.id), k AS (SELECT * FROM r WHERE live)
SELECT rule_id, count(*) AS n FROM (SELECT 'ARV-F-06' AS rule_id FROM r WHERE NOT live UNION ALL SELECT 'ARV-F-09' FROM l WHERE loop_id NOT IN (SELECT loop_id FROM k)
  UNION ALL SELECT 'ARV-W-01' FROM l LEFT JOIN (SELECT loop_id, count(DISTINCT role) FILTER (role IN {tuple(R.CORE_ROLES)}) AS c FROM k GROUP BY 1) x ON x.loop_id = l.loop_id WHERE coalesce(c, 0) < 4
  UNION ALL SELECT 'ARV-W-09' FROM k WHERE role IN {tuple(R.SINGLE_ROLES)} GROUP BY loop_id, role HAVING count(*) > 1 UNION ALL SELECT 'ARV-W-10' FROM k WHERE role = 'Knowledge' GROUP BY id HAVING count(DISTINCT loop_id) > 1
  UNION ALL SELECT 'ARV-W-11' FROM l WHERE lv = 0 AND (SELECT count(*) FROM l) > 1) GROUP BY 1""")
def review_loop_findings(t: Tables) -> DataFrame:
    odd = F.substring("p_brand", -1, 1).cast("int") % 2
    loops = t.part.select(F.col("p_brand").alias("id"), F.when(odd == 1, 1).alias("level"), F.lit(True).alias("materialize")).distinct()
    member = lambda key: F.concat(F.lit("component:"), key.cast("string")).alias("component_id")
    members = t.part.where("p_size < 20").select(F.col("p_brand").alias("loop_id"), member(F.col("p_partkey"))).unionByName(t.part.where("p_size < 10").select(F.col("p_brand").alias("loop_id"), member(F.col("p_partkey") + 1)))
    return findings.loop_findings(loops, members, _components(t)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"""
WITH {_COMP}, f AS (SELECT *, {_LIVE} AS live FROM comp)
SELECT p_brand AS element FROM part JOIN f ON f.k = p_partkey AND live GROUP BY p_brand HAVING bool_or(role IN {tuple(R.MANAGING_ROLES)}) AND bool_or(role IN {tuple(R.MANAGED_ROLES)})""")
def review_subsystem_findings(t: Tables) -> DataFrame:
    members = t.part.select(F.col("p_brand").alias("subsystem_id"), F.concat(F.lit("component:"), F.col("p_partkey").cast("string")).alias("component_id"))
    return findings.subsystem_findings(members, _components(t)).select("element")


@query(f"""
WITH {_REVIEWED} SELECT count(*) FILTER (stop IS NULL AND accepted) AS n_ok, count(*) FILTER (stop IS NOT NULL) > 0 AS any_stop FROM j""")
def review_summary(t: Tables) -> DataFrame:
    found = findings.edge_findings(_reviewed_edges(t), _components(t))
    return findings.summary(found).select("n_ok", (~F.col("valid")).alias("any_stop"))


@query("""
WITH d AS (SELECT doc_id AS k, max(CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' END) AS decision, max(CASE WHEN doc_id % 4 = 0 THEN 'new' END) AS type, bool_or(doc_id % 9 = 0) AS up FROM labels GROUP BY 1)
SELECT doc_id AS id, coalesce(d.type, lang) AS type, CASE WHEN up THEN 'architectural' ELSE source END AS relationship_level, CASE WHEN up THEN source END AS source_level,
  CASE WHEN up THEN true WHEN decision = 'accepted' THEN true WHEN decision = 'rejected' THEN false END AS materialize,
  CASE WHEN up THEN 'user_promoted' WHEN d.type IS NOT NULL THEN 'user_modified' WHEN decision = 'accepted' THEN 'user_accepted' WHEN decision = 'rejected' THEN 'user_rejected' END AS review_status
FROM documents LEFT JOIN d ON d.k = doc_id""")
def review_decisions(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    base = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("relationship_level"), none.alias("source_level"), F.lit(None).cast("boolean").alias("materialize"), none.alias("review_status"))
    said = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").alias("decision"), F.when(F.col("doc_id") % 4 == 0, "new").alias("type"), (F.col("doc_id") % 9 == 0).alias("promote_to_architectural"))
    return matching.apply_decisions(base, said, "id", ["type"], promote=True)


@query("""
WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 > 0 THEN 'k' || o_custkey END AS semantic_key, CASE WHEN o_orderkey % 3 = 0 THEN 'llm:x' ELSE 'dynamic' END AS source, (o_orderkey % 8) / 8.0::DOUBLE AS confidence, o_orderpriority AS ev FROM orders),
m AS (SELECT semantic_key, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT ev)), ',') AS evidence FROM s WHERE semantic_key IS NOT NULL GROUP BY 1),
f AS (SELECT id, semantic_key, source FROM s WHERE semantic_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY semantic_key ORDER BY source = 'llm:x', confidence DESC, id) = 1)
SELECT f.id, f.semantic_key, f.source, m.confidence, m.evidence FROM f JOIN m ON m.semantic_key = f.semantic_key UNION ALL SELECT id, NULL, source, confidence, ev FROM s WHERE semantic_key IS NULL""")
def deduplicated_suggestions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(
        k.alias("id"), F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit("k"), F.col("o_custkey").cast("string"))).alias("semantic_key"), F.when(k % 3 == 0, "llm:x").otherwise("dynamic").alias("source"), ((k % 8) / 8.0).cast("double").alias("confidence"), F.array("o_orderpriority").alias("evidence"))
    return selection.merge_suggestions(rows).withColumn("evidence", F.array_join("evidence", ","))


@query(f"""
WITH {_LOOP}, o AS (SELECT *, list_position({list(R.ROLE_ORDER)}, role) AS rank FROM mem WHERE role IN {tuple(R.CORE_ROLES)}),
f AS (SELECT id AS source, role, lead(id) OVER w AS target, lead(role) OVER w AS next FROM o WINDOW w AS (PARTITION BY loop ORDER BY rank, ord, id)),
e AS (SELECT DISTINCT source, target FROM f WHERE target IS NOT NULL AND role <> next), live AS (SELECT id FROM comp WHERE {_LIVE})
SELECT metaclass, n FROM (SELECT 'StructureModel' AS metaclass, 1 AS n UNION ALL SELECT 'SoftwareSystem', 1 UNION ALL SELECT 'ArchitectureView', 1 UNION ALL SELECT 'Subsystem', 2 UNION ALL SELECT 'Component', (SELECT count(*) FROM live) + (SELECT count(*) FROM loops)
  UNION ALL SELECT 'AggregatedRelationship', count(*) FROM e WHERE source IN (SELECT id FROM live) AND target IN (SELECT id FROM live))""")
def structure_model_counts(t: Tables) -> DataFrame:
    members, loops = _loops(t)
    loops = cut(loops)
    code = t.customer.select(F.concat(F.lit("code:"), F.col("c_custkey").cast("string")).alias("id"))
    node, _, _ = model.structure_model(_components(t), loops, members, structure.flow_edges(members), code)
    return node.groupBy("metaclass").agg(F.count("*").cast("int").alias("n"))


@query("""
WITH have AS (SELECT DISTINCT 'a' || o_custkey AS source, 'b' || (o_orderkey % 50) AS target FROM orders WHERE o_orderkey % 4 = 0)
SELECT DISTINCT 'a' || o_custkey AS source, 'b' || (o_orderkey % 50) AS target, 'observes' AS type FROM orders WHERE o_orderkey % 3 = 0 AND ('a' || o_custkey, 'b' || (o_orderkey % 50)) NOT IN (SELECT (source, target) FROM have)""")
def applied_suggestions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    ends = [F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("b"), (k % 50).cast("string")).alias("target")]
    edges = t.orders.where(k % 4 == 0).select(*ends, F.lit("observes").alias("type"))
    wanted = t.orders.select(F.when(k % 3 == 0, "add_relationship").otherwise("rename").alias("operation"), *ends, F.lit("observes").alias("relationship_type"))
    return structure.apply_suggestions(edges, wanted)[0].select("source", "target", "type")
