"""Queries of the edge, resolution, matching and graph operators, bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators import graphs, matching, selection
from factgraph.operators.cascade import Tier, candidates, first_candidate, resolve_cascade
from factgraph.plans.registry import Tables, query
from factgraph.recovery import runtime, structure
from factgraph.streaming import trace

_PAIRS = "SELECT user_id, event_id, ts, event_type AS target, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source FROM events"


def _runtime_pairs(t: Tables) -> DataFrame:
    return graphs.consecutive(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", skip_equal=False)


@query(f"SELECT source, target, count(*) AS n FROM ({_PAIRS}) WHERE source IS NOT NULL GROUP BY ALL ORDER BY n DESC, source, target LIMIT 20")
def runtime_edges_topk(t: Tables) -> DataFrame:
    return selection.top_k(_runtime_pairs(t), ["source", "target"], 20)


@query(f"SELECT source, target, count(*) AS n, count(DISTINCT user_id) AS n_threads FROM ({_PAIRS}) WHERE source IS NOT NULL AND source <> target AND source <> 'error' AND target <> 'error' GROUP BY ALL")
def runtime_edges_filtered(t: Tables) -> DataFrame:
    pairs = _runtime_pairs(t).where("source <> target and source <> 'error' and target <> 'error'")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_threads"))


@query("""
WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'call' WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'return' ELSE 'other' END AS kind FROM events),
d AS (SELECT *, sum(CASE kind WHEN 'call' THEN 1 WHEN 'return' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS depth FROM e),
c AS (SELECT user_id, event_id, event_type || '_' || (event_id % 7) AS name, depth FROM d WHERE kind = 'call'),
p AS (SELECT a.user_id, a.event_id, a.name AS target, max(b.event_id) AS caller FROM c a JOIN c b ON a.user_id = b.user_id AND b.depth = a.depth - 1 AND b.event_id < a.event_id GROUP BY ALL)
SELECT c.name AS source, p.target, count(*) AS n FROM p JOIN c ON c.user_id = p.user_id AND c.event_id = p.caller GROUP BY ALL""")
def call_stack_edges(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "call").when(F.col("event_type") == "purchase", "return").otherwise("other")
    name = F.concat_ws("_", "event_type", (F.col("event_id") % 7).cast("string"))
    trace = t.events.select("user_id", "event_id", kind.alias("type"), name.alias("qualified_name"))
    return graphs.call_pairs(trace, ["user_id"], "event_id").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT p_brand, p_type, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL)
SELECT CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS classification, count(*) AS n_symbols, sum(n)::BIGINT AS n_targets FROM i GROUP BY ALL""")
def symbol_index(t: Tables) -> DataFrame:
    index = candidates(t.part, ["p_brand", "p_type"], "p_partkey")
    return index.groupBy(F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("classification")).agg(F.count("*").alias("n_symbols"), F.sum("n").cast("long").alias("n_targets"))


@query("""
WITH s AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM supplier GROUP BY 1),
b AS (SELECT c_acctbal AS k, count(DISTINCT c_custkey) AS n, min(c_custkey) AS id FROM customer GROUP BY 1)
SELECT p_partkey,
  CASE WHEN p_size < 25 AND s.n = 1 THEN 'internal' WHEN p_size < 25 AND s.n > 1 THEN 'internal_ambiguous' WHEN p_size = 25 THEN 'external'
       WHEN b.n = 1 THEN 'constructor' WHEN b.n > 1 THEN 'constructor_ambiguous' ELSE 'unresolved' END AS classification,
  CASE WHEN p_size < 25 AND s.n = 1 THEN s.id::VARCHAR WHEN p_size < 25 AND s.n > 1 THEN NULL WHEN p_size = 25 THEN NULL WHEN b.n = 1 THEN b.id::VARCHAR END AS target_id,
  CASE WHEN p_size < 25 AND s.n > 1 THEN s.n WHEN p_size < 25 AND s.n = 1 THEN 0 WHEN p_size = 25 THEN 0 WHEN b.n > 1 THEN b.n ELSE 0 END AS n_candidates
FROM part LEFT JOIN s ON s.k = p_size LEFT JOIN b ON b.k = p_retailprice""")
def resolve_cascade_parts(t: Tables) -> DataFrame:
    tiers = [
        Tier("supplier", t.supplier, {"p_size": "s_nationkey"}, "s_suppkey", "internal", "internal_ambiguous", when=F.col("p_size") < 25),
        Tier("boundary", t.supplier, {"p_size": "s_suppkey"}, "s_suppkey", "external", "external", terminal=True, missing="external", when=F.col("p_size") == 25),
        Tier("customer", t.customer, {"p_retailprice": "c_acctbal"}, "c_custkey", "constructor", "constructor_ambiguous"),
    ]
    out = resolve_cascade(t.part, tiers)
    return out.select("p_partkey", "classification", F.when(F.col("classification") != "external", F.col("target_id")).alias("target_id"), F.when(F.col("classification") == "external", 0).otherwise(F.col("n_candidates")).cast("long").alias("n_candidates"))


@query("""
WITH c AS (SELECT o_orderkey, unnest([o_custkey + 100000, o_custkey, o_custkey + 1]) AS cand, unnest([0, 1, 2]) AS pos FROM orders),
h AS (SELECT o_orderkey, arg_min(c_name, pos) AS resolved FROM c JOIN customer ON c_custkey = cand GROUP BY 1)
SELECT o.o_orderkey, resolved FROM orders o LEFT JOIN h ON o.o_orderkey = h.o_orderkey""")
def import_candidates(t: Tables) -> DataFrame:
    facts = t.orders.select("o_orderkey", F.array(F.col("o_custkey") + 100000, F.col("o_custkey"), F.col("o_custkey") + 1).alias("cands"))
    return first_candidate(facts, ["o_orderkey"], "cands", t.customer, "c_custkey", "c_name").select("o_orderkey", "resolved")


_MATCH = """
WITH l AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
m AS (SELECT l.k AS owner, l.event_id, o_orderkey AS matched_id FROM l LEFT JOIN r ON l.k = r.k AND l.n = r.n)
"""


def _matched(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("user_id").alias("owner"), "event_id", "ts")
    flat = t.orders.select(F.col("o_custkey").alias("owner"), "o_orderkey", "o_orderdate")
    return matching.multiset_match(calls, flat, ["owner"], ["ts", "event_id"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query(_MATCH + "SELECT event_id, matched_id FROM m")
def multiset_match(t: Tables) -> DataFrame:
    return _matched(t).select("event_id", "matched_id")


@query(_MATCH + """SELECT owner, count(*) AS n_calls, count(matched_id) AS n_matched,
  CASE WHEN count(matched_id) = count(*) THEN 'matched' WHEN count(matched_id) = 0 THEN 'unmatched' ELSE 'partially_matched' END AS status FROM m GROUP BY owner""")
def match_status(t: Tables) -> DataFrame:
    return matching.match_status(_matched(t), "owner")


_TREE = """
WITH RECURSIVE edge AS (
  SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier)
"""


def _tree(t: Tables) -> DataFrame:
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(y).cast("string")).alias("child"))
    return edge(t.nation, "region:", "n_regionkey", "nation:", "n_nationkey").unionByName(edge(t.customer, "nation:", "c_nationkey", "customer:", "c_custkey")).unionByName(edge(t.supplier, "nation:", "s_nationkey", "supplier:", "s_suppkey"))


@query(_TREE + "SELECT 'rel:' || substr(sha1('contains|' || parent || '|' || child), 1, 12) AS edge_id, parent, child FROM edge")
def contains_edges(t: Tables) -> DataFrame:
    return _tree(t).select(names.stable_id("rel", F.lit("contains"), F.col("parent"), F.col("child")).alias("edge_id"), "parent", "child")


@query(_TREE + """, up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edge UNION ALL SELECT up.node, edge.parent, depth + 1 FROM up JOIN edge ON up.ancestor = edge.child)
SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY ALL""")
def containment_closure(t: Tables) -> DataFrame:
    return graphs.closure(_tree(t))


@query(_TREE + """, down AS (SELECT 'region:' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT edge.child, level + 1 FROM down JOIN edge ON down.node = edge.parent)
SELECT node, min(level) AS level FROM down GROUP BY ALL""")
def breadth_first_levels(t: Tables) -> DataFrame:
    return graphs.levels(_tree(t), t.region.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("root")), "root")


@query("""
SELECT c_nationkey AS source, s_nationkey AS target, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS relations, count(*) AS density
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def aggregated_relationship(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag")
    edges = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = edges.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = graphs.aggregate_edges(edges, "c_nationkey", "s_nationkey", "l_returnflag")
    return out.select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.array_join("relations", ",").alias("relations"), "density")


@query("""
SELECT DISTINCT unnest(list_transform(range(1, len(string_split(url, '/')) + 1), lambda n: array_to_string(string_split(url, '/')[1:n], '/'))) AS prefix,
  unnest(list_transform(range(1, len(string_split(url, '/')) + 1), lambda n: CASE WHEN n > 1 THEN array_to_string(string_split(url, '/')[1:n - 1], '/') END)) AS parent FROM pages""")
def prefix_expansion(t: Tables) -> DataFrame:
    return graphs.prefixes(t.pages.select("url"), "url", "/")


_EDGES = "SELECT 'u' || (user_id % 60) AS source, event_type AS target, strftime(ts, '%Y-%m') AS scenario, event_id, ts FROM events"


def _runtime_edges(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("source"), F.col("event_type").alias("target"), F.date_format("ts", "yyyy-MM").alias("scenario"), "event_id", "ts")


@query(f"""
WITH e AS ({_EDGES}), o AS (SELECT *, CASE WHEN substr(source, 2)::INT % 2 = 0 THEN 'k' || (substr(source, 2)::INT % 5) END AS a, CASE WHEN target <> 'error' THEN 't_' || target END AS b FROM e)
SELECT 'scenario' AS part, scenario AS name, count(*) AS n FROM o GROUP BY scenario
UNION ALL (SELECT 'source', source, count(*) AS n FROM o GROUP BY source ORDER BY n DESC, source LIMIT 20) UNION ALL (SELECT 'target', target, count(*) AS n FROM o GROUP BY target ORDER BY n DESC, target LIMIT 20)
UNION ALL (SELECT 'pair', a || '>' || b, count(*) AS n FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b ORDER BY n DESC, a, b LIMIT 25) UNION ALL SELECT 'unmapped', '', count(*) FROM o WHERE a IS NULL OR b IS NULL""")
def runtime_by_scenario(t: Tables) -> DataFrame:
    edges = _runtime_edges(t)
    k = F.col("user_id") % 60
    owner = t.events.where(k % 2 == 0).select(F.concat(F.lit("u"), k.cast("string")).alias("name"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("component")).distinct()
    owner = owner.unionByName(edges.where("target <> 'error'").select(F.col("target").alias("name"), F.concat(F.lit("t_"), "target").alias("component")).distinct())
    s = runtime.summary(edges, owner)
    part = lambda name, df, c: df.select(F.lit(name).alias("part"), c.alias("name"), "n")
    out = part("scenario", s["by_scenario"], F.col("scenario")).unionByName(part("source", s["sources"], F.col("source"))).unionByName(part("target", s["targets"], F.col("target")))
    return out.unionByName(part("pair", s["pairs"], F.concat_ws(">", "source_component", "target_component"))).unionByName(part("unmapped", s["unmapped"].withColumnRenamed("n_unmapped", "n"), F.lit("")))


def _events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 9 == 0, "line").when(F.col("event_id") % 3 == 0, "return").otherwise("call")
    return t.events.select(F.concat(F.lit("t"), (F.col("user_id") % 30).cast("string")).alias("trace_id"), F.col("event_id").alias("ord"), kind.alias("type"), F.concat_ws(".", "event_type", F.when(F.col("event_id") % 11 == 0, "<module>").otherwise((F.col("event_id") % 5).cast("string"))).alias("qualified_name"), "ts")


_TRACE = """SELECT 't' || (user_id % 30) AS trace_id, event_id AS ord, CASE WHEN event_id % 9 = 0 THEN 'line' WHEN event_id % 3 = 0 THEN 'return' ELSE 'call' END AS type,
  event_type || '.' || CASE WHEN event_id % 11 = 0 THEN '<module>' ELSE (event_id % 5)::VARCHAR END AS qualified_name, ts FROM events"""


@query(f"SELECT trace_id, ord, type, qualified_name FROM ({_TRACE}) WHERE type <> 'line' AND NOT ends_with(qualified_name, '.<module>') AND NOT contains(qualified_name, 'sea') AND (starts_with(qualified_name, 'v') OR starts_with(qualified_name, 'c') OR starts_with(qualified_name, 'p'))")
def relevance_filter(t: Tables) -> DataFrame:
    return trace.relevant(_events(t), ["v", "c", "p"], ["sea"]).select("trace_id", "ord", "type", "qualified_name")


@query(f"SELECT trace_id, ord, type FROM ({_TRACE}) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ord) <= 20")
def trace_cap(t: Tables) -> DataFrame:
    return trace.capped(_events(t), 20).select("trace_id", "ord", "type")


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, type, count(*) AS n FROM ({_TRACE}) GROUP BY ALL")
def windowed_trace_counts(t: Tables) -> DataFrame:
    return trace.windowed_counts(_events(t), "1 hour", "1 hour")


@query(f"SELECT DISTINCT source, target, 'calls' AS type FROM ({_EDGES})")
def first_seen_edges(t: Tables) -> DataFrame:
    return trace.first_seen(_runtime_edges(t))


@query(f"""
WITH e AS ({_EDGES}), d AS (SELECT DISTINCT source, target FROM e WHERE target <> 'error')
SELECT (SELECT count(*) FROM e) AS raw_events, (SELECT count(*) FROM e WHERE target <> 'error') AS kept_events, (SELECT count(*) FROM d) AS observed_edges,
  (SELECT count(*) FROM d WHERE NOT (target = 'view' AND source IN (SELECT 'u' || n_nationkey FROM nation))) AS added_edges, (SELECT count(*) FROM e WHERE target = 'error') AS filtered_events""")
def enrichment_summary(t: Tables) -> DataFrame:
    raw = _runtime_edges(t)
    kept = raw.where("target <> 'error'")
    known = t.nation.select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("view").alias("target"))
    return trace.enrichment_summary(raw, kept, kept, known)


@query(f"""
WITH e AS ({_EDGES}), r AS (SELECT source, target, scenario, row_number() OVER (PARTITION BY source, target ORDER BY scenario) AS k FROM e),
s AS (SELECT * FROM r WHERE k = 1 AND NOT (target = 'view' AND source IN (SELECT 'u' || n_nationkey FROM nation)))
SELECT source, target, 'calls' AS type, scenario FROM s UNION ALL SELECT 'u' || n_nationkey, 'view', 'calls', NULL FROM nation""")
def scenario_accumulation(t: Tables) -> DataFrame:
    edges = _runtime_edges(t).withColumn("type", F.lit("calls"))
    known = t.nation.select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("view").alias("target"), F.lit("calls").alias("type"))
    return trace.accumulated(known, [edges])


_QN = "SELECT 'shop.' || lower(p_type) || '.P' || p_partkey || '.run' AS qn, p_partkey AS k FROM part"
_ASKED = """SELECT CASE p_partkey % 6 WHEN 0 THEN 'shop.' || lower(p_type) || '.P' || p_partkey || '.run' WHEN 1 THEN 'shop/' || lower(p_type) || '/P' || p_partkey || '.run' WHEN 2 THEN lower(p_type) || '.P' || p_partkey || '.run'
  WHEN 3 THEN 'elsewhere.P' || p_partkey || '.run' WHEN 4 THEN 'run' ELSE 'P' || p_partkey END AS name, p_partkey AS k, p_partkey % 6 AS how FROM part"""


@query(f"""
SELECT DISTINCT name, CASE how WHEN 0 THEN 'exact' WHEN 1 THEN 'normal' WHEN 2 THEN 'suffix' WHEN 3 THEN 'two' ELSE CASE WHEN how = 4 AND (SELECT count(*) FROM part) = 1 THEN 'suffix' ELSE 'unresolved' END END AS classification, CASE WHEN how < 4 THEN 'm' || k END AS target_id FROM ({_ASKED})""")
def runtime_endpoint_resolution(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    kind, unit = F.lower("p_type"), F.concat(F.lit("P"), key)
    known = t.part.select(F.concat(F.lit("m"), key).alias("id"), F.concat_ws(".", F.lit("shop"), kind, unit, F.lit("run")).alias("qn"))
    how = F.col("p_partkey") % 6
    name = F.when(how == 0, F.concat_ws(".", F.lit("shop"), kind, unit, F.lit("run"))).when(how == 1, F.concat(F.concat_ws("/", F.lit("shop"), kind, unit), F.lit(".run"))).when(how == 2, F.concat_ws(".", kind, unit, F.lit("run")))
    name = name.when(how == 3, F.concat_ws(".", F.lit("elsewhere"), unit, F.lit("run"))).when(how == 4, "run").otherwise(unit)
    return runtime.resolve_endpoints(t.part.select(name.alias("name")).distinct(), known)


@query(f"""
WITH a AS (SELECT DISTINCT name FROM ({_ASKED})), i AS (SELECT CASE WHEN k % 2 = 0 THEN qn ELSE 'P' || k || '.run' END AS r, 'c' || k AS component FROM ({_QN})),
n AS (SELECT a.name, replace(a.name, '/', '.') AS x FROM a),
e AS (SELECT n.name, component FROM n JOIN i ON n.name = i.r),
two AS (SELECT name, array_to_string(string_split(x, '.')[-2:], '.') AS w, len(string_split(x, '.')) AS z, x FROM n WHERE name NOT IN (SELECT name FROM e)),
o AS (SELECT two.name, component FROM two JOIN i ON two.x = i.r OR ends_with(two.x, '.' || i.r) OR ends_with(i.r, '.' || two.x) OR (z >= 2 AND len(string_split(i.r, '.')) >= 2 AND w = array_to_string(string_split(i.r, '.')[-2:], '.')))
SELECT * FROM e UNION SELECT * FROM o""")
def runtime_components(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    kind, unit = F.lower("p_type"), F.concat(F.lit("P"), key)
    qn = F.concat_ws(".", F.lit("shop"), kind, unit, F.lit("run"))
    implemented = t.part.select(F.when(F.col("p_partkey") % 2 == 0, qn).otherwise(F.concat(unit, F.lit(".run"))).alias("reference"), F.concat(F.lit("c"), key).alias("component"))
    how = F.col("p_partkey") % 6
    name = F.when(how == 0, qn).when(how == 1, F.concat(F.concat_ws("/", F.lit("shop"), kind, unit), F.lit(".run"))).when(how == 2, F.concat_ws(".", kind, unit, F.lit("run"))).when(how == 3, F.concat_ws(".", F.lit("elsewhere"), unit, F.lit("run"))).when(how == 4, "run").otherwise(unit)
    return runtime.component_names(t.part.select(name.alias("name")).distinct(), implemented)


@query("""
SELECT DISTINCT 'm' || l_partkey AS source_id, 'm' || l_suppkey AS target_id FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey IN (SELECT p_partkey FROM part) AND NOT (l_partkey % 2 = 0 AND l_suppkey % 2 = 0)""")
def runtime_call_actions(t: Tables) -> DataFrame:
    named = lambda c: F.concat(F.lit("shop.P"), F.col(c).cast("string"), F.lit(".run"))
    known = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), named("p_partkey").alias("qn"))
    seen = t.lineitem.where("l_partkey % 3 = 0").select(named("l_partkey").alias("source"), named("l_suppkey").alias("target"))
    static = t.lineitem.where("l_partkey % 2 = 0 and l_suppkey % 2 = 0").select(F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("target"))
    return runtime.runtime_call_actions(seen, known, static)


@query("""
SELECT 'q.o' || o_orderkey AS source, 'x.s' || (o_custkey % 50) AS target FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 50 = o_custkey % 50)""")
def unexplained_calls(t: Tables) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    calls = t.orders.select(text("q.o", F.col("o_orderkey")).alias("source"), text("x.s", F.col("o_custkey") % 50).alias("target"))
    return runtime.unexplained(calls, t.lineitem.select(text("run.time.o", F.col("l_orderkey")).alias("source"), text("s", F.col("l_suppkey") % 50).alias("target")))


@query("""
SELECT DISTINCT 'c' || a.c_custkey AS source, 'c' || b.c_custkey AS target FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN customer b ON b.c_custkey = o_orderkey % 100 WHERE o_orderpriority = '1-URGENT' AND a.c_custkey <> b.c_custkey""")
def subscription_edges(t: Tables) -> DataFrame:
    cust = lambda c: F.concat(F.lit("Cust"), c.cast("string"))
    item = F.array(F.struct(F.concat(F.lit("app."), cust(F.col("o_orderkey") % 100)).alias("value")))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    calls = t.orders.select(F.when(urgent, F.concat(F.lit("app."), cust(F.col("o_custkey")), F.lit(".subscribe"))).otherwise(F.concat(cust(F.col("o_custkey")), F.lit(".publish"))).alias("name"), item.alias("arguments"))
    components = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), cust(F.col("c_custkey")).alias("name"))
    return structure.subscription_edges(calls, components).select("source", "target")
