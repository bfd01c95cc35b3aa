"""Queries of the projection, deduplication, summary and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.facts import elements
from factgraph.functions import names
from factgraph.kdm import model
from factgraph.operators import selection
from factgraph.plans.registry import Tables, query
from factgraph.streaming import trace


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def keep_best(t: Tables) -> DataFrame:
    return selection.keep_best(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", ["c_custkey"])


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1")
def keep_first(t: Tables) -> DataFrame:
    return selection.keep_first(t.conversations.where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id"], ["turn", "text"])


@query("""
SELECT l_orderkey, first(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (l_returnflag IS NOT NULL) AS l_returnflag, min(l_shipdate) AS line_start, max(l_shipdate) AS line_end
FROM (SELECT l_orderkey, min(l_returnflag) AS l_returnflag, l_linenumber, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL) GROUP BY 1""")
def field_merge(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_shipdate").alias("line_start")).withColumn("line_end", F.col("line_start"))
    return selection.merge_fields(lines, "l_orderkey", "l_linenumber", ["l_returnflag"], ["line_start"], ["line_end"])


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 10")
def cap_per_role(t: Tables) -> DataFrame:
    return selection.cap_per_group(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", ["p_partkey"], 10)


_CAPS = {"ECONOMY": 8, "SMALL": 10, "LARGE": 10, "MEDIUM": 10}


@query("""
SELECT p_type, p_partkey, p_size FROM part
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) <= CASE p_type WHEN 'ECONOMY' THEN 8 WHEN 'SMALL' THEN 10 WHEN 'LARGE' THEN 10 WHEN 'MEDIUM' THEN 10 ELSE 0 END""")
def cap_by_kind(t: Tables) -> DataFrame:
    return selection.cap_per_group(t.part.select("p_type", "p_partkey", "p_size"), ["p_type"], "p_size", ["p_partkey"], _CAPS, "p_type")


@query("""
SELECT key, max(n_chars) AS score, array_to_string(list_sort(list(DISTINCT source)), ',') AS evidence, count(*) AS n_merged
FROM (SELECT sha1(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key, n_chars, source FROM documents) GROUP BY key""")
def suggestion_merge(t: Tables) -> DataFrame:
    key = F.sha1(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ").cast("binary"))
    rows = t.documents.select(key.alias("key"), F.col("n_chars").alias("score"), F.array("source").alias("evidence"))
    return selection.merge_sets(rows, "key", "score", "evidence").withColumn("evidence", F.array_join("evidence", ","))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) = 1""")
def new_runtime_edges(t: Tables) -> DataFrame:
    existing = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selection.add_new(existing, t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey", "o_totalprice"])


@query("""
SELECT doc_id, len(ids) AS n_identifiers, coalesce(array_to_string(list_sort(list_distinct(ids)), ' '), '') AS identifiers
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '"[^"]*"|''[^'']*''', ' ', 'g'), '([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)', 1) AS ids FROM documents)""".replace("\\\\", "\\"))
def identifier_extract(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id", names.identifiers(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_identifiers"), F.array_join(F.array_sort(F.array_distinct("ids")), " ").alias("identifiers"))


@query("""
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.]', '_', 'g') AS safe, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  'body:' || substr(sha1(url || '|' || page_id), 1, 12) AS id, regexp_extract(url, '[^/]*$') AS last_segment FROM pages""")
def safe_names(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", names.safe_name(url).alias("safe"), names.slug(url).alias("slug"), names.stable_id("body", url, F.col("page_id")).alias("id"), names.last_segment(url, "/").alias("last_segment"))


@query("""
WITH c AS (SELECT CASE WHEN p_size % 4 = 0 THEN 'self.' || p_name WHEN p_size % 4 = 1 THEN 'super().' || p_name WHEN p_size % 4 = 2 THEN p_type || '.' || p_name ELSE p_type END AS call FROM part)
SELECT CASE WHEN starts_with(call, 'self.') THEN 'self.*' WHEN starts_with(call, 'super') THEN 'super.*' WHEN contains(call, '.') THEN string_split(call, '.')[1] || '.*' ELSE call END AS prefix, count(*) AS n
FROM c GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10""")
def unresolved_prefixes(t: Tables) -> DataFrame:
    k, name, kind = F.col("p_size") % 4, F.col("p_name"), F.col("p_type")
    call = F.when(k == 0, F.concat(F.lit("self."), name)).when(k == 1, F.concat(F.lit("super()."), name)).when(k == 2, F.concat(kind, F.lit("."), name)).otherwise(kind)
    return selection.top_k(t.part.select(names.receiver_prefix(call).alias("prefix")), ["prefix"], 10)


@query("""
SELECT p_partkey, p_name || '(' || p_size || ', brand=' || p_brand || ', **' || p_type || ')' AS signature FROM part""")
def call_signatures(t: Tables) -> DataFrame:
    item = lambda name, value: F.struct(F.lit(name).cast("string").alias("name"), value.cast("string").alias("value"))
    args = F.array(item(None, F.col("p_size")), item(None, F.lit(None)))
    keywords = F.array(item("brand", F.col("p_brand")), item(None, F.col("p_type")), item("gone", F.lit(None)))
    return t.part.select("p_partkey", names.signature(F.col("p_name"), args, keywords).alias("signature"))


@query("""
WITH v AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN value::BIGINT::VARCHAR WHEN 1 THEN (event_id % 100)::VARCHAR || '.5' WHEN 2 THEN '''' || event_type || '''' WHEN 3 THEN 'None' WHEN 4 THEN 'True' WHEN 5 THEN '[' || event_id || ']' WHEN 6 THEN props ELSE event_type END AS x FROM events)
SELECT CASE event_id % 8 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'str' WHEN 3 THEN 'NoneType' WHEN 4 THEN 'bool' WHEN 5 THEN 'list' WHEN 6 THEN 'dict' END AS type, event_id % 8 < 5 AS is_literal, count(*) AS n FROM v GROUP BY ALL""")
def literal_types(t: Tables) -> DataFrame:
    k, id_ = F.col("event_id") % 8, F.col("event_id")
    whole = F.round("value").cast("long").cast("string")
    x = F.when(k == 0, whole).when(k == 1, F.concat((id_ % 100).cast("string"), F.lit(".5"))).when(k == 2, F.concat(F.lit("'"), "event_type", F.lit("'"))).when(k == 3, "None").when(k == 4, "True")
    x = x.when(k == 5, F.concat(F.lit("["), id_.cast("string"), F.lit("]"))).when(k == 6, F.col("props")).otherwise(F.col("event_type"))
    return t.events.select(names.literal_type(x).alias("type"), names.is_literal(x).alias("is_literal")).groupBy("type", "is_literal").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT unnest(['int', 'os.Path', 'ValueError', 'a:b', '<locals>', 'function', 'typing.List', 'lower', 'HTTP_ERROR', 'mod.CamelCase']) AS name)
SELECT name || p_type AS name, name NOT IN ('', 'function') AND NOT contains(name, ':') AND NOT regexp_full_match(name || p_type, '<.*>') AS valid,
  regexp_matches(name || p_type, '^(builtins|typing)\\.') OR regexp_matches(regexp_extract(name || p_type, '[^.]*$'), '(Error|Exception)$|^[A-Z][A-Za-z0-9]*$|^[A-Z][A-Z0-9_]+$') AS plausible
FROM n, (SELECT DISTINCT CASE WHEN p_size > 25 THEN '' ELSE p_type END AS p_type FROM part) p WHERE p_type <> '' OR name <> 'function'""".replace("\\\\", "\\"))
def external_types(t: Tables) -> DataFrame:
    given = F.explode(F.array(*map(F.lit, ("int", "os.Path", "ValueError", "a:b", "<locals>", "function", "typing.List", "lower", "HTTP_ERROR", "mod.CamelCase"))))
    kinds = t.part.select(F.when(F.col("p_size") > 25, "").otherwise(F.col("p_type")).alias("kind")).distinct()
    rows = kinds.select("kind", given.alias("stem")).where("kind <> '' or stem <> 'function'").withColumn("name", F.concat("stem", "kind"))
    return rows.select("name", (names.is_valid_type(F.col("name")) & (F.col("stem") != "function")).alias("valid"), names.is_plausible_external(F.col("name")).alias("plausible"))


@query("""
WITH n AS (SELECT p_partkey, p_name, p_type, p_name || '_' || p_type AS r FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS plain, count(*) OVER (PARTITION BY r) AS by_role, r || '_' || p_partkey AS tail FROM n)
SELECT p_partkey, CASE WHEN plain = 1 THEN p_name WHEN by_role = 1 THEN r ELSE tail END AS display_name FROM c""")
def display_names(t: Tables) -> DataFrame:
    return selection.disambiguate(t.part.select("p_partkey", "p_name", "p_type"), "p_partkey", "p_name", "p_type").select("p_partkey", "display_name")


@query("SELECT c_mktsegment AS metaclass, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1")
def count_by_kind(t: Tables) -> DataFrame:
    return model.metaclass_counts(t.customer.select(F.col("c_mktsegment").alias("metaclass")), t.orders.select(F.col("o_orderpriority").alias("type")))


@query("""
WITH e AS (SELECT 'a:' || l_orderkey AS source, 'b:' || l_partkey AS target, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_suppkey END AS line FROM lineitem),
i AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a:' ELSE 'b:' END AS p, o_orderkey AS k, o_custkey AS line FROM orders WHERE o_orderstatus <> 'O'),
x AS (SELECT p || k AS id, k, min(line) AS line FROM i GROUP BY ALL)
SELECT e.source, e.target, e.l_linenumber AS nth, coalesce(e.line, s.line, s2.line, t.line, t2.line)::INT AS line FROM e
LEFT JOIN x s ON s.id = e.source LEFT JOIN x s2 ON s2.k::VARCHAR = substr(e.source, 3) LEFT JOIN x t ON t.id = e.target LEFT JOIN x t2 ON t2.k::VARCHAR = substr(e.target, 3)""")
def edge_locations(t: Tables) -> DataFrame:
    line = F.when(F.col("l_linenumber") == 1, F.col("l_suppkey").cast("int"))
    edges = t.lineitem.select(F.concat(F.lit("a:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("b:"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_linenumber").alias("nth"), line.alias("line"))
    id_ = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "a:").otherwise("b:"), F.col("o_orderkey").cast("string"))
    index = t.orders.where("o_orderstatus <> 'O'").select(id_.alias("id"), F.col("o_custkey").cast("int").alias("line"))
    return elements.located(edges, index)


@query("""
WITH e AS (SELECT 'f.' || (user_id % 40) AS qualified_name, event_type, event_id FROM events)
SELECT qualified_name, what, array_to_string(list_sort(list(DISTINCT t)), ',') AS types FROM (
  SELECT qualified_name, 'argument a' AS what, event_type AS t FROM e UNION ALL SELECT qualified_name, 'return', 'r' || (event_id % 3) FROM e WHERE event_id % 2 = 0 UNION ALL SELECT qualified_name, 'exception', event_type || 'Error' FROM e WHERE event_id % 5 = 0) GROUP BY ALL""")
def observed_types(t: Tables) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    none = F.lit(None).cast("string")
    events = t.events.select(
        F.concat(F.lit("f."), (F.col("user_id") % 40).cast("string")).alias("qualified_name"), F.create_map(F.lit("a"), kind).alias("arg_types"), none.alias("receiver_type"),
        F.when(k % 2 == 0, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("return_type"), F.when(k % 5 == 0, F.concat(kind, F.lit("Error"))).alias("exception_type"))
    return trace.type_observations(events).withColumn("types", F.array_join("types", ","))


_TYPES = ["list[str]", "Dict[str, List[int]]", "'Box'", "Optional[Tuple[int, str]]", "int | None", "builtin_type:str", "", "Map<String, List<Integer>>"]


@query("""
WITH x(i, r, w, a) AS (VALUES (0, 'list[str]', 'list', 'str'), (1, 'dict[str, List[int]]', 'dict', 'str;List[int]'), (2, 'Box', 'Box', ''), (3, 'Optional[Tuple[int, str]]', 'Optional', 'Tuple[int, str]'), (4, 'int | None', 'int', ''), (5, 'str', 'str', ''), (6, NULL, NULL, NULL),
  (7, 'Map<String, List<Integer>>', 'Map<String, List<Integer>>', ''))
SELECT p_partkey, r AS resolved, w AS raw, coalesce(a, '') AS arguments FROM part JOIN x ON p_size % 8 = i""")
def normal_types(t: Tables) -> DataFrame:
    given = F.get(F.array(*map(F.lit, _TYPES)), F.col("p_size") % 8)
    rows = t.part.select("p_partkey", names.normal_type(given).alias("resolved"))
    return rows.select("p_partkey", "resolved", names.raw_type(F.col("resolved")).alias("raw"), F.coalesce(F.array_join(names.type_arguments(F.col("resolved")), ";"), F.lit("")).alias("arguments"))
