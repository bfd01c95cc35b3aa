"""Control loops, subsystems, architecture relationships, containment and construction warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators import matching, scoring, selection
from factgraph.rules import tables as R

MAIN_LOOP = "main_candidate_loop"
SPREAD = 32
CHUNK = 4096


def loop_members(components: DataFrame) -> DataFrame:
    """(loop, component_id, role, confidence, ord): components by loop_hint; those without one join every hinted loop.

    components (id, role, loop_hint, confidence, ord), only roles that a loop may hold. Without any hint there is one main loop.
    The result is by definition loops times shared members; the hints meet the shared members in an equi-join on a constant
    bucket of each, so that it is spread over tasks instead of one."""
    rows = components.where(F.col("role").isin(*R.LOOP_ROLES)).select(F.col("id").alias("component_id"), "role", "loop_hint", "confidence", "ord")
    hints = rows.where("loop_hint is not null").select(F.col("loop_hint").alias("loop")).distinct()
    free = rows.where("loop_hint is null")
    # every hint is in all SPREAD buckets, a shared member in one
    buckets = hints.select("loop", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__bucket"))
    shared = free.withColumn("__bucket", F.pmod(F.xxhash64("component_id"), F.lit(SPREAD)).cast("int")).join(buckets, "__bucket").drop("__bucket")
    any_hint = hints.agg(F.count("*").alias("__hints"))  # one row
    alone = free.crossJoin(any_hint).where("__hints = 0").withColumn("loop", F.lit(MAIN_LOOP)).drop("__hints")
    shared = shared.unionByName(alone)
    own = rows.where("loop_hint is not null").withColumn("loop", F.col("loop_hint"))
    return own.unionByName(shared).select("loop", "component_id", "role", "confidence", "ord")


def control_loops(members: DataFrame) -> DataFrame:
    """(loop_id, name, n_members, roles, role_counts, missing_roles, completeness, confidence, status) of loops that hold at least
    two of the core roles and Knowledge. Completeness counts the core roles alone: all, at least two, fewer (weak)."""
    core = F.array(*map(F.lit, R.CORE_ROLES))
    counted = members.groupBy("loop", "role").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("k"))
    loops = counted.groupBy("loop").agg(
        F.sum("n").alias("n_members"), F.array_sort(F.collect_set("role")).alias("roles"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("role_counts"),
        F.coalesce(F.round(F.sum("c") / F.sum("k"), 2), F.lit(0.0)).alias("confidence"))
    have = F.size(F.array_intersect("roles", core))
    loops = loops.withColumn("__have", have).where(F.col("__have") + F.array_contains("roles", "Knowledge").cast("int") >= 2)
    missing = F.array_sort(F.array_except(core, "roles"))
    state = F.when(F.col("__have") == len(R.CORE_ROLES), "complete").when(F.col("__have") >= 2, "partial").otherwise("weak")
    status = F.when(F.col("confidence") >= R.STATUS_BANDS[0][0], "auto_accepted").otherwise("needs_review")
    return loops.select(F.concat(F.lit("control_loop:"), names.slug(F.col("loop"))).alias("loop_id"), F.col("loop").alias("name"), "n_members", "roles", "role_counts", missing.alias("missing_roles"), state.alias("completeness"), "confidence", status.alias("status"))


def _edge(df: DataFrame, kind: str, confidence) -> DataFrame:
    id_ = F.concat(F.lit("relationship:"), names.slug(F.col("source")), F.lit(f"__{kind}__"), names.slug(F.col("target")))
    return df.select(id_.alias("id"), "source", "target", F.lit(kind).alias("type"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))


def flow_edges(members: DataFrame) -> DataFrame:
    """Flow between consecutive members of a loop in role order; equal roles are skipped."""
    order = F.create_map(*(F.lit(x) for kv in R.ROLE_ORDER.items() for x in kv))
    rows = members.withColumn("__rank", F.try_element_at(order, F.col("role"))).where("__rank is not null and role <> 'Knowledge'")
    w = Window.partitionBy("loop").orderBy("__rank", "ord", "component_id")
    pairs = rows.select("component_id", "role", F.lead("component_id").over(w).alias("target"), F.lead("role").over(w).alias("next"))
    pairs = pairs.where("target is not null and role <> next").select(F.col("component_id").alias("source"), "target").distinct()
    return _edge(pairs, "mapek_flow", R.FLOW_CONFIDENCE)


def knowledge_edges(members: DataFrame) -> DataFrame:
    """From every other member of a loop to each Knowledge member, once for all loops that both are in.

    The result is by definition users times Knowledge members, so no pair is shuffled or compared: members are classed by the set of
    their loops, and each pair of classes with a loop in common joins all its members once. Users are dealt over SPREAD buckets, in
    all of which each Knowledge member is, so the work of a loop is spread over tasks. The Knowledge members of a class come in lists
    of about CHUNK, so the join moves one row for each list, and its last step alone makes the pairs."""
    loops = F.array_join(F.transform(F.array_sort(F.collect_set("loop")), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ",")  # text tells sets apart: each name follows its length
    rows = members.where("loop is not null and component_id is not null")
    of = lambda side, id_, set_: rows.where(side).groupBy(F.col("component_id").alias(id_)).agg(loops.alias(set_))
    known, users = of("role = 'Knowledge'", "target", "__known"), of("role <> 'Knowledge'", "source", "__users")
    # one row of each class says what loops it has
    held = lambda side, id_, classed, set_: rows.where(side).select("loop", F.col("component_id").alias(id_)).join(classed.groupBy(set_).agg(F.min(id_).alias(id_)), id_).select("loop", set_)
    pairs = held("role <> 'Knowledge'", "source", users, "__users").join(held("role = 'Knowledge'", "target", known, "__known"), "loop").select("__users", "__known").distinct()
    dealt = users.withColumn("__bucket", F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int"))
    chunks = known.groupBy("__known").agg(F.ceil(F.count("*") / CHUNK).alias("__chunks"))
    lists = known.join(chunks, "__known").groupBy("__known", F.pmod(F.xxhash64("target"), F.col("__chunks")).alias("__chunk")).agg(F.collect_list("target").alias("__targets"))
    asked = lists.join(pairs, "__known").select("__users", "__targets", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__bucket"))
    # a given number of partitions stays: those that are small before the join are not small after it
    dealt, asked = (x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__users", "__bucket").hint("merge") for x in (dealt, asked))
    edges = dealt.join(asked, ["__users", "__bucket"]).select("source", F.explode("__targets").alias("target")).where("source <> target")
    return _edge(edges, "uses_knowledge", R.KNOWLEDGE_CONFIDENCE)


def boundary_edges(components: DataFrame) -> DataFrame:
    """Edges of the role pairs at the boundary whose names share evidence; one equi-join on tokens for each pair."""
    out = None
    for source, target, kind in R.BOUNDARY_PAIRS:
        left, right = components.where(F.col("role") == source), components.where(F.col("role") == target)
        new = _edge(scoring.token_pairs(left, right, "id", "tokens"), kind, F.col("confidence"))
        out = new if out is None else out.unionByName(new)
    return selection.keep_first(out, ["source", "type", "target"], ["id"])


def subscription_edges(calls: DataFrame, components: DataFrame) -> DataFrame:
    """subscribes_to edges from calls a.subscribe(b): both names are looked up among components by short name.

    calls (name, arguments array<struct<value>>), components (id, name)."""
    rows = calls.where(F.col("name").contains(".subscribe")).select(names.last_segment(F.substring_index("name", ".subscribe", 1)).alias("s"), F.explode("arguments").alias("a"))
    rows = rows.select(F.lower("s").alias("s"), F.lower(names.last_segment(F.col("a.value"))).alias("t"))
    short = components.select(F.col("id"), F.lower("name").alias("short"))
    pairs = rows.join(short.select(F.col("short").alias("s"), F.col("id").alias("source")), "s").join(short.select(F.col("short").alias("t"), F.col("id").alias("target")), "t")
    return _edge(pairs.where("source <> target").select("source", "target").distinct(), "subscribes_to", R.SUBSCRIBE_CONFIDENCE)


def subsystems(components: DataFrame) -> DataFrame:
    """(subsystem_id, name, n_components, confidence): the managing and the managed subsystem."""
    side = F.when(F.col("role").isin(*R.MANAGING_ROLES), "managing").when(F.col("role").isin(*R.MANAGED_ROLES), "managed")
    rows = components.withColumn("side", side).where("side is not null")
    out = rows.groupBy("side").agg(F.countDistinct("id").alias("n_components"), scoring.mean_confidence("confidence").alias("confidence"))
    return out.select(F.concat(F.lit("subsystem:"), "side", F.lit("_subsystem")).alias("subsystem_id"), F.concat(F.initcap("side"), F.lit(" Subsystem")).alias("name"), "n_components", "confidence")


def containment(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allowed contains edges, and a CONTAIN-OK or CONTAIN-FORBIDDEN finding for each of the candidates (source, source_role, target,
    target_role, has_loop_manager)."""
    s, t = F.col("source_role"), F.col("target_role")
    allowed = F.coalesce(
        F.when(s == "Managing Subsystem", (t == "CL Manager") | ((t == "Control Loop") & ~F.col("has_loop_manager")))
        .when(s == "CL Manager", t == "Control Loop").when(s == "Control Loop", t.isin(*R.LOOP_ROLES)).when(s == "Managed Subsystem", t.isin(*R.MANAGED_ROLES)),
        F.lit(False),
    )
    rows = candidates.withColumn("__ok", allowed)
    edges = _edge(rows.where("__ok").select("source", "target").distinct(), "contains", R.CONTAINS_CONFIDENCE)
    good = matching.finding("CONTAIN-OK", "ok", rows.where("__ok"), "target", F.concat(s, F.lit(" contains "), t))
    return edges, good.unionByName(matching.finding("CONTAIN-FORBIDDEN", "blocked", rows.where("not __ok"), "target", F.concat(s, F.lit(" cannot directly contain "), t)))


def construction_warnings(loops: DataFrame, components: DataFrame) -> DataFrame:
    """LOOP-OK01, LOOP-W01, LOOP-W02 per loop, and CTRL-W01 to W03 for control roles that no component has."""
    core = matching.violates("LOOP-W01", "warning", loops, "loop_id", F.size("missing_roles") > 0, "the loop lacks core roles")
    whole = matching.violates("LOOP-OK01", "ok", loops, "loop_id", F.size("missing_roles") == 0, "the loop has all core roles")
    blind = matching.violates("LOOP-W02", "warning", loops, "loop_id", ~F.array_contains("roles", "Knowledge"), "the loop has no Knowledge component")
    out = core.unionByName(whole).unionByName(blind)
    have = components.agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("ReferenceInput", "MeasuredOutput", "Sensor")))
    for rule, role in (("CTRL-W01", "ReferenceInput"), ("CTRL-W02", "MeasuredOutput"), ("CTRL-W03", "Sensor")):
        out = out.unionByName(matching.violates(rule, "warning", have.withColumn("element", F.lit("model")), "element", F.col(role) == 0, f"no {role} was recovered"))
    return out


def statistics(components: DataFrame, loops: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts by status and sizes."""
    by_status = components.agg(F.count("*").alias("n_components"), *(F.count_if(F.col("status") == s).alias(s) for s in ("auto_accepted", "needs_review", "weak_suggestion")), scoring.mean_confidence("confidence").alias("mean_confidence"))
    sizes = loops.agg(F.count("*").alias("n_loops"), F.count_if(F.col("completeness") == "complete").alias("n_complete"))
    return by_status.crossJoin(sizes).crossJoin(edges.agg(F.count("*").alias("n_relationships")))  # three single rows


def dynamic_relations(components: DataFrame, runtime_pairs: DataFrame) -> DataFrame:
    """(source, target, type, scenario) of runtime calls between components whose roles may relate. runtime_pairs (source, target:
    component ids, scenario)."""
    role = components.select("id", "role").distinct()
    pairs = runtime_pairs.join(role.select(F.col("id").alias("source"), F.col("role").alias("a")), "source").join(role.select(F.col("id").alias("target"), F.col("role").alias("b")), "target")
    kind = F.create_map(*(F.lit(x) for a, b, k in R.DYNAMIC_PAIRS for x in (f"{a}>{b}", k)))
    return pairs.withColumn("type", F.try_element_at(kind, F.concat_ws(">", "a", "b"))).where("type is not null").select("source", "target", "type", "scenario").distinct()


def suggestions(components: DataFrame, loops: DataFrame, runtime_pairs: DataFrame) -> DataFrame:
    """Deterministic review suggestions: (id, suggestion_type, confidence, affected, message).

    components (id, role, implemented_by array), loops of control_loops(), runtime_pairs (source, target: component ids, scenario)."""
    seen = dynamic_relations(components, runtime_pairs)
    text = F.concat(F.lit("seen at run time in "), F.coalesce("scenario", F.lit("unknown_scenario")), F.lit(": "), F.col("type"))
    dynamic = seen.select(F.lit("dynamic_relation").alias("suggestion_type"), F.lit(0.90).alias("confidence"), F.array("source", "target").alias("affected"), text.alias("message"))
    per_code = multi_role_implementations(components)
    doubled = per_code.select(F.lit("role_disambiguation").alias("suggestion_type"), F.lit(0.75).alias("confidence"), "affected", F.concat(F.lit("one code element, several roles: "), F.array_join("roles", ", ")).alias("message"))
    partial = loops.where("completeness = 'partial'").select(F.lit("partial_control_loop").alias("suggestion_type"), F.lit(0.70).alias("confidence"), F.array("loop_id").alias("affected"), F.concat(F.lit("missing: "), F.array_join("missing_roles", ", ")).alias("message"))
    absent = loops.where(~F.array_contains("roles", "Knowledge")).select(F.lit("missing_abstraction").alias("suggestion_type"), F.lit(0.70).alias("confidence"), F.array("loop_id").alias("affected"), F.lit("no Knowledge component").alias("message"))
    out = dynamic.unionByName(doubled).unionByName(partial).unionByName(absent)
    return out.select(names.stable_id("ai_suggestion", F.col("suggestion_type"), F.array_join("affected", "|"), F.col("message")).alias("id"), *out.columns)


def multi_role_implementations(components: DataFrame) -> DataFrame:
    """(code, roles, affected) of code elements that implement components of more than one role."""
    each = components.select("role", "id", F.explode("implemented_by").alias("code"))
    return each.groupBy("code").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("id")).alias("affected")).where("size(roles) > 1")


def implementation_refs(components: DataFrame, known_code: DataFrame) -> DataFrame:
    """(id, reference, code_id) of every implemented_by entry, code_id null where no code element (id) has it; a component without
    entries keeps one row with a null reference."""
    rows = components.select("id", F.explode_outer("implemented_by").alias("reference"))
    return rows.join(known_code.select(F.col("id").alias("code_id")).distinct(), F.col("reference") == F.col("code_id"), "left").select("id", "reference", "code_id")


def apply_suggestions(edges: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted changes (operation, source, target, relationship_type) as new relationships, and a finding for each operation that
    is not supported. add_relationship adds an edge that is not there yet."""
    add = accepted.where("operation = 'add_relationship'").select("source", "target", F.col("relationship_type").alias("type")).where("source is not null and target is not null and type is not null").distinct()
    new = add.join(edges.select("source", "target", "type").distinct(), ["source", "target", "type"], "left_anti")
    id_ = F.concat(F.lit("relationship:"), names.slug(F.col("source")), F.lit("__"), F.col("type"), F.lit("__"), names.slug(F.col("target")))
    new = new.select(id_.alias("id"), "source", "target", "type", F.lit(True).alias("materialize"), F.lit("user_added").alias("review_status"))
    odd = accepted.where("operation is null or operation not in ('add_relationship', 'optional_add_component')")
    return new, matching.finding("APPLY-UNSUPPORTED", "warning", odd.withColumn("__op", F.coalesce("operation", F.lit("none"))), "__op", F.lit("this operation is not applied"))


def loop_role_counts(members: DataFrame) -> DataFrame:
    """(loop, role, n): members of each role in each loop."""
    return members.groupBy("loop", "role").agg(F.count("*").alias("n"))
