"""Applicability gate, role inference and control input/output recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import names
from factgraph.operators import scoring, selection
from factgraph.rules import tables as R


def normalised(text: Column) -> Column:
    """Corpus form: lower case, - and . as _."""
    return F.translate(F.lower(text), "-.", "__")


def gate(corpus: DataFrame, project: str = "project", text: str = "text", role_edges: DataFrame | None = None) -> DataFrame:
    """(project, fired, score, decision) from corpus strings (names, paths, types, calls).

    Each string is tested against the vocabularies where it is; only sets of found terms meet per project. role_edges
    (project, source, target): call or dependency edges by name, for the rule on edges between different roles."""
    x = normalised(F.col(text))
    vocab = {"a": R.AUTONOMIC_TERMS, "r": list(R.ROLE_TERMS), "s": R.SENSOR_TERMS, "e": R.EFFECTOR_TERMS, "k": R.KNOWLEDGE_TERMS}
    found = corpus.select(project, *(scoring.found_terms(x, terms).alias(k) for k, terms in vocab.items()))
    flat = found.groupBy(project).agg(*(F.bool_or(F.size(k) > 0).alias(k) for k in "asek"), *(F.bool_or(F.array_contains("r", t)).alias(f"r_{t}") for t in R.ROLE_TERMS))
    roles = F.size(F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f"r_{t}"), F.lit(role)) for t, role in R.ROLE_TERMS.items())))))
    if role_edges is not None:
        role = lambda c: F.coalesce(*(F.when(normalised(F.col(c)).contains(t), F.lit(r)) for t, r in R.ROLE_TERMS.items()))
        linked = role_edges.select(project, (role("source") != role("target")).alias("x")).groupBy(project).agg(F.bool_or(F.coalesce("x", F.lit(False))).alias("linked"))
        flat = flat.join(linked, project, "left")
    else:
        flat = flat.withColumn("linked", F.lit(False))
    tests = dict(zip(R.GATE_WEIGHTS, [F.col("a"), roles >= R.GATE_MIN_ROLES, F.col("s"), F.col("e"), F.col("k"), F.coalesce("linked", F.lit(False))], strict=True))
    fired = F.array_compact(F.array(*(F.when(t, F.lit(rule)) for rule, t in tests.items())))
    out = flat.select(project, fired.alias("fired"), scoring.weighted_score([(R.GATE_WEIGHTS[r], t) for r, t in tests.items()]).alias("score"))
    return out.withColumn("decision", scoring.banded(F.col("score"), R.GATE_BANDS, "not_applicable"))


def class_roles(classes: DataFrame, methods: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(class_id, name, role, confidence, status): the best rule of each class; rule order settles ties.

    classes (class_id, name, path), methods (class_id, name), calls (class_id, name). Method counts are pre-aggregated."""
    per_rule = [F.count_if(scoring.any_term(F.lower("name"), m)).alias(f"m{i}") for i, (_, _, m, _) in enumerate(R.ROLE_RULES)]
    rows = classes.join(methods.groupBy("class_id").agg(*per_rule), "class_id", "left")
    if calls is not None:
        hint = [F.bool_or(scoring.any_term(F.lower("name"), R.HINT_TERMS.get(role, []))).alias(f"c{i}") for i, (role, _, _, _) in enumerate(R.ROLE_RULES)]
        rows = rows.join(calls.groupBy("class_id").agg(*hint), "class_id", "left")
    scored = []
    for i, (role, terms, _, _) in enumerate(R.ROLE_RULES):
        points = F.when(scoring.any_term(F.lower("name"), terms), R.NAME_WEIGHT).otherwise(0.0) + F.when(scoring.any_term(F.lower("path"), terms), R.PATH_WEIGHT).otherwise(0.0)
        points = points + F.least(F.lit(R.METHOD_MOST), R.METHOD_WEIGHT * F.coalesce(F.col(f"m{i}"), F.lit(0)))
        if calls is not None:
            points = points + F.when(F.coalesce(F.col(f"c{i}"), F.lit(False)), R.CALL_WEIGHT).otherwise(0.0)
        scored.append(F.struct(F.round(F.least(points, F.lit(1.0)), 2).alias("confidence"), F.lit(-i).alias("ord"), F.lit(role).alias("role")))
    best = rows.withColumn("best", F.array_max(F.array(*scored))).where("best.confidence > 0")
    return best.select("class_id", "name", "best.role", "best.confidence", scoring.banded(F.col("best.confidence"), R.STATUS_BANDS, R.WEAK).alias("status"))


def decorator_roles(callables: DataFrame) -> DataFrame:
    """(callable_id, name, role, confidence, status, loop_hint) from decorators such as loop.monitor; the first one wins."""
    table = F.create_map(*(F.lit(x) for kv in R.DECORATOR_ROLES.items() for x in kv))
    rows = callables.select("callable_id", "name", F.posexplode("decorators").alias("ord", "d"))
    last = F.regexp_replace(F.element_at(F.split("d", r"\."), -1), r"\(.*$", "")
    rows = rows.withColumn("role", F.try_element_at(table, F.lower(last))).where("role is not null")
    rows = rows.withColumn("loop_hint", F.when(F.col("d").contains("."), F.substring_index("d", ".", 1)))
    first = selection.keep_first(rows.select("callable_id", "ord", "name", "role", "loop_hint"), ["callable_id"], ["ord"])
    return first.select("callable_id", "name", "role", F.lit(R.DECORATOR_CONFIDENCE).alias("confidence"), F.lit("auto_accepted").alias("status"), "loop_hint")


def registration_roles(calls: DataFrame) -> DataFrame:
    """(callable_id, role, confidence, status, loop_hint) from registering calls such as loop.plan(...): the first call of a callable
    (callable_id, ord, name) that names one."""
    name = F.lower("name")
    role = F.coalesce(*(F.when(name.contains(term), F.lit(r)) for term, r in R.REGISTRATION_ROLES.items()))
    rows = calls.withColumn("role", role).where("role is not null").withColumn("loop_hint", F.when(F.col("name").contains("."), F.substring_index("name", ".", 1)))
    first = selection.keep_first(rows.select("callable_id", "ord", "role", "loop_hint"), ["callable_id"], ["ord"])
    return first.select("callable_id", "role", F.lit(R.REGISTRATION_CONFIDENCE).alias("confidence"), F.lit("auto_accepted").alias("status"), "loop_hint")


def promoted(roles: DataFrame) -> DataFrame:
    """Roles that become components: accepted or confident enough, and of a kind that is ever promoted."""
    return roles.where(((F.col("status") == "auto_accepted") | (F.col("confidence") >= R.PROMOTE_FROM)) & ~F.col("role").isin(*R.NEVER_PROMOTED))


def name_tokens(c: Column) -> Column:
    """Lower-case words of a name: runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def control_io(elements: DataFrame) -> DataFrame:
    """(id, name, role, confidence) of control inputs and outputs among elements (id, name, kind, qualified_name and, if there,
    decorators), capped per role.

    The words of the name and of the decorators are looked up; CONTROL_KINDS says among which kinds. The first rule in order of
    precedence wins; caps keep the most confident, ties by id. Excluded are elements whose name (its words) or part of whose
    qualified name is listed."""
    tokens = name_tokens(F.col("name"))
    more = F.flatten(F.transform(F.coalesce("decorators", F.array().cast("array<string>")), name_tokens)) if "decorators" in elements.columns else F.array().cast("array<string>")
    rows = elements.withColumn("__t", F.array_union(tokens, more)).where(~F.array_join(tokens, " ").isin(*R.CONTROL_EXCLUDED_NAMES))
    rows = rows.where(~scoring.any_term(F.lower(F.coalesce("qualified_name", F.col("id"))), R.CONTROL_EXCLUDED_PATHS))
    choice = F.lit(None).cast("struct<role:string,confidence:double>")
    for role, confidence, terms in reversed(R.CONTROL_RULES):
        on = F.col("kind").isin(*R.CONTROL_KINDS[role])
        choice = F.when(on & F.arrays_overlap("__t", F.array(*map(F.lit, terms))), F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))).otherwise(choice)
    rows = rows.withColumn("__c", choice).where("__c is not null").select("id", "name", F.col("__c.role").alias("role"), F.col("__c.confidence").alias("confidence"))
    return selection.cap_per_group(rows, ["role"], "confidence", ["id"], R.CONTROL_CAPS, "role")


def component_id(name: Column, role: Column, code_id: Column | None = None) -> Column:
    base = F.concat(F.lit("component:"), names.slug(name), F.lit("_"), names.slug(role))
    if code_id is None:
        return base
    tail = F.array_join(F.slice(F.split(names.slug(code_id), "_"), -3, 3), "_")
    few = F.array_join(F.split(names.slug(code_id), "_"), "_")
    return F.concat_ws("_", base, F.when(F.size(F.split(names.slug(code_id), "_")) >= 3, tail).otherwise(few))


def distinct_components(components: DataFrame) -> DataFrame:
    """The first (ord) of the components with one role, name and implemented_by."""
    return selection.keep_first(components, ["role", "name", "implemented_by"], ["ord"])
