"""Resolution cascades: ordered tiers of lookups, of which the first that applies decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.lineage import cut


@dataclass(frozen=True)
class Tier:
    """One lookup. keys: fact column -> dimension column; id_col: what a match yields.

    A unique match gives `unique`, several give `ambiguous` and the sorted candidates. `when` limits the facts that the tier
    looks at; a terminal tier classifies those as `missing` if nothing matches, others pass them on."""

    name: str
    dimension: DataFrame
    keys: dict[str, str]
    id_col: str
    unique: str
    ambiguous: str
    terminal: bool = False
    missing: str = "unresolved"
    when: Column | None = None


def candidates(dimension: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """One row per key: n distinct ids and the least of them, by aggregates of bounded size. Null keys match nothing."""
    known = reduce(lambda df, k: df.where(F.col(k).isNotNull()), keys, dimension)
    return known.groupBy(*keys, id_col).agg(F.lit(1).alias("__one")).groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.min(id_col).alias("first"))


def resolve_cascade(facts: DataFrame, tiers: list[Tier], unresolved: str = "unresolved") -> DataFrame:
    """facts with classification, target_id, n_candidates (of an ambiguous match) and tier. Each tier is one left join on a
    pre-aggregated dimension, so rows of facts are neither lost nor multiplied. For many tiers see resolve_probes."""
    out = facts
    verdicts: list[tuple[Column, str, Column, Column, Column]] = []
    extra = []
    nobody, zero = F.lit(None).cast("string"), F.lit(0)
    for k, t in enumerate(tiers):
        dim = candidates(t.dimension, list(t.keys.values()), t.id_col)
        dim = dim.select(*(F.col(c).alias(f"__k{k}_{i}") for i, c in enumerate(t.keys.values())), F.col("n").alias(f"__n{k}"), F.col("first").cast("string").alias(f"__id{k}"))
        out = out.join(dim, reduce(lambda a, b: a & b, (F.col(f) == F.col(f"__k{k}_{i}") for i, f in enumerate(t.keys))), "left")
        extra += [f"__k{k}_{i}" for i in range(len(t.keys))] + [f"__n{k}", f"__id{k}"]
        on = F.lit(True) if t.when is None else F.coalesce(t.when, F.lit(False))
        n = F.coalesce(F.col(f"__n{k}"), zero)
        verdicts.append((on & (n == 1), t.name, F.lit(t.unique), F.col(f"__id{k}"), zero))
        verdicts.append((on & (n > 1), t.name, F.lit(t.ambiguous), nobody, n))
        if t.terminal:
            verdicts.append((on, t.name, F.lit(t.missing), nobody, zero))
    final = F.struct(F.lit(unresolved).alias("c"), nobody.alias("tier"), nobody.alias("id"), zero.alias("n"))
    for test, name, label, id_, n in reversed(verdicts):
        final = F.when(test, F.struct(label.alias("c"), F.lit(name).alias("tier"), id_.alias("id"), n.alias("n"))).otherwise(final)
    out = out.withColumn("__v", final).drop(*extra)
    return out.select(*facts.columns, F.col("__v.c").alias("classification"), F.col("__v.id").alias("target_id"), F.col("__v.n").alias("n_candidates"), F.col("__v.tier").alias("tier"))


@dataclass(frozen=True)
class Probe:
    """One tier of a cascade that asks the common dimension for (space, key). Labels as in Tier; without a key it only ends the
    cascade for the facts of `when`, with `missing`. An ambiguous match may give the label `several` and no id."""

    name: str
    space: str | None
    key: Column | None
    when: Column
    unique: str = "internal"
    ambiguous: str = "internal_ambiguous"
    missing: str | None = None


def resolve_probes(facts: DataFrame, row_id: str, probes: list[Probe], dimension: DataFrame, unresolved: str = "unresolved") -> DataFrame:
    """facts with classification, target_id, n_candidates and tier, by ONE join however many probes there are.

    dimension (space, key, id) holds the keys of all tiers and is reduced to (n, least id) per key first. Each fact becomes a few
    (probe, space, key) rows, which meet the dimension, and the first probe that finds something is the least struct of the
    fact. facts should be cut and row_id unique and stable."""
    # cut, so that both sides of the join come from plain exchanges and a hot key (a very common method name) can be split
    dim = cut(candidates(dimension, ["space", "key"], "id").withColumn("first", F.col("first").cast("string")))
    on = [F.coalesce(p.when, F.lit(False)) for p in probes]
    asked = F.array_compact(F.array(*(F.when(w & p.key.isNotNull(), F.struct(F.lit(k).alias("probe"), F.lit(p.space).alias("space"), p.key.cast("string").alias("key"))) for k, (p, w) in enumerate(zip(probes, on, strict=True)) if p.key is not None)))
    rows = facts.select(F.col(row_id).alias("__row"), F.explode(asked).alias("a")).select("__row", "a.*")
    hit = rows.join(dim, ["space", "key"]).groupBy("__row").agg(F.min(F.struct("probe", "n", "first")).alias("__hit"))
    out = facts.join(hit, F.col(row_id) == F.col("__row"), "left")
    ends = F.lit(len(probes))
    for k in reversed(range(len(probes))):
        if probes[k].missing is not None:
            ends = F.when(on[k], F.lit(k)).otherwise(ends)
    found = F.coalesce(F.col("__hit.probe"), F.lit(len(probes) + 1))
    wins, single = found <= ends, F.col("__hit.n") == 1
    pick = lambda values, at: F.get(F.array(*(F.lit(v) for v in values)), at)
    label = F.when(wins & single, pick([p.unique for p in probes], found)).when(wins, pick([p.ambiguous for p in probes], found)).when(ends < len(probes), pick([p.missing or "" for p in probes], ends)).otherwise(unresolved)
    tier = F.when(wins, pick([p.name for p in probes], found)).when(ends < len(probes), pick([p.name for p in probes], ends))
    return out.select(
        *facts.columns, label.alias("classification"), F.when(wins & single, F.col("__hit.first")).alias("target_id"), F.when(wins & ~single, F.col("__hit.n")).otherwise(0).alias("n_candidates"), tier.alias("tier"))


def candidate_table(facts: DataFrame, key_cols: list[str], dimension: DataFrame, dimension_keys: list[str], id_col: str) -> DataFrame:
    """(key columns, candidate) of ambiguous matches, a row for each candidate and key: the lists never travel with the facts."""
    keys = facts.select(*key_cols).distinct()
    dim = dimension.select(*(F.col(d).alias(k) for d, k in zip(dimension_keys, key_cols, strict=True)), F.col(id_col).alias("candidate")).distinct()
    return keys.join(dim, key_cols)


def first_candidate(facts: DataFrame, id_cols: list[str], candidate_col: str, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """For each fact the value of its first candidate (array column, in order of precedence) that the dimension knows."""
    at = facts.select(*id_cols, F.posexplode(candidate_col).alias("__pos", "__cand"))
    hit = at.join(dimension.select(F.col(key).alias("__cand"), F.col(value).alias("__value")), "__cand")
    best = hit.groupBy(*id_cols).agg(F.min(F.struct("__pos", "__value")).alias("__best")).select(*id_cols, F.col("__best.__value").alias("resolved"))
    return facts.join(best, id_cols, "left")
