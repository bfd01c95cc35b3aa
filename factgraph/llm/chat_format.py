"""Chat formatting: a state machine over roles checks turn order, a declarative template turns turns into text segments.

A template gives each role an opening and a closing marker and says whether its texts carry loss; roles that it does not know
take a generic form that spells the role out. All markers are control strings. Wherever one occurs inside a role or a text, the
escape character is put after its first character, and the escape character itself is doubled, so that formatted text holds
control strings only as markers and the texts can be read back exactly. DataFrame functions only.

The turns of a conversation meet in one row, since its formatted text is one value; they are gathered with map-side
combination and sorted by (turn, role, text), which also settles ties and repeated rows (each is a turn of its own).

Nulls: a null text is empty, a null role is the empty role, a null turn sorts first. A row without a conversation id belongs to no
other row: it is a conversation of one turn, with a null id. A conversation whose order the machine rejects is formatted all
the same; `valid` is false and `broken_at` is the index of the first turn without a transition (or the number of turns, if it
ends in a state that is not final). Very long texts are formatted whole, an empty table gives no rows, and columns other than the
four named ones play no part, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import common


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    other: Role = field(default_factory=lambda: Role("<|turn|>", "<|end|>"))
    other_text: str = "<|text|>"  # parts role and text of the generic form
    escape: str = "\\"
    #: state -> role -> next state; the machine starts in "start".
    transitions: dict[str, dict[str, str]] = field(default_factory=dict)
    final: frozenset[str] = frozenset()

    def controls(self) -> list[str]:
        known = [x for r in (*self.roles.values(), self.other) for x in (r.open, r.close)]
        return sorted({*known, self.other_text}, key=lambda x: (-len(x), x))


INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    transitions={"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    final=frozenset({"answered"}),
)


def _class(c: str) -> str:
    return re.escape(c)


def escaped(text: Column, t: Template) -> Column:
    """text with every escape character doubled and every control string broken up."""
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    inside = "|".join(f"{_class(c[0])}(?={_class(c[1:])})" for c in t.controls())
    return F.regexp_replace(doubled, f"({inside})", r"$1" + t.escape * 2)


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){_class(t.escape)}(.)", "$1")


def _machine(turns: Column, t: Template) -> Column:
    """struct(state, broken): broken is the index of the first turn that has no transition, or null."""
    arcs = [x for state, by_role in t.transitions.items() for role, to in by_role.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    table = F.create_map(*arcs)
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("broken"))

    def step(s: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(s["state"], F.lit("\n"), turn["role"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["n"] + 1).alias("n"), F.coalesce(s["broken"], F.when(to.isNull(), s["n"])).alias("broken"))

    end = F.aggregate(turns, start, step)
    return F.transform(F.array(end), lambda s: F.coalesce(s["broken"], F.when(~s["state"].isin(*t.final), s["n"])))[0]


def _segments(turn: Column, t: Template) -> Column:
    """(text, loss) segments of one turn, in order; their concatenation is the turn's formatted text."""
    seg = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text, role = escaped(turn["text"], t), turn["role"]
    out = F.array(seg(F.concat(F.lit(t.other.open), escaped(role, t), F.lit(t.other_text))), seg(text, t.other.loss), seg(F.lit(t.other.close)))
    for name, r in t.roles.items():
        out = F.when(role == name, F.array(seg(F.lit(r.open)), seg(text, r.loss), seg(F.lit(r.close)))).otherwise(out)
    return out


def formatted(turns: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>, valid, broken_at."""
    t = template
    key = F.col(conv).alias("conv_id")
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone")
    empty = F.lit("")
    rows = turns.select(key, alone, F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("broken_at", _machine(F.col("turns"), t)).withColumn("segments", F.flatten(F.transform("turns", lambda x: _segments(x, t))))
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.col("broken_at").isNull().alias("valid"), "broken_at")


def read_back(text: Column, t: Template) -> Column:
    """array<struct<role, text, loss>> parsed from formatted text alone: the template says which turns carry loss."""
    pairs = [(r.open, r.close) for r in t.roles.values()] + [(t.other.open, t.other.close)]
    one = "|".join(f"{_class(a)}.*?{_class(b)}" for a, b in pairs)

    def parsed(raw: Column) -> Column:
        cut = lambda a, b: raw.substr(F.lit(len(a) + 1), F.length(raw) - len(a) - len(b))
        inner = cut(t.other.open, t.other.close)
        out = F.struct(unescaped(F.substring_index(inner, t.other_text, 1), t).alias("role"), unescaped(F.substring_index(inner, t.other_text, -1), t).alias("text"), F.lit(t.other.loss).alias("loss"))
        for name, r in t.roles.items():
            out = F.when(raw.startswith(r.open), F.struct(F.lit(name).alias("role"), unescaped(cut(r.open, r.close), t).alias("text"), F.lit(r.loss).alias("loss"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?:{one})"), F.lit(0)), parsed)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    id_ = F.col("id")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), id_.alias("turn"), F.when(id_ == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = formatted(turns.unionByName(probe)).withColumn("turns", read_back(F.col("formatted"), INSTRUCT))
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def oracle(t: Template = INSTRUCT) -> str:
    """DuckDB SQL: digests of the turns themselves; formatted_chars from the template's marker and escape lengths."""
    q = lambda s: s.replace("'", "''")
    found = "|".join(re.escape(c) for c in t.controls())
    extra = lambda c: f"(length({c}) + len(regexp_extract_all({c}, '{q(found)}')) + length({c}) - length(replace({c}, '{q(t.escape)}', '')))"
    marks = " ".join(f"WHEN '{q(n)}' THEN {len(r.open) + len(r.close)}" for n, r in t.roles.items())
    arcs = " ".join(f"WHEN '{q(s)}\n{q(role)}' THEN '{q(to)}'" for s, by in t.transitions.items() for role, to in by.items())
    losses = ", ".join(f"'{q(n)}'" for n, r in t.roles.items() if r.loss)
    final = ", ".join(f"'{q(s)}'" for s in sorted(t.final))
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT *, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS own FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY turn NULLS FIRST, role, text) AS k FROM g),
machine AS (
  SELECT own, 0::BIGINT AS k, 'start' AS state FROM (SELECT DISTINCT own FROM o)
  UNION ALL SELECT m.own, o.k, CASE m.state || chr(10) || o.role {arcs} END FROM machine m JOIN o ON o.own = m.own AND o.k = m.k + 1),
ends AS (SELECT own, bool_and(state IS NOT NULL) AND arg_max(state, k) IN ({final}) AS ok FROM machine GROUP BY own)
SELECT o.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({losses})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({losses})), '')) AS loss_sha256,
  sum(CASE role {marks} ELSE {len(t.other.open + t.other.close + t.other_text)} + {extra("role")} END + {extra("text")})::BIGINT AS formatted_chars,
  coalesce(any_value(ok), false) AS valid
FROM o JOIN ends e ON o.own = e.own GROUP BY o.own, o.conv_id
"""


OP2_SQL = oracle()
