"""Quality rules: one Spark projection, compiled from a threshold table, computes text statistics and the verdict.

Statistics (words are runs of non-white characters): counts of words, word characters, symbols, repeated lines, words inside
repeated 3-word windows, and from them ratios of length, symbols, capitals, exclamation marks, list marks, repeated lines
and stop words. The threshold table names a statistic, its bounds, and the least number of words from which it applies.

The windows of a text are hashed and sorted as packed 64-bit numbers (hash in the high bits, position in the low ones), so
one primitive sort finds the equal ones; neighbours are then compared as words, and a text whose neighbours disagree although
their hashes agree is counted again by sorting the windows themselves. The result is exact for texts below 2**31 words.

Nulls and empty texts have no words: every count is 0, base_failed is true, kept is false. Rows are judged one by one, so
repeated rows get equal results, and other columns play no part. Very long texts are judged whole; an empty table gives no rows.
A column named like the result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import common

# Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this "
    "der die und das den von zu mit sich auf für ist im nicht ein eine "
    "le la les de des et en un une du que qui dans pour par sur au "
    "el los las y del se con una su es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """The text is rejected if `stat` lies outside low..high, provided that it has at least `from_words` words."""

    name: str
    stat: str
    low: float = -math.inf
    high: float = math.inf
    from_words: int = 0


RULES = (
    Rule("mean word length", "mean_word", low=2.0, high=14.0),
    Rule("symbols per word", "symbol_ratio", high=0.20),
    Rule("exclamations per word", "exclaim_ratio", high=0.30),
    Rule("capitals per word character", "upper_ratio", high=0.50),
    Rule("repeated lines", "dup_line_ratio", high=0.50),
    Rule("stop words", "stop_ratio", low=0.04),
)
#: Base rules of the contract: enough words, and at most half of them inside repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3


def _covered(starts: Column, size: int) -> Column:
    """Words inside windows of `size` words that begin at the sorted positions."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(-size).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(size).cast("long"), p - s["last"])).alias("n")),
    )
    return step["n"]


def _window_at(words: Column, p: Column) -> list[Column]:
    return [F.get(words, (p + k).cast("int")) for k in range(WINDOW)]


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once: a lambda over a one-element array."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows that occur at least twice."""
    n = F.size(words)

    def packed(bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
        hashes = F.transform(F.slice(words, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.call_function("shiftleft", F.xxhash64(w, *_window_at(words, i)[1:]), bits).bitwiseOR(i.cast("long")))
        return _let(F.sort_array(hashes), lambda s: _repeats(words, s, bits, low))

    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double") + 1)).cast("int")
    counted = _let(bits, packed)
    exact = _let(F.array_sort(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.concat_ws(" ", *_window_at(words, i)).alias("w"), i.cast("long").alias("p")))), _repeats_exact)
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(counted, lambda c: F.when(c >= 0, c).otherwise(exact)))


def _repeats(words: Column, s: Column, bits: Column, low: Column) -> Column:
    """Covered words from sorted packed windows; -1 if equal hashes hide different words."""

    def same(a: Column, b: Column) -> Column:
        return F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)

    position = low - 1
    inner = F.filter(s, lambda x, i: F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))

    def judge(found: Column) -> Column:
        where = F.transform(found, lambda x: x.bitwiseAND(position))
        differs = F.exists(
            F.transform(found, lambda x, i: F.struct(x.alias("x"), F.get(found, i - 1).alias("y"), i.alias("i"))),
            lambda e: (e["i"] > 0) & same(e["x"], e["y"]) & (F.array(*_window_at(words, e["x"].bitwiseAND(position))) != F.array(*_window_at(words, e["y"].bitwiseAND(position)))),
        )
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).when(differs, F.lit(-1).cast("long")).otherwise(_covered(F.sort_array(where), WINDOW))

    return _let(inner, judge)


def _repeats_exact(s: Column) -> Column:
    again = F.filter(s, lambda x, i: F.when(i > 0, x["w"] == F.get(s, i - 1)["w"]).otherwise(False) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)))
    return _covered(F.array_sort(F.transform(again, lambda x: x["p"])), WINDOW)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def statistics(text: Column) -> dict[str, tuple[Column, ...]]:
    """Stages of named columns; each stage may use the names of those before it."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(text, F.lit(common.WHITE))
    lines = F.filter(F.col("__lines"), lambda x: F.trim(x, F.lit(common.WHITE)) != "")
    n = F.col("n_words").cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    stop = F.filter(F.col("__words"), lambda w: F.lower(w).isin(STOP_WORDS))
    return {
        "parts": {
            "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.GAP, -1)),
            "__lines": F.split(text, "\n", -1),
            "n_symbols": _count(text, r"[#*$%&|<>]"),
            "__exclaim": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
            "__upper": _count(text, r"\p{Lu}"),
        },
        "counts": {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "__lines": lines,
            "n_repeat_words": repeat_words(F.col("__words")),
            "__stop": F.size(stop),
        },
        "lines": {"n_lines_with_words": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")},
        "ratios": {
            "mean_word": per_word(F.col("word_chars")),
            "symbol_ratio": per_word(F.col("n_symbols")),
            "exclaim_ratio": per_word(F.col("__exclaim")),
            "upper_ratio": F.col("__upper") / chars,
            "dup_line_ratio": F.when(F.col("n_lines_with_words") > 0, F.col("n_dup_lines") / F.col("n_lines_with_words")).otherwise(0.0),
            "stop_ratio": per_word(F.col("__stop")),
        },
    }


def verdict(rules: tuple[Rule, ...]) -> dict[str, Column]:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    base = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
    failed = [F.when((words >= r.from_words) & ((F.col(r.stat) < r.low) | (F.col(r.stat) > r.high)), F.lit(r.name)) for r in rules]
    broken = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return {"base_failed": base, "failed_rules": broken, "kept": ~base & (F.size(broken) == 0)}


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "quality") -> DataFrame:
    """docs with a struct column `name`: the statistics, failed_rules, base_failed and kept. A column of that name goes."""
    out = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text"))
    for stage in statistics(F.col("__text")).values():
        out = out.withColumns(stage)
    out = out.withColumns(verdict(rules))
    names = [c for c in out.columns if not c.startswith("__")]
    return out.select(*(F.col(f"__row.{c}").alias(c) for c in docs.columns if c != name), F.struct(*names).alias(name))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep."""
    # the partition id is not deterministic, so the optimizer leaves the filter above the projection; pushed below it, the
    # verdict's statistics would be computed anew for every rule that names them
    out = judged(docs, name="__quality").withColumn("__here", F.spark_partition_id())
    return out.where(F.col("__quality.kept") & (F.col("__here") >= 0)).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *(f"quality.{c}" for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for op4_quality_rules, compiled from the same table."""
    tests = []
    for r in rules:
        bounds = [f"{r.stat} < {r.low}" if r.low > -math.inf else "", f"{r.stat} > {r.high}" if r.high < math.inf else ""]
        tests.append(f"(n_words >= {r.from_words} AND ({' OR '.join(b for b in bounds if b)}))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, unnest(range(len(ws) - 2)) AS p, unnest(list_transform(range(len(ws) - 2), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) AS k FROM w WHERE len(ws) >= 3),
rep AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, k) >= 2),
cov AS (SELECT r, count(DISTINCT p + d) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
s AS (SELECT w.r, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(x, '!')) AS n_exclaim,
        len(regexp_extract_all(x, '\p{{Lu}}')) AS n_upper, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda v: lower(v) IN ({stop}))) AS n_stop
      FROM w LEFT JOIN cov ON w.r = cov.r),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_exclaim / n_words ELSE 0 END AS exclaim_ratio,
        n_upper / greatest(word_chars, 1) AS upper_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(tests) or 'false'}) AS kept FROM q
"""


OP4_SQL = oracle()
