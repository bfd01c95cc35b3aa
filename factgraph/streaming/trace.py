"""Runtime evidence from execution traces, as a batch and as a Structured Streaming query with the same results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factgraph.operators import graphs, matching, selection
from factgraph.operators.lineage import cut

EVENT = "trace_id string, ord long, type string, ts timestamp, thread_id long, scenario string, qualified_name string"
EDGE = "trace_id string, thread_id long, ord long, source string, target string"
KINDS = ("call", "return", "exception")


def _contains(part: str) -> Callable[[Column], Column]:
    return lambda name: name.contains(part)


def _starts(prefix: str) -> Callable[[Column], Column]:
    return lambda name: name.startswith(prefix)


def relevant(events: DataFrame, included: list[str], excluded: list[str] = (), columns: tuple[str, ...] = ("qualified_name",)) -> DataFrame:
    """Call, return and exception events that have a name with an included prefix and none with an excluded part or module body."""
    names = F.array_compact(F.array(*columns))
    bad = F.exists(names, lambda n: n.endswith(".<module>"))
    for x in excluded:
        bad = bad | F.exists(names, _contains(x))
    good = F.lit(False)
    for p in included:
        good = good | F.exists(names, _starts(p))
    return events.where(F.col("type").isin(*KINDS) & ~bad & good)


def runtime_edges(events: DataFrame) -> DataFrame:
    """(trace_id, thread_id, ord, source, target): the caller of every call, by window functions (batch)."""
    return graphs.call_pairs(events, ["trace_id", "thread_id"], "ord")


class CallStack(StatefulProcessor):
    """The open calls of one thread, kept between micro-batches; a call's caller is the top of the stack."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._stack = handle.getValueState("stack", "names array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stack = list(self._stack.get()[0]) if self._stack.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("ord").itertuples():
            if r.type == "call":
                if stack:
                    out.append((key[0], key[1], r.ord, stack[-1], r.qualified_name))
                stack.append(r.qualified_name)
            elif r.type == "return" and stack:
                stack.pop()
        self._stack.update((stack,))
        yield pd.DataFrame(out, columns=["trace_id", "thread_id", "ord", "source", "target"])

    def close(self) -> None:
        pass


def streaming_edges(events: DataFrame) -> DataFrame:
    """The same edges from a stream. Events of one thread must arrive in order, as a trace file has them."""
    return events.groupBy("trace_id", "thread_id").transformWithStateInPandas(CallStack(), EDGE, "Append", "None")


def first_seen(edges: DataFrame, late: str | None = None, time: str = "ts") -> DataFrame:
    """Each (source, target, type) once; edges without a type are calls. On a stream the keys are state: with `late` (the event-time
    column `time` must be there) a key is forgotten when the watermark has passed it, so state stays bounded."""
    rows = edges if "type" in edges.columns else edges.withColumn("type", F.lit("calls"))
    keys = ["source", "target", "type"]
    if late is None:
        return rows.select(*keys).dropDuplicates(keys)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys).select(*keys, time)


def capped(events: DataFrame, most: int = 20_000) -> DataFrame:
    """The first `most` events of each trace, by order."""
    return matching.occurrence(events, ["trace_id"], ["ord"]).where(F.col("occurrence") < most).drop("occurrence")


def type_observations(events: DataFrame) -> DataFrame:
    """(qualified_name, what, types): the distinct argument, receiver, return and exception types seen at each function."""
    part = lambda what, c: events.select("qualified_name", F.lit(what).alias("what"), c.alias("t"))
    args = events.select("qualified_name", F.explode("arg_types").alias("name", "t")).select("qualified_name", F.concat(F.lit("argument "), "name").alias("what"), "t")
    rows = args.unionByName(part("receiver", F.col("receiver_type"))).unionByName(part("return", F.col("return_type"))).unionByName(part("exception", F.col("exception_type")))
    return rows.where("qualified_name is not null and t is not null").groupBy("qualified_name", "what").agg(F.array_sort(F.collect_set("t")).alias("types"))


def accumulated(known: DataFrame, scenarios: list[DataFrame]) -> DataFrame:
    """known edges (source, target, type) and the new ones of each scenario (source, target, type, scenario) in turn: an edge belongs to
    the first scenario that shows it."""
    seen = known.select("source", "target", "type", F.lit(None).cast("string").alias("scenario"), F.lit(-1).alias("nth"))
    for k, s in enumerate(scenarios):
        seen = seen.unionByName(s.select("source", "target", "type", "scenario", F.lit(k).alias("nth")))
    return selection.keep_first(seen, ["source", "target", "type"], ["nth", "scenario"]).select("source", "target", "type", "scenario")


def merge_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the edges (source, target, type) of a micro-batch that the table at path lacks. A batch
    that runs again after a failure adds nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("source", "target", "type").distinct()
        try:
            old = spark.read.parquet(path)
        except AnalysisException:  # the first batch: there is no table yet
            old = None
        fresh = new if old is None else new.join(old.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
        cut(fresh).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return put


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per kind and event-time window; windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def enrichment_summary(raw: DataFrame, kept: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """One row: raw, kept and filtered events, distinct runtime edges, and those that no static edge (source, target) has."""
    distinct = first_seen(edges).select("source", "target").distinct()
    new = distinct.join(known.select("source", "target").distinct(), ["source", "target"], "left_anti")
    rows = raw.agg(F.count("*").alias("raw_events")).crossJoin(kept.agg(F.count("*").alias("kept_events"))).crossJoin(distinct.agg(F.count("*").alias("observed_edges"))).crossJoin(new.agg(F.count("*").alias("added_edges")))
    return rows.withColumn("filtered_events", F.col("raw_events") - F.col("kept_events"))
