"""JSON documents, traces and inventories: project documents with required fields, event logs, and JSON sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("projectName", "language", "files")

TRACE_SCHEMA = (
    "version string, type string, events array<struct<type:string,timestamp:double,thread_id:long,scenario:string,mode:string,source:string,target:string,qualified_name:string,"
    "file:string,line:int,arg_types:map<string,string>,receiver_type:string,return_type:string,exception_type:string,exception_message:string>>"
)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Project documents, one row each, with their file's name; any document that lacks a required field, or whose files are no
    list, fails with its file's name. Each document is judged by its own text, not by the schema that all share."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    kinds = text.select("file", F.get_json_object("value", "$").isNull().alias("bad"), *(F.get_json_object("value", f"$.{c}").alias(c) for c in REQUIRED))
    lost = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)))
    why = F.when(F.col("bad"), "no JSON").when(F.size(lost) > 0, F.concat(F.lit("missing required fields: "), F.array_join(lost, ", "))).when(~F.col("files").startswith("["), "files must be a list")
    wrong = kinds.select("file", why.alias("why")).where("why is not null").orderBy("file").first()
    if wrong:
        raise ValueError(f"{wrong.file}: {wrong.why}")
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_config(spark: SparkSession, path: str) -> dict[str, object]:
    """A pipeline's configuration: one small JSON document as a dictionary (nested objects stay as dictionaries)."""
    import json

    text = spark.read.text(path, wholetext=True).limit(1).first()
    if text is None:
        raise ValueError(f"{path}: no configuration")
    found = json.loads(text.value)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a configuration must be an object")
    return found


def selected_inputs(spark: SparkSession, folder: str, included: tuple[str, ...] = (".json",), excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of the files of a folder whose names have an included ending and no excluded part, sorted by path. Only names
    and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    good = F.lit(False)
    for x in included:
        good = good | F.col("path").endswith(x)
    for x in excluded:
        good = good & ~F.col("path").contains(x)
    return files.where(good).orderBy("path")


def artifact_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, files, bytes) of what a run has left in a folder, by file ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_document(df: DataFrame, path: str) -> None:
    """Each row as a JSON document of its own, one file for each; nulls are kept. For results of a few rows, such as models."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).repartition(max(1, df.count()), F.monotonically_increasing_id()).write.text(path)


def read_trace(spark: SparkSession, path: str, max_events: int = 20_000) -> DataFrame:
    """(trace_id, ord, type, ts, ...) of trace documents, at most max_events per trace; times from epoch seconds."""
    docs = spark.read.schema(TRACE_SCHEMA).option("multiLine", True).json(path).select(F.input_file_name().alias("trace_id"), "events")
    rows = docs.select("trace_id", F.posexplode(F.slice("events", 1, max_events)).alias("ord", "e")).select("trace_id", F.col("ord").cast("long").alias("ord"), "e.*")
    return rows.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long"))).drop("timestamp")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; nulls are kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def schema_findings(df: DataFrame, id_col: str, required: list[str], enums: dict[str, list[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Findings of rows that lack a required value, or hold one outside an enumeration or range."""
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required]
    tests += [F.when(~F.col(c).isin(*values), F.concat(F.lit(f"{c} is not one of the allowed values: "), F.col(c))) for c, values in enums.items()]
    tests += [F.when(~F.col(c).between(low, high), F.lit(f"{c} is out of range")) for c, (low, high) in ranges.items()]
    rows = df.select(F.col(id_col).cast("string").alias("element"), F.explode(F.array_compact(F.array(*tests))).alias("message"))
    return rows.select(F.lit("SCHEMA").alias("rule_id"), F.lit("error").alias("level"), "element", "message")


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of intermediate model documents (JSON, of any source language) as rows of python_source.SCHEMA with module_qn, so that
    `python_source.tables` makes the same fact tables of them as of parsed source. One document is read by one task."""
    from factgraph.sources import python_source

    return python_source.from_documents(spark.read.text(path, wholetext=True))


def project_findings(spark: SparkSession, config: dict[str, object], paths: tuple[str, ...] = ("source",), required: tuple[str, ...] = ("project",)) -> list[tuple[str, str, str]]:
    """(rule, level, message) for a configuration that lacks a required entry or names a folder that is not there."""
    out = [("SETUP-01", "error", f"{key} is required") for key in required if not config.get(key)]
    for key in paths:
        if not config.get(key):
            out.append(("SETUP-02", "warning", f"{key} names no folder"))
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(str(config[key]))
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            out.append(("SETUP-03", "error", f"{key}: {config[key]} does not exist"))
    return out


def document_violations(spark: SparkSession, path: str, schema: dict[str, object]) -> DataFrame:
    """(file, place, message) of documents against a JSON schema: type, required, enum, minimum, maximum, properties, items and local
    $ref, at any depth. A document is judged by one task; nothing of it but its findings leaves it."""
    import json

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches):
        for batch in batches:
            rows = []
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = list(violations(json.loads(value), schema, schema, "$"))
                except ValueError as e:
                    found = [("$", f"no JSON: {e}")]
                rows += [{"file": name, "place": place, "message": message} for place, message in found]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return text.mapInArrow(run, "file string, place string, message string")


_KINDS = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def violations(value: object, schema: dict, root: dict, place: str) -> Iterator[tuple[str, str]]:
    """(place, message) for each part of value that schema does not allow."""
    while "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            target = target[step]
        schema = target
    kinds = schema.get("type")
    if kinds is not None:
        allowed = [kinds] if isinstance(kinds, str) else kinds
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if not any(isinstance(value, _KINDS[k]) and (number or k not in ("integer", "number")) for k in allowed):
            yield place, f"is no {' or '.join(allowed)}"
            return
    if "enum" in schema and value not in schema["enum"]:
        yield place, "is not one of the allowed values"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            yield place, "is out of range"
    if isinstance(value, dict):
        for key in schema.get("required", []):
            if key not in value:
                yield f"{place}.{key}", "is required"
        for key, inner in schema.get("properties", {}).items():
            if key in value:
                yield from violations(value[key], inner, root, f"{place}.{key}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, x in enumerate(value):
            yield from violations(x, schema["items"], root, f"{place}[{k}]")
