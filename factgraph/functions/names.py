"""Scalar functions on names, identifiers, paths and types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endpoint prefixes that safe names keep, and pseudo types that are no types.
PSEUDO_TYPES = [
    "", "None", "NoneType", "Name", "Attribute", "Call", "Constant", "Subscript", "BinOp", "Compare", "BoolOp", "Lambda", "function", "method", "module", "class_attribute", "instance_attribute", "local_variable", "parameter",
    "unknown",
]
TYPE_ALIASES = {"List": "list", "Dict": "dict", "Tuple": "tuple", "Set": "set", "typing.List": "list", "typing.Dict": "dict", "typing.Tuple": "tuple", "typing.Set": "set"}
ENDPOINT_PREFIXES = ("project", "module", "class", "interface", "function", "method", "attribute", "variable", "body", "call", "external")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix: and the first 12 hex digits of the SHA-1 of the parts joined by |; a null part is an empty one."""
    joined = parts[0:1] and F.coalesce(parts[0].cast("string"), F.lit(""))
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), F.coalesce(p.cast("string"), F.lit("")))
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(joined.cast("binary")), 1, 12))


def relationship_id(type_: Column, source: Column, target: Column, metadata: list[tuple[Column, Column]]) -> Column:
    """Edge id. metadata: (value, is present); an absent key is empty, a present null is the text None."""
    parts = [type_, source, target, *(F.when(~has, F.lit("")).otherwise(F.coalesce(v.cast("string"), F.lit("None"))) for v, has in metadata)]
    return stable_id("rel", *parts)


def last_segment(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, -1)


def suffix(c: Column, segments: int, separator: str = ".") -> Column:
    return F.substring_index(c, separator, -segments)


def slug(c: Column) -> Column:
    """Lower case; runs of other than letters and digits become one _; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(c: Column) -> Column:
    """Other than letters, digits, _ and the dots between segments become _."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.]", "_")


def safe_endpoint(c: Column) -> Column:
    """safe_name of what follows a known endpoint prefix."""
    known = F.regexp_extract(c, f"^({'|'.join(ENDPOINT_PREFIXES)}):", 0)
    return F.concat(known, safe_name(F.substr(c, F.length(known) + 1)))


def module_name(project: str, path: Column) -> Column:
    """Dotted module name of a relative .py path; a package's __init__ is the package."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.concat(F.lit(project), F.when(dotted == "__init__", F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(dotted, r"\.__init__$", ""))))


def signature(name: Column, args: Column, keywords: Column) -> Column:
    """name(arg, k=v, **kw); null values are left out."""
    positional = F.transform(F.filter(args, lambda a: a["value"].isNotNull()), lambda a: a["value"])
    named = F.transform(F.filter(keywords, lambda k: k["value"].isNotNull()), lambda k: F.when(k["name"].isNull(), F.concat(F.lit("**"), k["value"])).otherwise(F.concat(k["name"], F.lit("="), k["value"])))
    return F.concat(name, F.lit("("), F.array_join(F.concat(positional, named), ", "), F.lit(")"))


def identifiers(c: Column) -> Column:
    """All identifiers in a piece of expression text, outside string literals, in order."""
    bare = F.regexp_replace(c, r"\"[^\"]*\"|'[^']*'", " ")
    return F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), F.lit(1))


def is_literal(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|True|False|None|\"[^\"]*\"|'[^']*')$"), F.lit(False))


def literal_type(c: Column) -> Column:
    text = F.trim(c)
    return (
        F.when(text.rlike(r"^-?\d+$"), "int").when(text.rlike(r"^-?\d+(\.\d*)?([eE][-+]?\d+)?$"), "float").when(text.isin("True", "False"), "bool")
        .when(text == "None", "NoneType").when(text.rlike("^(\"[^\"]*\"|'[^']*')$"), "str").when(text.rlike(r"^\["), "list").when(text.rlike(r"^\{.*:"), "dict").when(text.rlike(r"^\{"), "set").when(text.rlike(r"^\("), "tuple")
    )


def is_valid_type(c: Column) -> Column:
    """Whether a type mention names a type at all: no null, pseudo type, path or internal kind."""
    return F.coalesce(~c.isin(PSEUDO_TYPES) & ~c.contains(":") & ~c.rlike("^<.*>$"), F.lit(False))


def is_plausible_external(c: Column) -> Column:
    """builtins. or typing. names, Error and Exception suffixes, CamelCase or ALLCAPS last segments."""
    last = last_segment(c)
    return F.coalesce(c.rlike(r"^(builtins|typing)\.") | last.rlike("(Error|Exception)$") | last.rlike("^[A-Z][A-Za-z0-9]*$") | last.rlike("^[A-Z][A-Z0-9_]+$"), F.lit(False))


def receiver_prefix(c: Column) -> Column:
    """Group of an unresolved call: self.*, super.*, its first segment.*, or the bare name."""
    return F.when(c.startswith("self."), "self.*").when(c.startswith("super"), "super.*").when(c.contains("."), F.concat(F.substring_index(c, ".", 1), F.lit(".*"))).otherwise(c)


def visible_name(alias: Column, module: Column, name: Column) -> Column:
    """The name under which an import is seen: alias, else imported name, else the module's first segment."""
    return F.coalesce(alias, name, F.substring_index(module, ".", 1))


def split_arguments(c: Column) -> Column:
    """The parts of a list at commas outside brackets, trimmed, empty ones left out: one fold over the characters, without user code."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch.isin("[", "(", "{", "<"), 1).when(ch.isin("]", ")", "}", ">"), -1).otherwise(0)
        cut = (ch == ",") & (s["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["part"], ch)).alias("part"), F.when(cut, F.array_append(s["done"], s["part"])).otherwise(s["done"]).alias("done"))

    end = F.aggregate(F.split(c, ""), start, step, lambda s: F.array_append(s["done"], s["part"]))
    return F.filter(F.transform(end, lambda x: F.trim(x)), lambda x: x != "")


def normal_type(c: Column) -> Column:
    """A type mention in the common form: id prefixes and quotes off, aliases as builtins at the top and in the arguments."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^['\"]|['\"]$", ""), "^(?:builtin_type|builtin|class_or_external):", "")
    table = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    alias = lambda x: F.coalesce(F.try_element_at(table, x), x)
    head, inside = F.regexp_extract(bare, r"^([A-Za-z_][A-Za-z0-9_.]*)\[", 1), F.regexp_extract(bare, r"^[A-Za-z_][A-Za-z0-9_.]*\[(.*)\]$", 1)
    one = F.transform(split_arguments(inside), alias)
    union = F.array_join(F.transform(F.split(bare, r"\s*\|\s*"), alias), " | ")
    return F.when(bare == "", None).when(bare.contains("|") & ~bare.contains("["), union).when((head != "") & (inside != ""), F.concat(alias(head), F.lit("["), F.array_join(one, ", "), F.lit("]"))).otherwise(alias(bare))


def raw_type(c: Column) -> Column:
    """The type without arguments; of a union the first member."""
    return F.regexp_extract(c, r"^(.*?)(?:\[|\s\|\s|$)", 1)


def type_arguments(c: Column) -> Column:
    inside = F.regexp_extract(c, r"^[^\[]*\[(.*)\]$", 1)
    return F.when(inside != "", split_arguments(inside)).otherwise(F.array().cast("array<string>"))
