"""Python source files as code facts: a distributed scan, an error-tolerant parse, and one table per kind of fact.

Files are read by Spark's binary file source and parsed with the standard library's ast inside mapInArrow, one top-level
statement after the other, so the tree of a whole file is never held. A file becomes rows with nested arrays of facts, from which
the tables below are exploded: part 0, and further parts for more than PIECE facts of a kind, so no row grows with its file. Every
fact carries an ordinal, so that first-wins rules never depend on partition order. A file that does not parse yields one row with
parse_error and no facts.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import names

IGNORED = (".git", ".venv", "venv", "env", "__pycache__", "node_modules", "build", "dist", ".mypy_cache", ".pytest_cache")

#: The most facts of a kind in one row of a parsed file.
PIECE = 4096
KINDS = ("imports", "classes", "callables", "parameters", "variables", "calls", "body", "body_calls")

_ARG = "struct<position:int,value:string,argument_kind:string,argument_type:string>"
_KEYWORD = "struct<name:string,value:string,argument_kind:string,argument_type:string>"
SCHEMA = f"""
path string, parse_error string, part int,
imports array<struct<ord:int,import_type:string,module:string,name:string,alias:string,level:int,line:int>>,
classes array<struct<ord:int,name:string,qn:string,bases:array<string>,decorators:array<string>,line_start:int,line_end:int>>,
callables array<struct<ord:int,name:string,qn:string,class_qn:string,kind:string,is_async:boolean,decorators:array<string>,return_annotation:string,line_start:int,line_end:int>>,
parameters array<struct<callable_qn:string,idx:int,name:string,annotation:string,kind:string,default_value:string,line:int>>,
variables array<struct<ord:int,owner_qn:string,scope:string,name:string,full_name:string,annotation:string,assigned_value:string,assigned_type:string,value_kind:string,line:int>>,
calls array<struct<ord:int,callable_qn:string,name:string,kind:string,receiver:string,method:string,function:string,line:int,arguments:array<{_ARG}>,keyword_arguments:array<{_KEYWORD}>>>,
body array<struct<node_id:string,callable_qn:string,parent_id:string,branch:string,ord:int,walk_ord:int,depth:int,type:string,statement_type:string,control_type:string,condition:string,target:string,targets:array<string>,iter:string,value:string,value_kind:string,value_type:string,exception:string,line_start:int,line_end:int>>,
body_calls array<struct<node_id:string,callable_qn:string,role:string,ord:int,walk_ord:int,name:string,line:int>>
"""


def render(node: ast.AST | None) -> str | None:
    """Text of an expression: names, dotted attributes, constants, a subscript's base, a call's callee, comparisons and
    logical expressions; null for everything else."""
    match node:
        case None:
            return None
        case ast.Name():
            return node.id
        case ast.Attribute():
            base = render(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        case ast.Constant():
            return repr(node.value)
        case ast.Subscript():
            return render(node.value)
        case ast.Call():
            return render(node.func)
        case ast.Compare():
            parts = [render(node.left) or "?"]
            for op, right in zip(node.ops, node.comparators, strict=True):
                parts += [_COMPARE.get(type(op).__name__, "?"), render(right) or "?"]
            return " ".join(parts)
        case ast.BoolOp():
            return f" {'and' if isinstance(node.op, ast.And) else 'or'} ".join(render(v) or "?" for v in node.values)
        case ast.UnaryOp():
            inner = render(node.operand)
            return None if inner is None else f"{_UNARY[type(node.op).__name__]}{inner}"
    return None


_COMPARE = {"Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "Is": "is", "IsNot": "is not", "In": "in", "NotIn": "not in"}
_UNARY = {"Not": "not ", "USub": "-", "UAdd": "+", "Invert": "~"}
_COLLECTIONS = {ast.List: "list", ast.Dict: "dict", ast.Tuple: "tuple", ast.Set: "set"}


def assigned_type(node: ast.AST | None) -> str | None:
    """Literal type of a right-hand side; for a call its callee."""
    if isinstance(node, ast.Call):
        return render(node.func)
    if isinstance(node, ast.Constant):
        return type(node.value).__name__
    return next((name for kind, name in _COLLECTIONS.items() if isinstance(node, kind)), None)


def value_kind(node: ast.AST | None) -> str | None:
    match node:
        case None:
            return None
        case ast.Constant():
            return "literal"
        case ast.List() | ast.Dict() | ast.Tuple() | ast.Set():
            return "collection_literal"
        case ast.Call():
            return "call_result"
        case ast.Name():
            return "variable_reference"
        case ast.Attribute():
            return "attribute_reference"
    return "expression"


def argument_kind(node: ast.AST) -> str:
    kinds = {ast.BinOp: "binary_expression", ast.Compare: "comparison_expression", ast.BoolOp: "boolean_expression", ast.UnaryOp: "unary_expression", ast.Lambda: "lambda"}
    return next((name for kind, name in kinds.items() if isinstance(node, kind)), value_kind(node) or "expression")


def method_kind(name: str, decorators: list[str], in_class: bool) -> str:
    last = [d.rpartition(".")[2] for d in decorators]
    if not in_class:
        return "function"
    for test, kind in (
        (name == "__init__", "constructor"), ("staticmethod" in last, "staticmethod"), ("classmethod" in last, "classmethod"), ("property" in last, "property_getter"),
        (any(d.endswith(".setter") for d in decorators), "property_setter"), (any(d.endswith(".deleter") for d in decorators), "property_deleter"), ("abstractmethod" in last, "abstractmethod"),
    ):
        if test:
            return kind
    return "method"


class Extractor:
    """One pass over a module's tree. Ordinals follow the walk, in which a nested definition comes before its parent."""

    def __init__(self, module: str):
        self.module = module
        self.out: dict[str, list[dict]] = {k: [] for k in KINDS}
        self._ord = dict.fromkeys(("imports", "classes", "callables", "variables", "calls"), 0)
        self._walk = self.line = 0

    def add(self, table: str, /, **row) -> None:
        if table in self._ord:
            row["ord"] = self._ord[table]
            self._ord[table] += 1
        self.out[table].append(row)

    def take(self, node: ast.stmt, line: int) -> dict[str, list[dict]]:
        """The facts of the next top-level statement, whose positions count from the given line."""
        self.line = line
        self.statement(node, None, None)
        out, self.out = self.out, {k: [] for k in KINDS}
        return out

    def statement(self, node: ast.AST, cls: str | None, owner: str | None) -> None:
        """Definitions, imports and variables below node; cls and owner are the enclosing class and callable."""
        match node:
            case ast.Import() | ast.ImportFrom():
                self.imports(node)
            case ast.ClassDef():
                qn = f"{self.module}.{node.name}"
                for child in node.body:
                    self.statement(child, qn, None)
                self.add("classes", name=node.name, qn=qn, bases=[b for b in map(render, node.bases) if b], decorators=[d for d in map(render, node.decorator_list) if d], line_start=self.line + node.lineno, line_end=self.line + node.end_lineno)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self.callable(node, cls)
            case ast.Assign() | ast.AnnAssign():
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                for target in targets:
                    self.variable(target, node, cls, owner)
                for child in ast.iter_child_nodes(node):
                    self.statement(child, cls, owner)
            case ast.expr():
                pass  # no statement lies in an expression
            case _:
                for child in ast.iter_child_nodes(node):
                    self.statement(child, cls, owner)

    def imports(self, node: ast.Import | ast.ImportFrom) -> None:
        for a in node.names:
            if isinstance(node, ast.Import):
                self.add("imports", import_type="import", module=a.name, name=None, alias=a.asname, level=0, line=self.line + node.lineno)
            else:
                self.add("imports", import_type="from_import", module=node.module, name=a.name, alias=a.asname, level=node.level, line=self.line + node.lineno)

    def variable(self, target: ast.AST, node: ast.Assign | ast.AnnAssign, cls: str | None, owner: str | None) -> None:
        """Class attribute, instance attribute (self.x, kept on the class) or local; a module's own variables are dropped."""
        if isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self.variable(t, node, cls, owner)
            return
        full = render(target)
        if not full or isinstance(target, ast.Subscript):
            return
        value, note = node.value, render(node.annotation) if isinstance(node, ast.AnnAssign) else None
        common = {"full_name": full, "annotation": note, "assigned_value": render(value), "assigned_type": assigned_type(value), "value_kind": value_kind(value), "line": self.line + node.lineno}
        if full.startswith("self.") and cls:
            self.add("variables", owner_qn=cls, scope="instance_attribute", name=full[5:], **common)
        elif owner and isinstance(target, ast.Name):
            self.add("variables", owner_qn=owner, scope="local", name=full, **common)
        elif cls and not owner and isinstance(target, ast.Name):
            self.add("variables", owner_qn=cls, scope="class_attribute", name=full, **common)

    def callable(self, node: ast.FunctionDef | ast.AsyncFunctionDef, cls: str | None) -> None:
        qn = f"{cls or self.module}.{node.name}"
        decorators = [d for d in map(render, node.decorator_list) if d]
        for child in node.body:
            self.statement(child, cls, qn)
        self.add(
            "callables", name=node.name, qn=qn, class_qn=cls, kind=method_kind(node.name, decorators, cls is not None), is_async=isinstance(node, ast.AsyncFunctionDef),
            decorators=decorators, return_annotation=render(node.returns), line_start=self.line + node.lineno, line_end=self.line + node.end_lineno)
        self.parameters(node.args, qn)
        for call in self.own_calls(node):
            self.call(call, qn)
        for k, child in enumerate(node.body):
            self.body(child, qn, qn, "body", k, 0)

    def parameters(self, args: ast.arguments, qn: str) -> None:
        positional = [*args.posonlyargs, *args.args]
        defaults = [None] * (len(positional) - len(args.defaults)) + list(args.defaults)
        rows = [(a, "positional_only" if k < len(args.posonlyargs) else "positional_or_keyword", d) for k, (a, d) in enumerate(zip(positional, defaults, strict=True))]
        rows += [(args.vararg, "var_positional", None)] if args.vararg else []
        rows += [(a, "keyword_only", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        rows += [(args.kwarg, "var_keyword", None)] if args.kwarg else []
        for idx, (a, kind, default) in enumerate(rows):
            self.add("parameters", callable_qn=qn, idx=idx, name=a.arg, annotation=render(a.annotation), kind=kind, default_value=render(default), line=self.line + a.lineno)

    @staticmethod
    def own_calls(node: ast.AST) -> Iterator[ast.Call]:
        """Calls of a definition in source order, with those of its decorators and defaults, without nested definitions'."""
        stack = list(reversed(list(ast.iter_child_nodes(node))))
        while stack:
            n = stack.pop()
            if isinstance(n, ast.Call):
                yield n
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                continue
            stack += reversed(list(ast.iter_child_nodes(n)))

    def call(self, node: ast.Call, qn: str) -> None:
        name = render(node.func)
        if not name:
            return
        is_method = isinstance(node.func, ast.Attribute)
        self.add(
            "calls", callable_qn=qn, name=name, kind="method_call" if is_method else "function_call", receiver=render(node.func.value) if is_method else None,
            method=node.func.attr if is_method else None, function=None if is_method else name, line=self.line + node.lineno,
            arguments=[{"position": k, "value": render(a), "argument_kind": argument_kind(a), "argument_type": assigned_type(a)} for k, a in enumerate(node.args)],
            keyword_arguments=[{"name": k.arg, "value": render(k.value), "argument_kind": argument_kind(k.value), "argument_type": assigned_type(k.value)} for k in node.keywords],
        )

    def body(self, node: ast.AST, qn: str, parent: str, branch: str, ord_: int, depth: int) -> None:
        kind, statement, control = "statement", None, None
        fields: dict[str, object] = {}
        calls: list[tuple[str, ast.AST | None]] = []
        nested: list[tuple[str, list[ast.stmt]]] = []
        value = None
        match node:
            case ast.If() | ast.While():
                kind, control = "control_structure", "if" if isinstance(node, ast.If) else "while"
                fields["condition"], calls, nested = render(node.test), [("condition", node.test)], [("body", node.body), ("orelse", node.orelse)]
            case ast.For() | ast.AsyncFor():
                kind, control = "control_structure", "for" if isinstance(node, ast.For) else "async_for"
                fields |= {"target": render(node.target), "iter": render(node.iter)}
                calls, nested = [("iter", node.iter)], [("body", node.body), ("orelse", node.orelse)]
            case ast.Try():
                kind, control = "control_structure", "try"
                nested = [("body", node.body), ("orelse", node.orelse), ("finalbody", node.finalbody), ("handlers", node.handlers)]
            case ast.With() | ast.AsyncWith():
                kind, control = "control_structure", "with" if isinstance(node, ast.With) else "async_with"
                fields["targets"] = [render(i.optional_vars) or "" for i in node.items]
                fields["value"] = ", ".join(render(i.context_expr) or "" for i in node.items)
                calls, nested = [("context", i.context_expr) for i in node.items], [("body", node.body)]
            case ast.ExceptHandler():
                kind, fields["exception"], nested = "exception_handler", render(node.type) or "Exception", [("body", node.body)]
                fields["target"] = node.name
            case ast.Return():
                statement, value, calls = "return", node.value, [("value", node.value)]
            case ast.Raise():
                statement, fields["exception"], calls = "raise", render(node.exc), [("exception", node.exc)]
            case ast.Break() | ast.Continue() | ast.Pass():
                statement = type(node).__name__.lower()
            case ast.Expr():
                statement, value, calls = "expression", node.value, [("value", node.value)]
            case ast.Assign():
                statement, value, calls = "assignment", node.value, [("value", node.value)]
                fields["targets"] = [t for t in map(render, node.targets) if t]
                fields["target"] = fields["targets"][0] if fields["targets"] else None
            case ast.AnnAssign():
                statement, value, calls = "annotated_assignment", node.value, [("value", node.value)]
                fields |= {"target": render(node.target), "targets": [t for t in [render(node.target)] if t]}
            case _:
                statement = "unknown"
        if value is not None:
            fields |= {"value": render(value), "value_kind": value_kind(value), "value_type": assigned_type(value)}
        label = statement or control or kind
        node_id = "body:" + hashlib.sha1(f"{parent}|{label}|{self.line + node.lineno}|{ord_}".encode()).hexdigest()[:12]
        row = dict.fromkeys(("condition", "target", "targets", "iter", "value", "value_kind", "value_type", "exception")) | fields
        self.add("body", node_id=node_id, callable_qn=qn, parent_id=parent, branch=branch, ord=ord_, walk_ord=self._walk, depth=depth, type=kind, statement_type=statement, control_type=control, line_start=self.line + node.lineno, line_end=self.line + node.end_lineno, **row)
        self._walk += 1
        for role, expression in calls:
            found = [n for n in ast.walk(expression) if isinstance(n, ast.Call)] if expression is not None else []
            for k, n in enumerate(found):
                self.add("body_calls", node_id=node_id, callable_qn=qn, role=role, ord=k, walk_ord=self._walk, name=render(n.func), line=self.line + n.lineno)
                self._walk += 1
        for name, part in nested:
            for k, child in enumerate(part):
                self.body(child, qn, node_id, name, k, depth + 1)


#: A line that may begin a top-level statement: it is not indented, no comment, and no further branch of a statement.
_BEGIN = re.compile(r"^(?![ \t\f\r\n#)\]}]|(?:else|elif|except|finally)\b)", re.M)


def statements(text: str) -> Iterator[tuple[ast.stmt, int]]:
    """The top-level statements of ast.parse(text), one at a time, each with the number of lines to add to its positions.

    Text is cut where a line may begin a statement and all before it parses; a piece that does not is longer than it seems (a string
    over lines, a decorator) and takes the next one in, twice as many each time, until all is one piece, whose error is the file's."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    cuts = sorted({0, *(m.start() for m in _BEGIN.finditer(text)), len(text)})
    a, many, line = 0, 1, 0
    while a < len(cuts) - 1:
        b = min(a + many, len(cuts) - 1)
        piece = text[cuts[a] : cuts[b]]
        try:
            body = ast.parse(piece).body
        except SyntaxError:
            if a == 0 and b == len(cuts) - 1:
                raise
            if b == len(cuts) - 1:  # the error is the whole text's, or it lies in the cuts: both are seen in the whole
                done = len(ast.parse(text[: cuts[a]]).body)
                yield from ((node, 0) for node in ast.parse(text).body[done:])
                return
            many *= 2
            continue
        yield from ((node, line) for node in body)
        line += piece.count("\n")
        a, many = b, 1


def pieces(row: dict) -> Iterator[dict]:
    """row (SCHEMA without part) as one row or more, none with more than PIECE facts of a kind."""
    for k in range(max(1, *(-(-len(row[kind]) // PIECE) for kind in KINDS))):
        yield row | {"part": k} | {kind: row[kind][k * PIECE : (k + 1) * PIECE] for kind in KINDS}


def parse(path: str, module: str, content: bytes, schema: pa.Schema) -> list[pa.RecordBatch]:
    """The rows of one file as Arrow batches: part 0 comes first. What is found is held as Arrow until all of the file has parsed."""
    extractor, part, out = Extractor(module), 0, []
    held: dict[str, list[dict]] = {k: [] for k in KINDS}

    def put(rows: dict[str, list[dict]]) -> None:
        nonlocal part
        for row in pieces({"path": path, "parse_error": None} | rows):
            out.append(pa.RecordBatch.from_pylist([row | {"part": part}], schema=schema))
            part += 1

    try:
        for node, line in statements(content.decode("utf-8")):
            for k, rows in extractor.take(node, line).items():
                held[k] += rows
            if max(map(len, held.values())) >= PIECE:
                put(held)
                held = {k: [] for k in KINDS}
        if part == 0 or any(held.values()):
            put(held)
    except (SyntaxError, UnicodeDecodeError, ValueError, RecursionError) as e:
        failed = {"path": path, "parse_error": f"{type(e).__name__}: {e}", "part": 0} | {k: [] for k in KINDS}
        return [pa.RecordBatch.from_pylist([failed], schema=schema)]
    return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the .py files under root whose relative path has no ignored folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    relative = F.regexp_replace("path", f"^(?:[a-z]+:/*)?/?{base.lstrip('/')}/", "")
    ignored = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED) + ")/"
    return files.select(relative.alias("path"), "content").where(~F.col("path").rlike(ignored))


def parsed(files: DataFrame, project: str) -> DataFrame:
    """SCHEMA and the module's name for files (path, content): one row for each part of a file."""
    rows = files.select("path", names.module_name(project, F.col("path")).alias("module_qn"), "content")
    schema = rows.sparkSession.createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield from parse(*(c[k].as_py() for c in batch.columns), arrow)

    out = rows.mapInArrow(run, schema)
    return out.withColumn("module_qn", names.module_name(project, F.col("path")))


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """Fact tables of parsed files: module, import_fact, class_fact, callable_fact, parameter, variable, call_fact, body_node, body_call."""
    fine = files.where("parse_error is null")
    module_id = F.concat(F.lit("module:"), "module_qn")

    def rows(column: str) -> DataFrame:
        return fine.select(module_id.alias("module_id"), F.explode(column).alias("r")).select("module_id", "r.*")

    kind = lambda c: F.when(F.col("class_qn").isNotNull(), F.concat(F.lit("method:"), c)).otherwise(F.concat(F.lit("function:"), c))
    callables = rows("callables").withColumn("callable_id", kind(F.col("qn"))).withColumn("class_id", F.concat(F.lit("class:"), "class_qn")).drop("class_qn")
    key = fine.select(F.explode("callables").alias("r")).select(F.col("r.qn").alias("callable_qn"), F.col("r.class_qn").alias("class_qn")).distinct()
    key = key.select("callable_qn", kind(F.col("callable_qn")).alias("callable_id"))
    own = lambda column: rows(column).join(key, "callable_qn")
    variables = rows("variables").withColumn("owner_id", F.when(F.col("scope") == "local", F.col("owner_qn")).otherwise(F.concat(F.lit("class:"), "owner_qn")))
    return {
        "module": files.where("part = 0").select(module_id.alias("module_id"), names.last_segment(F.col("module_qn")).alias("name"), F.col("module_qn").alias("qn"), "path", F.col("path").endswith("__init__.py").alias("is_init"), "parse_error"),
        "import_fact": rows("imports"),
        "class_fact": rows("classes").withColumn("class_id", F.concat(F.lit("class:"), "qn")),
        "callable_fact": callables,
        "parameter": own("parameters"),
        "variable": variables,
        "call_fact": own("calls"),
        "body_node": own("body"),
        "body_call": own("body_calls"),
    }


def _pick(row: dict, *keys: str):
    """The first value that is there, for documents of extractors that name the same thing differently."""
    return next((row[k] for k in keys if row.get(k) not in (None, "")), None)


def document_rows(document: dict) -> Iterator[dict]:
    """Rows of SCHEMA for the files of one intermediate model document: nested classes, callables and bodies are walked in order."""
    for f in document.get("files") or []:
        qn = _pick(f, "qualified_name", "qualifiedName", "name") or ""
        row: dict = {"path": _pick(f, "path", "name"), "module_qn": qn, "parse_error": _pick(f, "error")} | {k: [] for k in KINDS}
        walk = [0]

        def add(table: str, row=row, **fields: object) -> None:
            row[table].append({"ord": len(row[table])} | fields)

        for i in f.get("imports") or []:
            add("imports", import_type=_pick(i, "import_type", "type") or "import", module=_pick(i, "module", "name"), name=i.get("name") if i.get("import_type") == "from_import" else None, alias=i.get("alias"), level=i.get("level") or 0, line=i.get("line"))

        def body(nodes, owner: str, parent: str, branch: str, depth: int, add=add, walk=walk) -> None:
            for k, n in enumerate(nodes or []):
                id_ = _pick(n, "id") or f"body:{hashlib.sha1(f'{parent}|{branch}|{k}'.encode()).hexdigest()[:12]}"
                value, targets = n.get("value"), n.get("targets") or [x for x in [n.get("target")] if x]
                kind = n.get("value_kind") or (None if value is None else "literal" if str(value) in ("True", "False", "None") or str(value)[:1] in "0123456789'\"" else "expression")
                fields = {k2: n.get(k2) for k2 in ("condition", "target", "iter", "exception", "statement_type", "control_type", "line_start", "line_end", "value_type")}
                add("body", node_id=id_, callable_qn=owner, parent_id=parent, branch=branch, walk_ord=walk[0], depth=depth, type=_pick(n, "type") or "statement", value=value, value_kind=kind, targets=targets, **fields | {"ord": k})
                walk[0] += 1
                for key, value2 in n.items():
                    if key.endswith("_calls") and isinstance(value2, list):
                        for j, c in enumerate(value2):
                            add("body_calls", node_id=id_, callable_qn=owner, role=key[:-6], walk_ord=walk[0], name=c.get("name") if isinstance(c, dict) else str(c), line=c.get("line") if isinstance(c, dict) else n.get("line_start"), **{"ord": j})
                            walk[0] += 1
                for key in ("body", "orelse", "finalbody", "handlers"):
                    body(n.get(key), owner, id_, key, depth + 1)

        def callable_(c: dict, cls: str | None, qn=qn, add=add) -> None:
            own = _pick(c, "qualified_name", "qualifiedName") or f"{cls or qn}.{c.get('name')}"
            add("callables", name=c.get("name"), qn=own, class_qn=cls, kind=_pick(c, "method_kind", "kind", "type") or ("method" if cls else "function"), is_async=bool(c.get("is_async")), decorators=[str(x) for x in c.get("decorators") or c.get("annotations") or []], return_annotation=_pick(c, "return_annotation", "returnType"), line_start=_pick(c, "line_start", "lineStart"), line_end=_pick(c, "line_end", "lineEnd"))
            for k, p in enumerate(c.get("parameters") or []):
                p = p if isinstance(p, dict) else {"name": str(p)}
                add("parameters", callable_qn=own, idx=k, name=p.get("name"), annotation=_pick(p, "annotation", "type"), kind=p.get("kind") or "positional_or_keyword", default_value=_pick(p, "default_value", "default"), line=p.get("line"))
            for v in c.get("local_variables") or []:
                variable(v, own, "local")
            for x in c.get("calls") or []:
                name = str(x.get("name") or "")
                add("calls", callable_qn=own, name=name, kind=x.get("kind") or ("method_call" if "." in name else "function_call"), receiver=x.get("receiver") or (name.rpartition(".")[0] or None), method=x.get("method") or (name.rpartition(".")[2] if "." in name else None), function=x.get("function") or (None if "." in name else name), line=x.get("line"), arguments=[], keyword_arguments=[])
            body(c.get("body"), own, own, "body", 0)

        def variable(v: dict, owner: str, scope: str, add=add) -> None:
            add("variables", owner_qn=owner, scope=scope, name=v.get("name"), full_name=_pick(v, "full_name", "fullName", "name"), annotation=_pick(v, "annotation", "type"), assigned_value=v.get("assigned_value"), assigned_type=v.get("assigned_type"), value_kind=v.get("value_kind"), line=_pick(v, "line", "lineStart"))

        for c in f.get("classes") or []:
            own = _pick(c, "qualified_name", "qualifiedName") or f"{qn}.{c.get('name')}"
            bases = [str(b) for key in ("bases", "extendsTypes", "implementsTypes") for b in c.get(key) or []]
            add("classes", name=c.get("name"), qn=own, bases=list(dict.fromkeys(bases)), decorators=[str(x) for x in c.get("decorators") or c.get("annotations") or []], line_start=_pick(c, "line_start", "lineStart"), line_end=_pick(c, "line_end", "lineEnd"))
            for key, scope in (("attributes", "class_attribute"), ("fields", "class_attribute"), ("instance_attributes", "instance_attribute")):
                for v in c.get(key) or []:
                    variable(v, own, scope)
            for m in [*(c.get("constructors") or []), *(c.get("methods") or [])]:
                callable_(m, own)
        for c in f.get("functions") or []:
            callable_(c, None)
        yield row


def from_documents(text: DataFrame) -> DataFrame:
    """Rows of SCHEMA with module_qn for documents (value: JSON text). Text that is no JSON object fails with its beginning."""
    import json

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = text.sparkSession.createDataFrame([], SCHEMA + ", module_qn string").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                document = json.loads(value)
                if not isinstance(document, dict):
                    raise ValueError(f"not a project document: {value[:60]!r}")
                for row in document_rows(document):
                    for piece in pieces(row):
                        yield pa.RecordBatch.from_pylist([piece], schema=arrow)

    return text.select("value").mapInArrow(run, schema)
