"""Per-file code facts (B1-B7): one ``mapInArrow`` job over the corpus, then Spark expressions.

The Python worker only turns each source into flat syntax rows: imports, classes and
functions, each with its line, the row it stands in, and the dotted names around it (bases,
decorators, assigned names, called constructors). What counts as a model, an endpoint or a
plain function is decided by the expressions below, on the JVM side. A file that fails to parse
yields ``parsed = false`` and empty arrays; a task never fails on one bad file. Bytes are
decoded with ``errors="ignore"`` (Spark's own ``decode`` raises on malformed input).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DECORATOR = "struct<name:string,called:boolean,first:string,methods:array<string>>"
SYNTAX_SCHEMA = (
    "repo_id string, path string, parsed boolean, rows array<struct<id:int,within:int,kind:string,name:string,line:int,"
    f"names:array<string>,calls:array<string>,fields:array<string>,decorators:array<{_DECORATOR}>,members:array<struct<kind:string,name:string>>>>"
)
#: the same rows one by one, as a table function returns them
ROW_SCHEMA = ("kind string, name string, line int, names array<string>, calls array<string>, fields array<string>, "
              f"decorators array<{_DECORATOR}>")

# FIXED VALUES: decorator words that mark an endpoint, words that name its method, model base
# names and suffixes, field-constructor words, first arguments of methods.
ENDPOINT_WORDS = ["route", "get", "post", "put", "delete", "patch"]
METHOD_WORDS = ["post", "put", "delete", "patch"]
MODEL_BASES = ["Base", "Model", "SQLModel", "models.Model", "declarative_base"]
MODEL_BASE_SUFFIXES = [".Model", ".SQLModel", ".Base"]
FIELD_CALL_WORDS = ["Column", "Field", "ForeignKey", "relationship"]
SELF_WORDS = ["self", "cls"]


def _dotted(node: ast.AST) -> str:
    """The dotted name of a chain of attributes; what is not a name at its root is empty."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "", *parts]) if parts or isinstance(node, ast.Name) else ""


def _decorator(node: ast.expr) -> dict:
    called = isinstance(node, ast.Call)
    row = {"name": _dotted(node.func if called else node), "called": called, "first": None, "methods": []}
    if called and node.args and isinstance(node.args[0], ast.Constant):
        row["first"] = str(node.args[0].value)
    lists = [k.value for k in node.keywords if k.arg == "methods"] if called else []
    row["methods"] = [str(x.value) for v in lists if isinstance(v, ast.List) for x in v.elts if isinstance(x, ast.Constant)]
    return row


def _class_row(node: ast.ClassDef) -> dict:
    assigned = [s for s in node.body if isinstance(s, ast.Assign)]
    targets = [t for s in node.body for t in (s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else [])]
    return {"kind": "class", "name": node.name, "names": [_dotted(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))],
            "calls": [_dotted(s.value.func) for s in assigned if isinstance(s.value, ast.Call)],
            "fields": [t.id for t in targets if isinstance(t, ast.Name)]}


def _function_row(node) -> dict:
    kind = "async" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return {"kind": kind, "name": node.name, "names": [a.arg for a in node.args.args], "decorators": [_decorator(d) for d in node.decorator_list]}


def _rows_of(node: ast.AST) -> list[dict]:
    if isinstance(node, ast.ClassDef):
        return [_class_row(node)]
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return [_function_row(node)]
    if isinstance(node, ast.Import):
        return [{"kind": "import", "name": a.name} for a in node.names]
    if isinstance(node, ast.ImportFrom) and node.module:
        return [{"kind": "import", "name": node.module}]
    return []


def syntax_rows(text: str) -> list[dict] | None:
    """Flat rows of one source in source order; None if it does not parse. Walks without recursion."""
    try:
        todo: list[tuple[ast.AST, int]] = [(ast.parse(text), -1)]
    except Exception:  # noqa: BLE001 - any parse failure is a fact, not an error
        return None
    rows: list[dict] = []
    while todo:
        node, within = todo.pop()
        for row in _rows_of(node):
            rows.append({"id": len(rows), "within": within, "line": node.lineno, "calls": [], "fields": [], "names": [], "decorators": [], "members": []} | row)
            if within >= 0:
                rows[within]["members"].append({"kind": row["kind"], "name": row["name"]})
        # only what stands directly in a class body is within the class
        scope = isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))
        inner = len(rows) - 1 if scope else -1
        todo += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return rows


_WORDS = pa.list_(pa.string())
_DECORATORS = pa.list_(pa.struct([("name", pa.string()), ("called", pa.bool_()), ("first", pa.string()), ("methods", _WORDS)]))
_ROWS = pa.list_(pa.struct([
    ("id", pa.int32()), ("within", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("names", _WORDS),
    ("calls", _WORDS), ("fields", _WORDS), ("decorators", _DECORATORS), ("members", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string())])))]))
_SYNTAX = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("parsed", pa.bool_()), ("rows", _ROWS)])

#: files parsed for one batch of results; a worker holds the rows and texts of so many at a time
PARSED_AT_ONCE = 256


def _syntax_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PARSED_AT_ONCE):
            some = batch.slice(start, PARSED_AT_ONCE)
            raw = (c.as_py() for c in some.column("content"))
            found = [syntax_rows(c.decode("utf-8", errors="ignore") if isinstance(c, bytes) else c or "") for c in raw]
            yield pa.RecordBatch.from_arrays(
                [some.column("repo_id").cast(pa.string()), some.column("path").cast(pa.string()), pa.array([r is not None for r in found], pa.bool_()),
                 pa.array([r or [] for r in found], _ROWS)], schema=_SYNTAX)


def _any_of(words: list[str], test) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(F.lit(w))
    return out


def _is_endpoint(d: Column) -> Column:
    """A called decorator whose dotted name holds an endpoint word."""
    return d["called"] & _any_of(ENDPOINT_WORDS, d["name"].contains)


def _method(d: Column) -> Column:
    """By the decorator's name, else by the methods= list of a route, else GET."""
    low, out = F.lower(d["name"]), F.when(F.lit(False), F.lit(""))
    for w in METHOD_WORDS:
        out = out.when(low.contains(w), F.lit(w.upper()))
    return out.when(low.contains("route") & (F.size(d["methods"]) > 0), F.upper(F.array_join(d["methods"], ","))).otherwise(F.lit("GET"))


def _is_model(c: Column) -> Column:
    """B2: by a base's name or by a constructor called in the body."""
    base = F.exists(c["names"], lambda b: b.isin(MODEL_BASES) | _any_of(MODEL_BASE_SUFFIXES, b.endswith))
    return base | F.exists(c["calls"], lambda n: _any_of(FIELD_CALL_WORDS, n.contains))


def _endpoints_of(f: Column) -> Column:
    return F.transform(F.filter(f["decorators"], _is_endpoint), lambda d: F.struct(
        F.coalesce(d["first"], F.lit("/")).alias("path"), _method(d).alias("method"), f["name"].alias("handler"), f["line"].alias("line")))


def code_facts(corpus: DataFrame, content: str = "content", python_only: bool = True,
               include_async: bool = False) -> DataFrame:
    """B-job: (repo_id, path, content) -> one row per Python file with nested facts.

    Only the three needed columns enter the Python worker; Arrow moves them in batches.
    ``include_async`` also reads ``async def`` functions and endpoints (skipped by default).
    """
    src = corpus.select("repo_id", "path", F.col(content).alias("content"))
    if python_only:
        src = src.where(F.col("path").endswith(".py"))
    rows = F.col("rows")
    defs = ["def", "async"] if include_async else ["def"]
    of = lambda *kinds: F.filter(rows, lambda r: r["kind"].isin(*kinds))
    classes = F.transform(of("class"), lambda c: F.struct(  # B1
        c["name"].alias("name"), F.transform(c["names"], lambda b: F.element_at(F.split(b, r"\."), -1)).alias("bases"),
        F.transform(F.filter(c["members"], lambda r: r["kind"].isin(*defs)), lambda r: r["name"]).alias("methods"),
        c["line"].alias("line")))
    plain = F.filter(of(*defs), lambda f: ~F.coalesce(F.get(f["names"], F.lit(0)).isin(SELF_WORDS), F.lit(False))  # B3
                     & ~F.exists(f["decorators"], _is_endpoint))
    return src.mapInArrow(_syntax_batches, SYNTAX_SCHEMA).select(
        "repo_id", "path", "parsed",
        F.transform(of("import"), lambda i: F.struct(F.split(i["name"], r"\.")[0].alias("module"), i["name"].alias("name"),  # B5
                                                     i["line"].alias("line"))).alias("imports"),
        classes.alias("classes"),
        F.transform(plain, lambda f: F.struct(f["name"].alias("name"), f["names"].alias("args"), f["line"].alias("line"))).alias("functions"),
        F.flatten(F.transform(of(*defs), _endpoints_of)).alias("endpoints"),
        F.transform(F.filter(of("class"), _is_model), lambda c: F.struct(c["name"].alias("name"), c["fields"].alias("fields"),
                                                                         c["line"].alias("line"))).alias("models"))


class SyntaxRows:
    """Table function: the syntax rows of one source, none if it does not parse."""

    def eval(self, content):
        text = bytes(content).decode("utf-8", errors="ignore") if isinstance(content, (bytes, bytearray)) else content or ""
        for r in syntax_rows(text) or []:
            decorators = [(d["name"], d["called"], d["first"], d["methods"]) for d in r["decorators"]]
            yield r["kind"], r["name"], r["line"], r["names"], r["calls"], r["fields"], decorators


def fact_rows(corpus: DataFrame, content: str = "content") -> DataFrame:
    """B1-B5 as one long table -> (repo_id, path, kind, name, line, items), one row for each fact.

    A Python table function yields a file's syntax rows, laterally joined to its file, so no file's facts
    are ever one nested row; what each row is (an import, a class, a model, a plain function, endpoints) is decided by
    expressions. Items: an import's module, a class's bases, a model's fields, a function's arguments, an
    endpoint's path and method.
    """
    syntax = F.udtf(SyntaxRows, returnType=ROW_SCHEMA)
    src = corpus.where(F.col("path").endswith(".py")).select("repo_id", "path", F.col(content).alias("content"))
    rows = src.lateralJoin(syntax(F.col("content").outer())).drop("content")
    row = F.struct("kind", "name", "line", "names", "calls", "fields", "decorators")
    fact = lambda kind, items, line=F.col("line"): F.struct(F.lit(kind).alias("kind"), F.col("name").alias("name"), line.alias("line"), items.alias("items"))
    kind, ends = F.col("kind"), _endpoints_of(row)
    bases = F.transform("names", lambda b: F.element_at(F.split(b, r"\."), -1))
    none = F.array().cast("array<struct<kind:string,name:string,line:int,items:array<string>>>")
    plain = ~F.coalesce(F.get("names", F.lit(0)).isin(SELF_WORDS), F.lit(False)) & (F.size(ends) == 0)
    found = (F.when(kind == "import", F.array(fact("import", F.slice(F.split("name", r"\."), 1, 1))))
             .when(kind == "class", F.concat(F.array(fact("class", bases)), F.when(_is_model(row), F.array(fact("model", F.col("fields")))).otherwise(none)))
             .when(kind == "def", F.concat(F.when(plain, F.array(fact("function", F.col("names")))).otherwise(none), F.transform(
                 ends, lambda e: F.struct(F.lit("endpoint").alias("kind"), e["handler"].alias("name"), e["line"].alias("line"), F.array(e["path"], e["method"]).alias("items"))))))
    return rows.select("repo_id", "path", F.explode(found).alias("f")).select("repo_id", "path", "f.*")


def explode_facts(facts: DataFrame, what: str) -> DataFrame:
    """Child table of ``code_facts``: one row per class / function / endpoint / model / import."""
    return facts.select("repo_id", "path", F.explode(what).alias("f")).select("repo_id", "path", "f.*")


def routes(facts: DataFrame) -> DataFrame:
    """(repo_id, path, route, method, handler = 'path:function')."""
    e = facts.select("repo_id", "path", F.explode("endpoints").alias("e"))
    return e.select("repo_id", "path", F.col("e.path").alias("route"), F.col("e.method").alias("method"),
                    F.concat_ws(":", F.col("path"), F.col("e.handler")).alias("handler"))
