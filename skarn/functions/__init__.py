"""Column functions over JSON text.  One document is one value of a string (or binary) column.

SQL NULL stands for "no value": a null document, a missing member, a wrong type.  JSON null is the text `null`.  Paths,
pointers and patches given as Python strings are compiled on the driver, so that their errors show when the plan is
made; given as columns they are compiled per value, with a memo in each worker.  Malformed documents raise, except in
json_valid, json_type, the try_ functions and those that say so.

These are the exact functions (Arrow batches, Python).  `skarn.plans.lowering` has plans that stay in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.core import evaluate, patch, pointer, values
from skarn.core.errors import JsonError
from skarn.core.iregexp import Pattern
from skarn.core.jsonpath import compile_path
from skarn.core.parse import parse

_ARROW = {
    "string": pa.string(),
    "boolean": pa.bool_(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "array<string>": pa.list_(pa.string()),
    "array<struct<path:string,value:string>>": pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])),
    "array<struct<key:string,value:string>>": pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])),
    "struct<value:string,rest:string>": pa.struct([("value", pa.string()), ("rest", pa.string())]),
}
_ERROR_ARROW = pa.struct([("kind", pa.string()), ("detail", pa.string()), ("pos", pa.int32())])


def _arrow(kind: str) -> pa.DataType:
    if kind in _ARROW:
        return _ARROW[kind]
    names = [f.name for f in T._parse_datatype_string(kind).fields]
    return pa.struct([(n, _ERROR_ARROW if n == "error" else pa.string() if n in ("doc", "value") else pa.list_(pa.string())) for n in names])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Bytes of a batch that passes from the JVM to Python; by rows alone it would grow with the length of the documents.
BATCH_BYTES = "2m"


def bound_batches(spark: SparkSession | None = None) -> None:
    """Sets the session (or the active one) to pass at most about BATCH_BYTES, or one row, at once to Python.  The setting
    is read when a plan runs, so it stays; one that is set is kept."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def _apply(kind: str, f: Callable, *columns: Column | str, nulls: bool = False) -> Column:
    """f over the values of the columns, by Arrow batches; null where any of them is null, unless f takes nulls."""
    arrow = _arrow(kind)
    bound_batches()

    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays))
        return pa.array([f(*r) if nulls or None not in r else None for r in rows], arrow)

    if len(columns) == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return F.arrow_udf(one, kind)(_col(columns[0]))

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf(two, kind)(*map(_col, columns))


def _error(e: JsonError) -> dict:
    return {"kind": e.kind, "detail": None if e.detail is None else str(e.detail), "pos": e.pos}


# ---- literals, parsing, printing


def json_literal(value: object) -> Column:
    """A document from Python objects."""
    return F.lit(values.compact(json.loads(json.dumps(value), parse_float=float)))


def json_from(column: Column | str) -> Column:
    """A document from a scalar, struct, array or map column."""
    c = _col(column)
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)


def json_parse(doc: Column | str, exact: bool = False) -> Column:
    """The document without blanks; raises if it is malformed."""
    return _apply("string", lambda t: values.compact(parse(t, exact)), doc)


def try_json_parse(doc: Column | str, exact: bool = False) -> Column:
    """struct(value, error): the document without blanks, or kind, detail and byte position of what is wrong."""

    def f(t: str) -> dict:
        try:
            return {"value": values.compact(parse(t, exact)), "error": None}
        except JsonError as e:
            return {"value": None, "error": _error(e)}

    return _apply("struct<value:string,error:struct<kind:string,detail:string,pos:int>>", f, doc)


def json_valid(doc: Column | str, exact: bool = False) -> Column:
    def f(t: str) -> bool:
        try:
            parse(t, exact)
        except JsonError:
            return False
        return True

    return _apply("boolean", f, doc)


def json_compact(doc: Column | str, exact: bool = False) -> Column:
    return json_parse(doc, exact)


def json_pretty(doc: Column | str, exact: bool = False) -> Column:
    return _apply("string", lambda t: values.pretty(parse(t, exact)), doc)


# ---- types and accessors


def _or_null(f: Callable) -> Callable:
    """f of the parsed document; null for a malformed one."""

    def g(t: str) -> object:
        try:
            return f(parse(t))
        except JsonError:
            return None

    return g


def json_type(doc: Column | str) -> Column:
    """object, array, number, string, boolean, null; SQL NULL for a malformed document."""
    return _apply("string", _or_null(values.kind), doc)


def _is(kind: str) -> Callable[[Column | str], Column]:
    def test(doc: Column | str) -> Column:
        return _apply("boolean", _or_null(lambda v: values.kind(v) == kind), doc)

    test.__name__, test.__doc__ = f"json_is_{kind}", f"Whether the document is of type {kind}."
    return test


json_is_object, json_is_array, json_is_number, json_is_string, json_is_boolean, json_is_null = map(_is, values.KINDS)


def json_object_entries(doc: Column | str) -> Column:
    """Members in order, as array of (key, value); null unless an object."""
    f = lambda v: [{"key": k, "value": values.compact(x)} for k, x in v.items()] if isinstance(v, dict) else None
    return _apply("array<struct<key:string,value:string>>", _or_null(f), doc)


def json_array_items(doc: Column | str) -> Column:
    """Elements as texts; null unless an array."""
    return _apply("array<string>", _or_null(lambda v: [values.compact(x) for x in v] if isinstance(v, list) else None), doc)


def json_number(doc: Column | str) -> Column:
    """The number as text; null unless a number."""
    return _apply("string", _or_null(lambda v: values.number_text(v) if values.kind(v) == "number" else None), doc)


def json_long(doc: Column | str) -> Column:
    """A whole number; null for any other value, fractions included: there is no conversion."""
    return _apply("bigint", _or_null(lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None), doc)


def json_double(doc: Column | str) -> Column:
    """A number with a point or exponent; null for any other value, whole numbers included."""
    return _apply("double", _or_null(lambda v: v if isinstance(v, float) else None), doc)


def json_decimal(doc: Column | str, precision: int = 38, scale: int = 10) -> Column:
    """A number of any size, read exactly, as a decimal; null unless a number that fits."""

    def f(t: str) -> str | None:
        try:
            v = parse(t, exact=True)
        except JsonError:
            return None
        return format(v if isinstance(v, Decimal) else Decimal(v), "f") if values.kind(v) == "number" else None

    return _apply("string", f, doc).try_cast(f"decimal({precision},{scale})")


def json_str(doc: Column | str) -> Column:
    """The characters of a string; null for any other value."""
    return _apply("string", _or_null(lambda v: v if isinstance(v, str) else None), doc)


def json_bool(doc: Column | str) -> Column:
    return _apply("boolean", _or_null(lambda v: v if isinstance(v, bool) else None), doc)


def _child(v: object, key: str | int) -> object:
    """The member or element; pointer.MISSING for a wrong container, key or index."""
    if isinstance(key, str):
        return v.get(key, pointer.MISSING) if isinstance(v, dict) else pointer.MISSING
    return v[key] if isinstance(v, list) and 0 <= key < len(v) else pointer.MISSING


def json_get(doc: Column | str, key: str | int) -> Column:
    """A member by name or an element by index, as text; null if it isn't there."""

    def f(v: object) -> str | None:
        x = _child(v, key)
        return None if x is pointer.MISSING else values.compact(x)

    return _apply("string", lambda t: f(parse(t)), doc)


def json_take(doc: Column | str, key: str | int | None = None) -> Column:
    """struct(value, rest): a child (or with no key the whole document) and the document with null in its place."""

    def f(t: str) -> dict:
        v = parse(t)
        if key is None:
            return {"value": values.compact(v), "rest": "null"}
        x = _child(v, key)
        if x is pointer.MISSING:
            return {"value": None, "rest": values.compact(v)}
        v[key] = None
        return {"value": values.compact(x), "rest": values.compact(v)}

    return _apply("struct<value:string,rest:string>", f, doc)


# ---- pointers and paths


def json_pointer(doc: Column | str, ptr: str | Column) -> Column:
    """What a JSON Pointer leads to, as text; null if nothing.  A scalar document has no places, not even ``""``."""

    def f(t: str, p: str) -> str | None:
        x = pointer.resolve(parse(t), p)
        return None if x is pointer.MISSING else values.compact(x)

    if isinstance(ptr, Column):
        return _apply("string", f, doc, ptr)
    pointer.tokens(ptr)
    return _apply("string", lambda t: f(t, ptr), doc)


def try_json_pointer(doc: Column | str, ptr: str | Column) -> Column:
    """struct(value, error) of a JSON Pointer: one that can't index an array, or a malformed document, is an error there."""

    def f(t: str, p: str) -> dict:
        try:
            x = pointer.resolve(parse(t), p)
        except JsonError as e:
            return {"value": None, "error": _error(e)}
        return {"value": None if x is pointer.MISSING else values.compact(x), "error": None}

    kind = "struct<value:string,error:struct<kind:string,detail:string,pos:int>>"
    return _apply(kind, f, doc, ptr) if isinstance(ptr, Column) else _apply(kind, lambda t: f(t, ptr), doc)


def npath_to_pointer(npath: Column | str) -> Column:
    """The JSON Pointer of a normalized path; null if it is not one."""
    return _apply("string", pointer.from_npath, npath)


def _pathwise(kind: str, f: Callable, doc: Column | str, path: str | Column) -> Column:
    if isinstance(path, Column):
        return _apply(kind, lambda t, p: f(parse(t), compile_path(p)), doc, path)
    query = compile_path(path)
    return _apply(kind, lambda t: f(parse(t), query), doc)


def json_select(doc: Column | str, path: str | Column, semantics: str = evaluate.STANDARD) -> Column:
    """The nodes that a JSONPath selects, in order: array of (path, value), values as text."""
    f = lambda v, q: [{"path": p, "value": values.compact(x)} for p, x in evaluate.select(v, q, semantics)]
    return _pathwise("array<struct<path:string,value:string>>", f, doc, path)


def json_select_paths(doc: Column | str, path: str | Column, semantics: str = evaluate.STANDARD) -> Column:
    """The normalized paths of the nodes."""
    return _pathwise("array<string>", lambda v, q: evaluate.select_paths(v, q, semantics), doc, path)


def json_select_values(doc: Column | str, path: str | Column, semantics: str = evaluate.STANDARD) -> Column:
    """The values of the nodes, as text; paths are not even tracked."""
    return _pathwise("array<string>", lambda v, q: list(map(values.compact, evaluate.select_values(v, q, semantics))), doc, path)


def json_select_types(doc: Column | str, path: str | Column, semantics: str = evaluate.STANDARD) -> Column:
    """The kinds of the nodes, as json_type would name them, without printing and parsing their values."""
    return _pathwise("array<string>", lambda v, q: list(map(values.kind, evaluate.select_values(v, q, semantics))), doc, path)


def _error_of(f: Callable) -> Callable:
    def run(text: str) -> dict | None:
        try:
            f(text)
        except JsonError as e:
            return _error(e)
        return None

    return run


_ERROR = "struct<kind:string,detail:string,pos:int>"
_ARROW[_ERROR] = _ERROR_ARROW


def json_path_error(path: Column | str) -> Column:
    """struct(kind, detail, pos) of what is wrong with a JSONPath, types included; null for a good one."""
    return _apply(_ERROR, _error_of(compile_path), path)


def json_regex_error(pattern: Column | str) -> Column:
    """struct(kind, detail, pos) of what is wrong with an I-Regexp; null for a good one."""
    return _apply(_ERROR, _error_of(Pattern), pattern)


def json_select_many(doc: Column | str, paths: dict[str, str], semantics: str = evaluate.STANDARD) -> Column:
    """A struct with the values of several paths; the document is parsed once."""
    queries = {name: compile_path(p) for name, p in paths.items()}
    kind = "struct<" + ",".join(f"`{n}`:array<string>" for n in queries) + ">"

    def f(t: str) -> dict:
        v = parse(t)
        return {n: list(map(values.compact, evaluate.select_values(v, q, semantics))) for n, q in queries.items()}

    return _apply(kind, f, doc)


# ---- changes

_CHANGED = "struct<doc:string,error:struct<kind:string,detail:string,pos:int>>"


def _changed(doc: Column | str, change: str | Column, semantics: str, how: Callable) -> Column:
    strict = semantics == evaluate.REFERENCE

    def f(t: str, p: object) -> dict:
        value, error = how(parse(t), p, strict)
        return {"doc": values.compact(value), "error": _error(error) if error else None}

    if isinstance(change, Column):
        return _apply(_CHANGED, f, doc, change)
    operations = patch.read(change)
    return _apply(_CHANGED, lambda t: f(t, operations), doc)


def json_modify(doc: Column | str, change: str | Column, semantics: str = evaluate.STANDARD) -> Column:
    """struct(doc, error) after a JSON Patch; on an error what came before it stays.  error.pos: the operation's index."""
    return _changed(doc, change, semantics, patch.modify)


def json_try_modify(doc: Column | str, change: str | Column, semantics: str = evaluate.STANDARD) -> Column:
    """struct(doc, error) after a JSON Patch, all or nothing."""
    return _changed(doc, change, semantics, patch.try_modify)


def json_try_modify_values(doc: Column | str, change: str | Column, path: str, semantics: str = evaluate.STANDARD) -> Column:
    """struct(values, error): what a JSONPath selects after a JSON Patch, all or nothing.  The document is parsed once, and
    the changed one is not printed, so this takes half the workers of a json_select_values over json_try_modify."""
    query, strict = compile_path(path), semantics == evaluate.REFERENCE
    kind = f"struct<values:array<string>,error:{_ERROR}>"

    def f(t: str, p: object) -> dict:
        value, error = patch.try_modify(parse(t), p, strict)
        return {"values": list(map(values.compact, evaluate.select_values(value, query, semantics))), "error": _error(error) if error else None}

    if isinstance(change, Column):
        return _apply(kind, f, doc, change)
    operations = patch.read(change)
    return _apply(kind, lambda t: f(t, operations), doc)


# ---- comparison


def json_equals(a: Column | str, b: Column | str, semantics: str = evaluate.STANDARD) -> Column:
    """Deep equality, whatever the order of members."""
    strict = semantics == evaluate.REFERENCE
    return _apply("boolean", lambda x, y: values.equals(parse(x), parse(y), strict), a, b)


def json_compare(a: Column | str, b: Column | str, semantics: str = evaluate.STANDARD) -> Column:
    """-1, 0, 1; null where two values have no order."""
    strict = semantics == evaluate.REFERENCE
    return _apply("int", lambda x, y: values.compare(parse(x), parse(y), strict), a, b)


def json_canonical(doc: Column | str, semantics: str = evaluate.STANDARD) -> Column:
    """Equal documents, equal text: the key to group, join and deduplicate by."""
    strict = semantics == evaluate.REFERENCE
    return _apply("string", lambda t: values.canonical(parse(t), strict), doc)


def json_hash(doc: Column | str, semantics: str = evaluate.STANDARD) -> Column:
    return F.xxhash64(json_canonical(doc, semantics))


# ---- SQL

_SQL_FUNCTIONS: dict[str, tuple[str, Callable]] = {
    "json_parse": ("string", lambda t: values.compact(parse(t))),
    "json_pretty": ("string", lambda t: values.pretty(parse(t))),
    "json_type": ("string", _or_null(values.kind)),
    "json_canonical": ("string", lambda t: values.canonical(parse(t))),
    "npath_to_pointer": ("string", pointer.from_npath),
}


def register(spark) -> None:
    """The functions for SQL: one-document ones, json_pointer(doc, ptr), json_select_values(doc, path) and its kin,
    json_modify(doc, patch), and the table function json_each(doc, path) for LATERAL."""
    bound_batches(spark)

    def unary(kind: str, f: Callable) -> Callable:
        arrow = _arrow(kind)

        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else f(x) for x in a.to_pylist()], arrow)

        return F.arrow_udf(run, kind)

    def binary(kind: str, f: Callable) -> Callable:
        arrow = _arrow(kind)

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], arrow)

        return F.arrow_udf(run, kind)

    def valid(t: str) -> bool:
        try:
            parse(t)
        except JsonError:
            return False
        return True

    def pointed(t: str, p: str) -> str | None:
        x = pointer.resolve(parse(t), p)
        return None if x is pointer.MISSING else values.compact(x)

    def changed(how: Callable) -> Callable:
        def f(t: str, p: str) -> dict:
            value, error = how(parse(t), p)
            return {"doc": values.compact(value), "error": _error(error) if error else None}

        return f

    for name, (kind, f) in _SQL_FUNCTIONS.items():
        spark.udf.register(name, unary(kind, f))
    spark.udf.register("json_valid", unary("boolean", valid))
    spark.udf.register("json_pointer", binary("string", pointed))
    spark.udf.register("json_equals", binary("boolean", lambda x, y: values.equals(parse(x), parse(y))))
    spark.udf.register("json_select_values", binary("array<string>", lambda t, p: list(map(values.compact, evaluate.select_values(parse(t), compile_path(p))))))
    spark.udf.register("json_select_paths", binary("array<string>", lambda t, p: evaluate.select_paths(parse(t), compile_path(p))))
    spark.udf.register("json_select", binary("array<struct<path:string,value:string>>", lambda t, p: [{"path": n, "value": values.compact(v)} for n, v in evaluate.select(parse(t), compile_path(p))]))
    spark.udf.register("json_modify", binary(_CHANGED, changed(patch.modify)))
    spark.udf.register("json_try_modify", binary(_CHANGED, changed(patch.try_modify)))

    @F.udtf(returnType="pos: int, path: string, value: string")
    class JsonEach:
        """A row for each node."""

        def eval(self, doc: str, path: str):
            if doc is not None and path is not None:
                for i, (p, v) in enumerate(evaluate.select(parse(doc), compile_path(path))):
                    yield i, p, values.compact(v)

    spark.udtf.register("json_each", JsonEach)
