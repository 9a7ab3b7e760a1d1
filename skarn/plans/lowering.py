"""JSONPath as Catalyst expressions over variants: no Python at run time, inside whole-stage code generation.

`native_values` gives array<variant> (and `native_first` one variant) for constant paths of child segments: names,
indices, slices, wildcards, and filters with comparisons against literals, order comparisons between singular queries,
logic, existence, length, count, value, and constant patterns.  What it can't express raises `NotNative`;
`select_values` then takes the exact evaluator.

It reads with try_parse_json, which is laxer than the exact parser (trailing text, no limits): use it on documents known
to be well-formed, or filter by json_valid first.  Variants keep no order of members, so a wildcard or filter over an
object's members gives them in order of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.core.iregexp import compiled
from skarn.core.jsonpath import And, Compare, Expr, Function, Index, Literal, Name, Not, Or, Query, Selector, Slice, Wildcard, compile_path
from skarn.functions import json_select_values


class NotNative(ValueError):
    """A path that needs the exact evaluator."""


def _step(key: str) -> str:
    if "'" not in key:
        return f"$['{key}']"
    if '"' in key:
        raise NotNative(f"a member name with both quotes: {key!r}")
    return f'$["{key}"]'


def _array(v: Column) -> Column:
    """The elements of an array, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _children(v: Column) -> Column:
    return F.coalesce(_array(v), F.map_values(_members(v)), F.array().cast("array<variant>"))


def _one(v: Column, s: Selector) -> Column | None:
    """The value that a singular selector leads to, or null; None for other selectors."""
    if isinstance(s, Name):
        return F.try_variant_get(v, _step(s.key), "variant")
    if isinstance(s, Index):
        if s.at >= 0:
            return F.try_variant_get(v, f"$[{s.at}]", "variant")
        return F.try_element_at(_array(v), F.lit(s.at))
    return None


def _many(v: Column, s: Selector, root: Column) -> Column:
    """The values that a selector leads to, as an array."""
    one = _one(v, s)
    if one is not None:
        return F.filter(F.array(one), lambda x: x.isNotNull())
    if isinstance(s, Wildcard):
        return _children(v)
    if isinstance(s, Slice):
        return _slice(v, s)
    return F.filter(_children(v), lambda x: _test(s.test, x, root))


def _slice(v: Column, s: Slice) -> Column:
    a, none = _array(v), F.array().cast("array<variant>")
    if not s.step:
        return none
    if s.step == 1 and s.start is None and s.end is None:
        return F.coalesce(a, none)
    n = F.size(a)

    def edge(at: int | None, default: Column) -> Column:
        if at is None:
            return default
        at_n = F.lit(at) if at >= 0 else n + at
        low, high = (F.lit(0), n) if s.step > 0 else (F.lit(-1), n - 1)
        return F.greatest(low, F.least(high, at_n))

    start = edge(s.start, F.lit(0) if s.step > 0 else n - 1)
    end = edge(s.end, n if s.step > 0 else F.lit(-1))
    last = end - 1 if s.step > 0 else end + 1
    some = start < end if s.step > 0 else start > end
    picked = F.transform(F.sequence(start, last, F.lit(s.step)), lambda i: F.get(a, i))
    return F.when(a.isNotNull() & some, picked).otherwise(none)


def _query(q: Query, current: Column, root: Column) -> Column:
    """A query's nodes; a singular one gives a variant or null, others an array."""
    v = root if q.absolute else current
    if q.singular:
        for s in q.segments:
            v = _one(v, s.selectors[0])
        return v
    if any(s.descendant for s in q.segments):
        raise NotNative("a descendant segment")
    nodes = F.array(v)
    for s in q.segments:
        nodes = F.flatten(F.transform(nodes, _selected(s.selectors, root)))
    return nodes


def _selected(selectors: tuple[Selector, ...], root: Column) -> Callable[[Column], Column]:
    return lambda x: F.concat(*(_many(x, s, root) for s in selectors))


def _kind(v: Column) -> Column:
    """B, S, V (null), A, O or N, from the variant's schema; null for no value."""
    schema = F.schema_of_variant(v)
    return F.when(schema.startswith("ARRAY"), "A").when(schema.startswith("OBJECT"), "O").when(schema == "STRING", "S").when(schema == "BOOLEAN", "B").when(schema == "VOID", "V").when(v.isNotNull(), "N")


_OPS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _holds(test: Column, kind: Column) -> Column:
    """Both; the kind, which costs more, is asked for only where the test holds."""
    return _false(F.when(test, kind))


def _compare(op: str, left: object, right: object, x: Column, root: Column) -> Column:
    if isinstance(left, Literal) and isinstance(right, Literal):
        from skarn.core.evaluate import Evaluator

        return F.lit(Evaluator(None).compare(op, left.value, right.value))
    if isinstance(left, Literal):
        return _compare({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), right, left, x, root)
    if isinstance(left, Function) and left.name in ("length", "count"):
        if not isinstance(right, Literal):
            raise NotNative("a function against something that varies")
        value = _number_of(left, x, root)
        if isinstance(right.value, (int, float)) and not isinstance(right.value, bool):
            return F.coalesce(getattr(value.cast("double"), _OPS[op])(F.lit(float(right.value))), F.lit(op == "!="))
        return F.lit(op == "!=")
    v = _value(left, x, root)
    if isinstance(right, Literal):
        return _against(op, v, right.value)
    if op not in ("<", ">"):
        raise NotNative("equality of two things that vary")
    w = _value(right, x, root)
    a, b = _kind(v), _kind(w)
    number = getattr(F.try_variant_get(v, "$", "double"), _OPS[op])(F.try_variant_get(w, "$", "double"))
    text = getattr(F.try_variant_get(v, "$", "string"), _OPS[op])(F.try_variant_get(w, "$", "string"))
    return _false(F.when((a == "N") & (b == "N"), number).when((a == "S") & (b == "S"), text))


def _against(op: str, v: Column, value: object) -> Column:
    """A value, or null for none, against a literal."""
    k = _kind(v)
    if value is None:
        same = _false(k == "V")
    elif isinstance(value, bool):
        same = _holds(F.try_variant_get(v, "$", "boolean") == value, k == "B")
    else:
        kind, typed = ("S", F.try_variant_get(v, "$", "string")) if isinstance(value, str) else ("N", F.try_variant_get(v, "$", "double"))
        other = F.lit(value if isinstance(value, str) else float(value))
        if op == "!=":
            return ~_holds(typed == other, k == kind)
        return _holds(getattr(typed, _OPS[op])(other), k == kind)
    return ~same if op == "!=" else same if op in ("==", "<=", ">=") else F.lit(False)


def _value(of: Query | Function, x: Column, root: Column) -> Column:
    """A singular query or value(): a variant, or null for none."""
    if isinstance(of, Query):
        if not of.singular:
            raise NotNative("a comparison of several nodes")
        return _query(of, x, root)
    if of.name == "value" and isinstance(of.args[0], Query):
        q = of.args[0]
        if q.singular:
            return _query(q, x, root)
        nodes = _query(q, x, root)
        return F.when(F.size(nodes) == 1, F.get(nodes, F.lit(0)))
    raise NotNative(of.name)


def _number_of(f: Function, x: Column, root: Column) -> Column:
    arg = f.args[0]
    if f.name == "count":
        if not isinstance(arg, Query):
            raise NotNative("count of no query")
        nodes = _query(arg, x, root)
        return nodes.isNotNull().cast("int") if arg.singular else F.size(nodes)
    if isinstance(arg, Literal):
        return F.lit(len(arg.value) if isinstance(arg.value, str) else None)
    v = _value(arg, x, root)
    k = _kind(v)
    return F.when(k == "A", F.size(_array(v))).when(k == "O", F.size(_members(v))).when(k == "S", F.char_length(F.try_variant_get(v, "$", "string")))


def _test(e: Expr, x: Column, root: Column) -> Column:
    """A filter expression as a condition that is never null."""
    if isinstance(e, (Or, And)):
        out = _test(e.parts[0], x, root)
        for p in e.parts[1:]:
            out = out | _test(p, x, root) if isinstance(e, Or) else out & _test(p, x, root)
        return out
    if isinstance(e, Not):
        return ~_test(e.part, x, root)
    if isinstance(e, Compare):
        return _compare(e.op, e.left, e.right, x, root)
    if isinstance(e, Query):
        found = _query(e, x, root)
        return found.isNotNull() if e.singular else F.size(found) > 0
    if isinstance(e, Function) and e.name in ("match", "search"):
        text, pattern = e.args
        if not isinstance(pattern, Literal) or not isinstance(text, (Query, Function)):
            raise NotNative("a pattern that varies")
        p = compiled(pattern.value) if isinstance(pattern.value, str) else None
        if p is None:
            return F.lit(False)
        java = p.java()
        if java is None:
            raise NotNative("a pattern that could backtrack without end")
        v = _value(text, x, root)
        return _false((_kind(v) == "S") & F.try_variant_get(v, "$", "string").rlike(rf"\A(?:{java})\z" if e.name == "match" else java))
    return F.lit(False)  # a function that gives a value is no test


def native_first(doc: Column, path: str) -> Column:
    """The variant that a singular path leads to; null for none.  JSON null is a variant null."""
    query = compile_path(path)
    if not query.singular:
        raise NotNative("several nodes")
    return _query(query, doc, doc)


def native_values(doc: Column, path: str) -> Column:
    """array<variant> of a path's values; doc is a variant column.  Null documents give null."""
    query = compile_path(path)
    nodes = _query(query, doc, doc)
    found = F.filter(F.array(nodes), lambda x: x.isNotNull()) if query.singular else nodes
    return F.when(doc.isNotNull(), found)


def parsed(doc: Column | str) -> Column:
    """The document as a variant; null if it can't be one.  Parse once, in a projection of its own, for several paths."""
    return F.try_parse_json(F.col(doc) if isinstance(doc, str) else doc)


def is_native(path: str) -> bool:
    """Whether a path has a plan without Python."""
    try:
        native_values(F.lit(None).cast("variant"), path)
    except NotNative:
        return False
    return True


def select_values(doc: Column | str, path: str, kind: str = "string") -> Column:
    """The values of a path as array of a Spark type, on trusted documents: native where it can be, else exact."""
    c = F.col(doc) if isinstance(doc, str) else doc
    try:
        return F.transform(native_values(parsed(c), path), lambda x: F.try_variant_get(x, "$", kind))
    except NotNative:
        return F.transform(json_select_values(c, path), lambda x: F.try_variant_get(F.try_parse_json(x), "$", kind))
