"""Documents as a table of nodes, and JSONPath as joins over it.

`shred` writes each JSON node as a row: its pre-order number, the last number below it, parent, place and scalar.  A child
segment is then an equi-join on (doc, parent), a descendant segment an equi-join on doc with a range of pre-order
numbers, and a filter a semi- or anti-join.  It pays when many paths run over the same documents, which are parsed once.
Joins are on the document's key, so documents are never compared with each other, and a table written partitioned or
bucketed by it needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.core import values
from skarn.core.errors import JsonError
from skarn.core.evaluate import npath
from skarn.core.jsonpath import And, Compare, Expr, Filter, Function, Index, Literal, Name, Not, Or, Query, Selector, Slice, Wildcard, compile_path
from skarn.core.parse import parse
from skarn.functions import bound_batches

_FIELDS = "node int, last int, parent int, depth int, key string, idx int, kind string, number double, text string, flag boolean, n_children int, npath string"
_ROWS = 20_000


class NotRelational(ValueError):
    """A path that needs the exact evaluator."""


def _nodes(root: object) -> list[list]:
    """Rows in pre-order; `last` is filled when a container's nodes are all numbered."""
    rows: list[list] = []
    todo: list[tuple] = [(root, None, 0, None, None, None)]
    while todo:
        v, parent, depth, key, idx, path = todo.pop()
        if depth < 0:
            rows[parent][1] = len(rows) - 1
            continue
        k, me = values.kind(v), len(rows)
        rows.append([me, me, parent, depth, key, idx, k, float(v) if k == "number" else None, v if k == "string" else None, v if k == "boolean" else None, len(v) if k in ("object", "array") else 0, npath(path)])
        if k in ("object", "array") and v:
            todo.append((None, me, -1, None, None, None))
            items = v.items() if k == "object" else enumerate(v)
            todo += reversed([(x, me, depth + 1, s if k == "object" else None, i, (path, s)) for i, (s, x) in enumerate(items)])
    return rows


def shred(df: DataFrame, doc: str, key: str) -> DataFrame:
    """One row for each JSON node of a column; malformed and null documents have none.  idx is the place among the
    siblings, also for members."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(_FIELDS).fields])
    kinds = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                try:
                    found = _nodes(parse(text)) if text is not None else []
                except JsonError:
                    found = []
                at += [i] * len(found)
                rows += found
                if rows and (len(rows) >= _ROWS or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], schema.names)
                    at, rows = [], []

    bound_batches(df.sparkSession)
    return df.select(key, doc).mapInArrow(run, schema)


class NodeTable:
    """JSONPath over shredded documents."""

    def __init__(self, nodes: DataFrame, key: str):
        self.nodes, self.key = nodes, key

    def select(self, path: str) -> DataFrame:
        """key, ord (sorts the nodes of a document into the nodelist's order) and the columns of each selected node."""
        found = self._run(compile_path(path), self.nodes.where("node = 0").withColumn("ord", F.array().cast("array<int>")))
        return found

    def _run(self, query: Query, here: DataFrame) -> DataFrame:
        for segment in query.segments:
            if segment.descendant:
                here = self._below(here)
            each = [self._step(here, s, i if len(segment.selectors) > 1 else None) for i, s in enumerate(segment.selectors)]
            here = each[0]
            for other in each[1:]:
                here = here.unionByName(other)
        return here

    def _pair(self, here: DataFrame) -> tuple[DataFrame, Column]:
        """The input nodes under other names, and that two are of one document."""
        p = here.select(*(F.col(c).alias(f"p_{c}") for c in (self.key, "node", "last", "kind", "n_children", "ord")))
        return p, p[f"p_{self.key}"] == self.nodes[self.key]

    def _below(self, here: DataFrame) -> DataFrame:
        """Each container from the nodes down."""
        p, same = self._pair(here)
        inside = (self.nodes["node"] >= p["p_node"]) & (self.nodes["node"] <= p["p_last"])
        both = p.join(self.nodes, same & inside & self.nodes["kind"].isin("object", "array"))
        return both.withColumn("ord", F.concat("p_ord", F.array("node"))).select(*self.nodes.columns, "ord")

    def _step(self, here: DataFrame, s: Selector, ordinal: int | None) -> DataFrame:
        p, same = self._pair(here)
        both = p.join(self.nodes, same & (p["p_node"] == self.nodes["parent"]))
        order: Column = F.col("idx")
        if isinstance(s, Name):
            both = both.where((F.col("p_kind") == "object") & (F.col("key") == s.key))
        elif isinstance(s, Index):
            at = F.lit(s.at) if s.at >= 0 else F.col("p_n_children") + s.at
            both = both.where((F.col("p_kind") == "array") & (F.col("idx") == at))
        elif isinstance(s, Slice):
            both, order = _slice(both, s)
        elif isinstance(s, Filter):
            both = self._filter(both, s.test)
        mark = [] if ordinal is None else [F.lit(ordinal)]
        return both.withColumn("ord", F.concat("p_ord", F.array(*mark, order.cast("int")))).select(*self.nodes.columns, "ord")

    def _filter(self, rows: DataFrame, e: Expr) -> DataFrame:
        """The rows whose node passes; what a test needs is joined as a column that says whether it holds."""
        columns, n = rows.columns, 0

        def condition(e: Expr) -> Column:
            nonlocal rows, n
            if isinstance(e, (Or, And)):
                parts = [condition(p) for p in e.parts]
                out = parts[0]
                for c in parts[1:]:
                    out = out | c if isinstance(e, Or) else out & c
                return out
            if isinstance(e, Not):
                return ~condition(e.part)
            if isinstance(e, Compare) and all(isinstance(x, Query) and x.singular for x in (e.left, e.right)):
                return two(e)
            op, query, literal = _simple(e)
            if query.absolute:
                start = self.nodes.where("node = 0")
                at = [self.key]
            else:
                start = rows.select(*self.nodes.columns).distinct()
                at = [self.key, "node"]
            found = self._relative(query, start)
            if op:
                found = found.where(_matches(op, literal))
            n += 1
            holds = found.select(F.col(f"from_{self.key}").alias(f"h_{self.key}"), F.col("from_node").alias("h_node")).distinct().withColumn(f"__{n}", F.lit(True))
            on = rows[self.key] == holds[f"h_{self.key}"]
            if len(at) == 2:
                on = on & (rows["node"] == holds["h_node"])
            rows = rows.join(holds, on, "left").drop(f"h_{self.key}", "h_node")
            held = F.coalesce(F.col(f"__{n}"), F.lit(False))
            return ~held if op == "!=" else held

        def two(e: Compare) -> Column:
            """A comparison of two singular queries: the node of each, or null, is joined to the rows."""
            nonlocal rows, n
            sides = []
            for query in (e.left, e.right):
                n += 1
                start = self.nodes.where("node = 0") if query.absolute else rows.select(*self.nodes.columns).distinct()
                names = {c: f"__{n}_{c}" for c in ("kind", "number", "text", "flag")}
                found = self._relative(query, start).select(F.col(f"from_{self.key}").alias(f"h_{self.key}"), F.col("from_node").alias("h_node"), *(F.col(c).alias(x) for c, x in names.items()))
                on = rows[self.key] == found[f"h_{self.key}"]
                rows = rows.join(found, on if query.absolute else on & (rows["node"] == found["h_node"]), "left").drop(f"h_{self.key}", "h_node")
                sides.append({c: F.col(x) for c, x in names.items()})
            return _both(e.op, *sides)

        test = condition(e)
        return rows.where(test).select(*columns)

    def _relative(self, query: Query, start: DataFrame) -> DataFrame:
        """The nodes that a query leads to from each start, with from_ columns that name it."""
        here = start.withColumn(f"from_{self.key}", F.col(self.key)).withColumn("from_node", F.col("node"))
        for segment in query.segments:
            if segment.descendant or len(segment.selectors) > 1:
                raise NotRelational("a filter's query of several nodes")
            s = segment.selectors[0]
            names = ("node", "kind", "n_children", f"from_{self.key}", "from_node")
            p = here.select(F.col(self.key).alias("q_key"), *(F.col(c).alias(f"q_{c}") for c in names))
            both = p.join(self.nodes, (p["q_key"] == self.nodes[self.key]) & (p["q_node"] == self.nodes["parent"]))
            if isinstance(s, Name):
                both = both.where((F.col("q_kind") == "object") & (F.col("key") == s.key))
            elif isinstance(s, Index):
                both = both.where((F.col("q_kind") == "array") & (F.col("idx") == (F.lit(s.at) if s.at >= 0 else F.col("q_n_children") + s.at)))
            elif not isinstance(s, Wildcard):
                raise NotRelational("a filter's query with slices or filters")
            here = both.select(*self.nodes.columns, F.col(f"q_from_{self.key}").alias(f"from_{self.key}"), F.col("q_from_node").alias("from_node"))
        return here


def _slice(both: DataFrame, s: Slice) -> tuple[DataFrame, Column]:
    if not s.step:
        return both.where(F.lit(False)), F.col("idx")
    n, i = F.col("p_n_children"), F.col("idx")
    low, high = (F.lit(0), n) if s.step > 0 else (F.lit(-1), n - 1)
    edge = lambda at, default: default if at is None else F.greatest(low, F.least(high, F.lit(at) if at >= 0 else n + at))
    start, end = edge(s.start, F.lit(0) if s.step > 0 else n - 1), edge(s.end, n if s.step > 0 else F.lit(-1))
    inside = (i >= start) & (i < end) if s.step > 0 else (i <= start) & (i > end)
    return both.where((F.col("p_kind") == "array") & inside & (F.abs(i - start) % abs(s.step) == 0)), i if s.step > 0 else -i


def _simple(e: Expr) -> tuple[str, Query, object]:
    """(operator or "", query, literal) of an existence test or of a comparison of a singular query with a literal."""
    if isinstance(e, Query):
        return "", e, None
    if isinstance(e, Compare):
        left, op, right = e.left, e.op, e.right
        if isinstance(left, Literal):
            left, op, right = right, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), left
        if isinstance(left, Query) and left.singular and isinstance(right, Literal):
            return op, left, right.value
    if isinstance(e, Function):
        raise NotRelational(e.name)
    raise NotRelational("a comparison of two things that vary")


def _both(op: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two nodes, each by kind and value, compare; a missing one has no kind and equals only another one."""
    here = a["kind"].isNotNull() & b["kind"].isNotNull()
    deep = here & (a["kind"] == b["kind"]) & a["kind"].isin("object", "array")
    error = F.raise_error(F.lit("a comparison of objects or arrays needs the exact evaluator")).cast("boolean")
    same = here & (a["kind"] == b["kind"])
    equal = ~F.coalesce(here, F.lit(False)) & a["kind"].isNull() & b["kind"].isNull()
    for kind, c in (("number", "number"), ("string", "text"), ("boolean", "flag")):
        equal = equal | F.coalesce(same & (a["kind"] == kind) & (a[c] == b[c]), F.lit(False))
    equal = equal | F.coalesce(same & (a["kind"] == "null"), F.lit(False))
    if op in ("<=", "<", ">", ">="):
        less = F.lit(False)
        for kind, c in (("number", "number"), ("string", "text")):
            one, other = (a[c], b[c]) if op in ("<", "<=") else (b[c], a[c])
            less = less | F.coalesce(same & (a["kind"] == kind) & (one < other), F.lit(False))
        return less | equal if op in ("<=", ">=") else less
    return F.when(F.coalesce(deep, F.lit(False)), error).otherwise(equal if op == "==" else ~equal)


def _matches(op: str, literal: object) -> Column:
    """Whether a node compares with a literal; for != whether it is equal, as missing nodes are unequal, too."""
    if literal is None:
        return (F.col("kind") == "null") & F.lit(op not in ("<", ">"))
    if isinstance(literal, bool):
        return (F.col("kind") == "boolean") & (F.col("flag") == literal) & F.lit(op not in ("<", ">"))
    column, other = ("text", literal) if isinstance(literal, str) else ("number", float(literal))
    c, o = F.col(column), F.lit(other)
    test = {"==": c == o, "!=": c == o, "<": c < o, "<=": c <= o, ">": c > o, ">=": c >= o}[op]
    return (F.col("kind") == ("string" if column == "text" else "number")) & test
