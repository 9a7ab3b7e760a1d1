"""The queries of the JSON engine over documents made from the star schema, and SQL that asks the base tables.

E: events.props; C: a document for each customer with its orders; O: a document for each order with its items.  Names
that end in _native run inside the JVM, _nodes over the node table, the others through the exact evaluator.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn import functions as J
from skarn import operators, sources, streaming
from skarn.plans import lowering
from skarn.plans.nodes import NodeTable, shred

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    J.bound_batches(spark)  # of this session, which need not be the active one
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, doc: {c_custkey, c_name, c_acctbal, orders: [{...}]}, orders by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, sf_dir, "orders").select("o_custkey", *_ORDER)
    return sources.nested(c, o, "c_custkey", "o_custkey", "orders", ["o_orderkey"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, doc: {o_orderkey, o_orderpriority, items: [{n, q, disc, flag}]}, items by all their members."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_returnflag").alias("flag"))
    return sources.nested(o, i, "o_orderkey", "l_orderkey", "items", ["n", "q", "disc", "flag"])


def _numbers(df: DataFrame, key: str, path: str, kind: str, name: str) -> DataFrame:
    """A row for each value of a path, by the exact evaluator."""
    return df.select(key, F.explode(J.json_select_values("doc", path)).alias("v")).select(key, F.col("v").cast(kind).alias(name))


def _native(df: DataFrame, key: str, path: str, kind: str, name: str) -> DataFrame:
    """A row for each value of a path, without Python."""
    return df.select(key, F.explode(F.transform(lowering.native_values(lowering.parsed("doc"), path), lambda x: F.try_variant_get(x, "$", kind))).alias(name))


def _both(name: str, docs: Callable, key: str, path: str, kind: str, column: str, sql: str) -> None:
    query(sql, name)(lambda spark, sf_dir: _numbers(docs(spark, sf_dir), key, path, kind, column))
    query(sql, f"{name}_native")(lambda spark, sf_dir: _native(docs(spark, sf_dir), key, path, kind, column))


# ---- singular paths


_EVENTS_K = "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"


@query(_EVENTS_K)
def events_k_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`$.k` of every event, grouped and counted, in the JVM."""
    k = F.try_variant_get(lowering.native_first(lowering.parsed("props"), "$.k"), "$", "bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query(_EVENTS_K)
def events_k_hist_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get(J.json_select_values("props", "$.k"), F.lit(0)).cast("bigint")
    return table(spark, sf_dir, "events").select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# ---- selectors

_JOIN = "FROM customer JOIN orders ON o_custkey = c_custkey"
_NUMBERED = f"(SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY c_custkey) AS n {_JOIN})"


@query(f"SELECT c_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents {_JOIN} GROUP BY 1")
def path_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _numbers(customers(spark, sf_dir), "c_custkey", "$.orders[*].o_totalprice", "double", "p")
    return prices.groupBy("c_custkey").agg(F.sum(F.round(F.col("p") * 100).cast("bigint")).alias("cents"))


_both("path_index_negative", customers, "c_custkey", "$.orders[-1].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, max(o_orderkey) AS o_orderkey {_JOIN} GROUP BY 1")
_both("path_index", customers, "c_custkey", "$.orders[1].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey FROM {_NUMBERED} WHERE r = 2")
_both("path_slice_step", customers, "c_custkey", "$.orders[::2].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey FROM {_NUMBERED} WHERE r % 2 = 1")
_both("path_slice_middle", customers, "c_custkey", "$.orders[2:-3].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey FROM {_NUMBERED} WHERE r > 2 AND r <= n - 3")


@query(f"SELECT c_custkey, n - r AS pos, o_orderkey FROM {_NUMBERED} WHERE n - r < 3")
def path_slice_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = operators.select_nodes(customers(spark, sf_dir), "doc", "$.orders[:-4:-1].o_orderkey")
    return found.select("c_custkey", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("bigint").alias("o_orderkey"))


@query("SELECT c_custkey, pos, v FROM (SELECT c_custkey, 2 * r - 2 AS pos, o_orderkey AS v FROM " + _NUMBERED + " UNION ALL SELECT c_custkey, 2 * r - 1, CAST(round(o_totalprice) AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r " + _JOIN + "))")
def path_multi_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = operators.select_nodes(customers(spark, sf_dir), "doc", "$.orders[*]['o_orderkey','o_totalprice']")
    return found.select("c_custkey", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double")).cast("bigint").alias("v"))


def _nodes(spark: SparkSession, sf_dir: str) -> NodeTable:
    """The customers' documents, shredded once to a written table that every join reads; without normalized paths."""
    path = _folder(spark, "nodes")
    shred(customers(spark, sf_dir), "doc", "c_custkey").drop("npath").write.parquet(path)
    return NodeTable(spark.read.parquet(path), "c_custkey")


@query(f"SELECT c_custkey, o_orderkey AS v {_JOIN}")
def path_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(customers(spark, sf_dir), "c_custkey", "$..o_orderkey", "bigint", "v")


@query(f"SELECT c_custkey, o_orderkey AS v {_JOIN}")
def path_descendant_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("$..o_orderkey").select("c_custkey", F.col("number").cast("bigint").alias("v"))


@query("SELECT o_orderkey, '$[''items''][' || (r - 1) || '][''q'']' AS path FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def path_npaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", F.explode(J.json_select_paths("doc", "$.items[*].q")).alias("path"))


@query("SELECT o_orderkey, '/items/' || (r - 1) || '/q' AS ptr FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def npath_to_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_npaths(spark, sf_dir).select("o_orderkey", J.npath_to_pointer("path").alias("ptr"))


@query(f"SELECT c_custkey, min(o_orderkey) AS first, CAST(round(any_value(c_acctbal) * 100) AS BIGINT) AS cents, count(*) AS n {_JOIN} GROUP BY 1")
def path_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three paths, one parse."""
    many = J.json_select_many("doc", {"first": "$.orders[0].o_orderkey", "balance": "$.c_acctbal", "all": "$.orders[*]"})
    found = customers(spark, sf_dir).select("c_custkey", many.alias("m")).where("size(m.all) > 0")
    return found.select("c_custkey", F.expr("cast(m.first[0] as bigint)").alias("first"), F.expr("cast(round(cast(m.balance[0] as double) * 100) as bigint)").alias("cents"), F.size("m.all").cast("bigint").alias("n"))


# ---- filters and functions

_both("filter_compare", customers, "c_custkey", "$.orders[?@.o_totalprice > 300000].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE o_totalprice > 300000")
_both("filter_absolute", customers, "c_custkey", "$.orders[?@.o_totalprice < $.c_acctbal].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE o_totalprice < c_acctbal")
_both(
    "filter_logic", orders, "o_orderkey", "$.items[?@.q > 30 && !(@.flag == 'R') || @.disc == 0].n", "bigint", "n",
    "SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE (l_quantity > 30 AND NOT (l_returnflag = 'R')) OR l_discount = 0",
)
_both("fn_length", customers, "c_custkey", "$.orders[?length(@.o_orderpriority) > 5].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE length(o_orderpriority) > 5")
_both("fn_match", customers, "c_custkey", "$.orders[?match(@.o_orderpriority, '[1-3][-].*')].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE regexp_full_match(o_orderpriority, '[1-3][-].*')")
_both("fn_search", customers, "c_custkey", "$.orders[?search(@.o_orderpriority, 'E[CD]')].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE regexp_matches(o_orderpriority, 'E[CD]')")
_both("fn_value", customers, "c_custkey", "$.orders[?value(@['o_orderstatus','none']) == 'F'].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE o_orderstatus = 'F'")


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 4")
def fn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders(spark, sf_dir).select("o_orderkey", J.json_select_values("doc", "$[?count(@[*]) > 4][*].n").alias("v"))
    return found.where("size(v) > 0").select("o_orderkey", F.size("v").cast("bigint").alias("n"))


@query(f"SELECT c_custkey, o_orderkey {_JOIN} WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def filter_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter as semi-joins over the node table."""
    return _nodes(spark, sf_dir).select("$.orders[?@.o_orderstatus == 'F' && @.o_totalprice >= 100000].o_orderkey").select("c_custkey", F.col("number").cast("bigint").alias("o_orderkey"))


_SPARSE = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END AS x, CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 4 END AS y FROM orders)"


@query(
    f"SELECT CAST(count(*) FILTER (WHERE x IS NOT NULL) AS BIGINT) AS has, CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS lacks, "
    f"CAST(count(*) FILTER (WHERE x IS NOT DISTINCT FROM y) AS BIGINT) AS same, CAST(count(*) FILTER (WHERE x IS DISTINCT FROM y) AS BIGINT) AS differ, "
    f"CAST(count(*) FILTER (WHERE (x IS NULL AND y IS NULL) OR x <= y) AS BIGINT) AS most, CAST(count(*) FILTER (WHERE x < y) AS BIGINT) AS less FROM {_SPARSE}"
)
def filter_exists_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing members are equal to each other and unequal to values."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    member = lambda name, every, over: F.when(key % every > 0, F.struct((key % over).alias(name)))
    parts = F.concat_ws(",", *(F.regexp_extract(F.to_json(member(*m)), r"^\{(.*)\}$", 1) for m in (("x", 3, 5), ("y", 2, 4))))
    docs = o.select(F.concat(F.lit("[{"), F.regexp_replace(parts, "^,|,$", ""), F.lit("}]")).alias("doc"))
    tests = {"has": "@.x", "lacks": "!@.x", "same": "@.x == @.y", "differ": "@.x != @.y", "most": "@.x <= @.y", "less": "@.x < @.y"}
    found = docs.select(J.json_select_many("doc", {n: f"$[?{t}]" for n, t in tests.items()}).alias("m"))
    return found.select(*(F.size(F.col("m")[n]).cast("bigint").alias(n) for n in tests)).agg(*(F.sum(n).alias(n) for n in tests))


# ---- pointers and accessors


@query(f"SELECT c_custkey, min(o_orderkey) AS o_orderkey {_JOIN} GROUP BY 1")
def pointer_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = customers(spark, sf_dir).select("c_custkey", J.json_pointer("doc", "/orders/0/o_orderkey").cast("bigint").alias("o_orderkey"))
    return found.where("o_orderkey is not null")


@query(f"SELECT c_custkey, o_orderkey FROM {_NUMBERED} WHERE r = 1 + c_custkey % 3")
def pointer_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer of its own for each document."""
    ptr = F.concat(F.lit("/orders/"), (F.col("c_custkey") % 3).cast("string"), F.lit("/o_orderkey"))
    return customers(spark, sf_dir).select("c_custkey", J.json_pointer("doc", ptr).cast("bigint").alias("o_orderkey")).where("o_orderkey is not null")


@query("SELECT c_custkey, c_name AS name, c_name IS NOT NULL AS is_string, CAST(NULL AS BIGINT) AS no_long, CAST(c_custkey AS BIGINT) AS key_long, CAST('array' AS VARCHAR) AS orders_type, CAST('null' AS VARCHAR) AS left_there FROM customer")
def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = customers(spark, sf_dir)
    taken = J.json_take("doc", "c_name")
    d = d.withColumn("t", taken).withColumn("k", J.json_get("doc", "c_custkey"))
    return d.select(
        "c_custkey",
        J.json_str("t.value").alias("name"),
        J.json_is_string("t.value").alias("is_string"),
        J.json_long("t.value").alias("no_long"),
        J.json_long("k").alias("key_long"),
        J.json_type(J.json_get("doc", "orders")).alias("orders_type"),
        J.json_get("t.rest", "c_name").alias("left_there"),
    )


@query(f"SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'string' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'number', 2 * count(*) FROM customer UNION ALL SELECT 'array', count(*) FROM customer UNION ALL SELECT 'object', count(*) {_JOIN} UNION ALL SELECT 'string', 2 * count(*) {_JOIN} UNION ALL SELECT 'number', 2 * count(*) {_JOIN}) GROUP BY kind")
def json_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = customers(spark, sf_dir).select(F.explode(J.json_select_types("doc", "$..*")).alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


# ---- patches

_PATCHES = {
    "patch_add": ('[{"op": "add", "path": "/orders/0", "value": {"o_orderkey": -1}}, {"op": "add", "path": "/note", "value": "n"}]', "$.orders[0].o_orderkey", "-1"),
    "patch_append": ('[{"op": "add", "path": "/orders/-", "value": {"o_orderkey": 7}}]', "$.orders[-1].o_orderkey", "7"),
    "patch_remove": ('[{"op": "remove", "path": "/c_name"}]', "$.c_name", None),
    "patch_replace": ('[{"op": "replace", "path": "/c_custkey", "value": [1, {"a": null}]}]', "$.c_custkey[0]", "1"),
    "patch_move": ('[{"op": "move", "from": "/c_custkey", "path": "/key"}]', "$.key", "c_custkey"),
    "patch_copy": ('[{"op": "copy", "from": "/c_custkey", "path": "/orders/-"}]', "$.orders[-1]", "c_custkey"),
}


def _patched(patch: str, path: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        changed = customers(spark, sf_dir).select("c_custkey", J.json_try_modify_values("doc", patch, path).alias("r"))
        return changed.select("c_custkey", F.get("r.values", F.lit(0)).try_cast("bigint").alias("v"), F.col("r.error").isNull().alias("ok"))

    return run


for _name, (_patch, _path, _value) in _PATCHES.items():
    query(f"SELECT c_custkey, CAST({_value or 'NULL'} AS BIGINT) AS v, true AS ok FROM customer", _name)(_patched(_patch, _path))

_TESTED = '[{"op": "replace", "path": "/c_name", "value": "x"}, {"op": "test", "path": "/orders/0/o_orderstatus", "value": "F"}, {"op": "add", "path": "/seen", "value": 1}]'
_FIRST = f"(SELECT c.c_custkey, c_name, o_orderstatus AS s FROM customer c LEFT JOIN (SELECT c_custkey, o_orderkey, o_orderstatus {_JOIN} QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1) o ON c.c_custkey = o.c_custkey)"
_KIND = "CASE WHEN s = 'F' THEN NULL WHEN s IS NULL THEN 'IndexOutOfBounds' ELSE 'NotEqual' END"


def _tested(how: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        changed = customers(spark, sf_dir).select("c_custkey", how("doc", _TESTED).alias("r"))
        return changed.select("c_custkey", J.json_str(J.json_get("r.doc", "c_name")).alias("name"), J.json_get("r.doc", "seen").alias("seen"), F.col("r.error.kind").alias("kind"), F.coalesce("r.error.pos", F.lit(-1)).cast("bigint").alias("op"))

    return run


_AFTER = f"CASE WHEN s = 'F' THEN '1' END AS seen, {_KIND} AS kind, CASE WHEN s = 'F' THEN -1 ELSE 1 END::BIGINT AS op FROM {_FIRST}"
query(f"SELECT c_custkey, CASE WHEN s = 'F' THEN 'x' ELSE c_name END AS name, {_AFTER}", "try_modify_rollback")(_tested(J.json_try_modify))
query(f"SELECT c_custkey, 'x' AS name, {_AFTER}", "modify_partial")(_tested(J.json_modify))


# ---- parsing, printing, comparing


@query("SELECT CASE WHEN octet_length(encode(text)) > 8192 THEN 'StringLengthLimitExceeded' END AS kind, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as JSON strings; the limit of a string's length makes errors."""
    docs = table(spark, sf_dir, "documents").select(J.json_from("text").alias("doc"))
    return docs.select(J.try_json_parse("doc").alias("r")).groupBy(F.col("r.error.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT c_mktsegment || '|' || c_nationkey) AS BIGINT) AS documents FROM customer")
def canonical_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members in either order, numbers as 3 or 3.0: the same documents."""
    c = table(spark, sf_dir, "customer")
    a = F.to_json(F.struct("c_mktsegment", "c_nationkey"))
    b = F.to_json(F.struct(F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_mktsegment"))
    found = operators.distinct_documents(c.select(F.when(F.col("c_custkey") % 2 == 0, a).otherwise(b).alias("doc")), "doc")
    return found.agg(F.sum("n").alias("rows"), F.count("*").alias("documents"))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","a":[1.5,2,null,{}]}' AS compact, '{' || chr(10) || '    "c_custkey": ' || c_custkey || ',' || chr(10) || '    "c_name": "' || c_name || '",' || chr(10) || '    "a": [' || chr(10) || '        1.5,' || chr(10) || '        2,' || chr(10) || '        null,' || chr(10) || '        {}' || chr(10) || '    ]' || chr(10) || '}' AS pretty FROM customer""")
def printing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    doc = F.concat(F.lit('{ "c_custkey" : '), F.col("c_custkey").cast("string"), F.lit(' , "c_name": '), J.json_from("c_name"), F.lit(', "a": [ 1.50, 2.0, null, { } ] }'))
    d = c.select("c_custkey", doc.alias("doc"))
    return d.select("c_custkey", J.json_compact("doc").alias("compact"), J.json_pretty("doc").alias("pretty"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 150000 THEN -1 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS INT) AS price, CAST(CASE WHEN o_orderpriority < '3-MEDIUM' THEN -1 WHEN o_orderpriority > '3-MEDIUM' THEN 1 ELSE 0 END AS INT) AS priority, true AS no_order, true AS same FROM orders")
def comparing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price, priority = J.json_from("o_totalprice"), J.json_from("o_orderpriority")
    forth, back = F.to_json(F.struct("o_orderkey", "o_orderstatus")), F.to_json(F.struct("o_orderstatus", F.col("o_orderkey").cast("double").alias("o_orderkey")))
    return o.select("o_orderkey", J.json_compare(price, J.json_literal(150000)).alias("price"), J.json_compare(priority, J.json_literal("3-MEDIUM")).alias("priority"), J.json_compare(price, priority).isNull().alias("no_order"), J.json_equals(forth, back).alias("same"))


@query("SELECT o_orderkey, CAST(CAST(o_orderkey || '000000000000000.0000000001' AS DECIMAL(38,10)) AS VARCHAR) AS big, false AS valid FROM orders")
def arbitrary_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers beyond what the limits of a plain number allow."""
    whole = F.concat((F.col("o_orderkey").cast("decimal(38,0)") * F.lit(1000000000000000).cast("decimal(16,0)")).cast("decimal(38,0)").cast("string"), F.lit(".0000000001"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", whole.alias("doc"))
    too_big = F.concat(F.lit("9"), F.regexp_replace("doc", "[.].*", ""), F.lit("0000000000000000"))
    return d.select("o_orderkey", J.json_decimal("doc", 38, 10).cast("string").alias("big"), J.json_valid(too_big).alias("valid"))


@query(f"SELECT c_custkey, CAST(r - 1 AS INT) AS pos, '$[''orders''][' || (r - 1) || '][''o_orderkey'']' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM {_NUMBERED}")
def sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL."""
    J.register(spark)
    customers(spark, sf_dir).createOrReplaceTempView("skarn_customers")
    return spark.sql("SELECT c_custkey, e.pos, e.path, e.value FROM skarn_customers, LATERAL json_each(doc, '$.orders[*].o_orderkey') e")


@query("SELECT c_custkey, true AS object, false AS array, true AS name_string, true AS number, CAST(c_custkey AS BIGINT) AS as_long, CAST('string' AS VARCHAR) AS kind, false AS is_null, true AS missing FROM customer")
def type_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = customers(spark, sf_dir).withColumn("key", J.json_get("doc", "c_custkey")).withColumn("name", J.json_get("doc", "c_name"))
    return d.select(
        "c_custkey",
        J.json_is_object("doc").alias("object"),
        J.json_is_array("doc").alias("array"),
        J.json_is_string("name").alias("name_string"),
        J.json_is_number("key").alias("number"),
        J.json_number("key").cast("bigint").alias("as_long"),
        J.json_type("name").alias("kind"),
        J.json_is_null("name").alias("is_null"),
        J.json_get("doc", "nobody").isNull().alias("missing"),
    )


@query("SELECT c_custkey, CAST(4 AS BIGINT) AS members, c_name AS second, CAST(count(o_orderkey) AS BIGINT) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's members in order, an array's items."""
    d = customers(spark, sf_dir).withColumn("e", J.json_object_entries("doc"))
    return d.select("c_custkey", F.size("e").cast("bigint").alias("members"), J.json_str(F.get("e", F.lit(1))["value"]).alias("second"), F.size(J.json_array_items(F.get("e", F.lit(3))["value"])).cast("bigint").alias("items"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'UnexpectedToken' WHEN 1 THEN 'LeadingZeros' WHEN 2 THEN 'DuplicateName' ELSE 'UnexpectedEof' END AS kind, CAST(CASE o_orderkey % 4 WHEN 0 THEN length(CAST(o_orderkey AS VARCHAR)) + 6 WHEN 1 THEN 5 WHEN 2 THEN length(CAST(o_orderkey AS VARCHAR)) + 6 ELSE length(CAST(o_orderkey AS VARCHAR)) + 4 END AS INT) AS pos FROM orders")
def error_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed documents, as bytes: what is wrong and where."""
    key = F.col("o_orderkey").cast("string")
    made = F.concat(F.lit('{"a":'), F.when(F.col("o_orderkey") % 4 == 1, "0").otherwise(""), key)
    rest = F.when(F.col("o_orderkey") % 4 == 0, ",}").when(F.col("o_orderkey") % 4 == 2, ',"a":0}').when(F.col("o_orderkey") % 4 == 1, "}").otherwise("")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(made, rest).cast("binary").alias("doc"))
    r = d.select("o_orderkey", J.try_json_parse("doc").alias("r"))
    return r.select("o_orderkey", F.col("r.error.kind").alias("kind"), F.col("r.error.pos").alias("pos"))


@query(f"SELECT c.c_custkey, CASE WHEN c.c_custkey % 2 = 0 THEN 'InvalidIndex' END AS kind, CAST(CASE WHEN c.c_custkey % 2 > 0 THEN coalesce(f.o, -1) ELSE -1 END AS BIGINT) AS first FROM customer c LEFT JOIN (SELECT c_custkey, min(o_orderkey) AS o {_JOIN} GROUP BY 1) f ON f.c_custkey = c.c_custkey")
def pointer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ptr = F.when(F.col("c_custkey") % 2 == 0, "/orders/first/o_orderkey").otherwise("/orders/0/o_orderkey")
    d = customers(spark, sf_dir).select("c_custkey", J.try_json_pointer("doc", ptr).alias("r"))
    return d.select("c_custkey", F.col("r.error.kind").alias("kind"), F.coalesce(F.col("r.value").cast("bigint"), F.lit(-1)).alias("first"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.02)")
def filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter inside a filter."""
    d = orders(spark, sf_dir).select("o_orderkey", J.json_select_values("doc", "$[?@[?@.q > 49 && @.disc < 0.02]]").alias("v"))
    return d.where("size(v) > 0").select("o_orderkey")


_both("fn_match_property", customers, "c_custkey", r"$.orders[?match(@.o_orderpriority, '\\p{Nd}[-]\\p{Lu}{3,6}')].o_orderkey", "bigint", "o_orderkey", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE regexp_full_match(o_orderpriority, '\\p{{Nd}}-\\p{{Lu}}{{3,6}}')")

_PAIRS = "SELECT c_custkey, {pos} AS pos, v FROM (SELECT c_custkey, r, n, 0 AS s, CAST(o_orderkey AS VARCHAR) AS v FROM " + _NUMBERED + " UNION ALL SELECT x.c_custkey, x.r, x.n, 1, '\"' || o_orderstatus || '\"' FROM " + _NUMBERED + " x JOIN orders o ON o.o_orderkey = x.o_orderkey)"


def _pairs(semantics: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = customers(spark, sf_dir).select("c_custkey", F.posexplode(J.json_select_values("doc", "$..['o_orderkey','o_orderstatus']", semantics)).alias("pos", "v"))
        return found.select("c_custkey", F.col("pos").cast("bigint").alias("pos"), "v")

    return run


query(_PAIRS.format(pos="2 * (r - 1) + s"), "path_descendant_pairs")(_pairs("standard"))
query(_PAIRS.format(pos="s * n + r - 1"), "path_descendant_pairs_by_selector")(_pairs("reference"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by hash, whatever the order of members."""
    o = table(spark, sf_dir, "orders")
    a = F.to_json(F.struct("o_orderstatus", F.lit(1).alias("x")))
    b = F.to_json(F.struct(F.lit(1.0).alias("x"), "o_orderstatus"))
    d = o.select("o_orderstatus", J.json_hash(F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b)).alias("h"))
    return d.groupBy("h").agg(F.first("o_orderstatus").alias("o_orderstatus"), F.count("*").alias("n")).drop("h")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to files of lines in the shared folder, and back."""
    path = _folder(spark, "lines")
    sources.write_json_lines(customers(spark, sf_dir), "doc", path, "gzip")
    back = sources.json_lines(spark, path).where(J.json_valid("doc"))
    return back.agg(F.count("*").alias("n"), F.sum(J.json_pointer("doc", "/c_custkey").cast("bigint")).alias("keys"))


@query("SELECT date_trunc('hour', ts) AS hour, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the events as a stream, run to its end."""
    at = _folder(spark, "stream")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "props")
    events.write.parquet(f"{at}/in")  # a stream reads a folder; the table may be one file
    stream = streaming.valid_documents(streaming.table_stream(spark, f"{at}/in", events.schema), "props")
    counts = streaming.windowed_counts(stream, "props", "$.k", "ts", "1 hour", "1 day", "bigint")
    run = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out").groupBy(F.col("window.start").cast("timestamp_ntz").alias("hour"), (F.col("value") % 10).alias("digit"))
    return out.agg(F.sum("n").alias("n"))


def _cases(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few documents beside the tables, for what the tables don't have."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")


def _values(rows: list[tuple], *names: str) -> str:
    """SQL of fixed rows with an id each."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(one, r))})" for i, r in enumerate(rows)) + f") t(id, {', '.join(names)})"


#: Documents as bytes; what they print as, or what is wrong and at which byte.
_STRINGS = [
    (rb'"\ud83d\ude00\u0041"', '"\U0001f600A"', None),
    (rb'"\ud83d"', None, "StringUnexpectedEof"),
    (rb'"\ude00x"', None, "InvalidSurrogate"),
    (rb'"\u12g4"', None, "InvalidUnicodeSequence"),
    (b'"\xc3\xa9\xe2\x82\xac"', '"\u00e9\u20ac"', None),
    (b'"\xc0\xaf"', None, "InvalidByteSequence"),
    (b'"\xed\xa0\x80"', None, "InvalidByteSequence"),
    (b"\xef\xbb\xbf1", "1", None),
    (b'"a\nb"', None, "InvalidControlCharacter"),
    (rb'"\b\f\n\r\t\"\\\/\u001f"', r'"\b\f\n\r\t\"\\/\u001f"', None),
    (rb'"\q"', None, "UnknownEscapedCharacter"),
]


def string_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate pairs, UTF-8, byte order marks, hex digits, control characters; printing of escapes."""
    d = _cases(spark, [(bytearray(r[0]),) for r in _STRINGS], "doc binary").select("id", J.try_json_parse("doc").alias("r"))
    return d.select("id", F.col("r.value").alias("value"), F.col("r.error.kind").alias("kind"))


_POINTERS = [
    ("", '{"":0,"a/b":1,"m~n":2,"c":[10,{"":true}]}', None),
    ("/", "0", None),
    ("/a~1b", "1", None),
    ("/m~0n", "2", None),
    ("/c/0", "10", None),
    ("/c/1/", "true", None),
    ("/c/2", None, None),
    ("/none/x", None, None),
    ("c", None, "InvalidPointerSyntax"),
    ("/m~2n", None, "UnknownEscapedCharacter"),
    ("/c/01", None, "InvalidIndex"),
    ("/c/first", None, "InvalidIndex"),
]


def pointer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers to the root, to empty names, with escapes; what is wrong with others."""
    d = _cases(spark, [(r[0],) for r in _POINTERS], "ptr string")
    r = d.select("id", J.try_json_pointer(F.lit(_POINTERS[0][1]), F.col("ptr")).alias("r"))
    return r.select("id", F.col("r.value").alias("value"), F.col("r.error.kind").alias("kind"))


_SCALARS = [("true", "", True, None), ("false", "/a", False, None), ("null", "", None, None), ("5", "", None, None), ('"x"', "", None, None), ("[true]", "/0", None, "true")]


def scalar_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are scalars: as booleans, and by pointers."""
    d = _cases(spark, [r[:2] for r in _SCALARS], "doc string, ptr string")
    return d.select("id", J.json_bool("doc").alias("flag"), J.json_pointer("doc", F.col("ptr")).alias("value"))


#: Patterns with a text: whether it matches in full, whether in part, and what is wrong with the pattern.
_PATTERNS = [
    ("a|bc", "bc", True, True, None),
    ("(ab){2}c?", "abab", True, True, None),
    (r"\\.x\\n", ".x\n", True, True, None),
    ("[^0-9a]+", "xyz", True, True, None),
    ("[^0-9]", "12x4", False, True, None),
    ("(a|(b|c)d)*", "acdbda", True, True, None),
    (r"\\^$", "^$", True, True, None), (r"\\$", "$", False, False, None),
    (r"\\P{L}+", "123", True, True, None),
]
_BAD_PATTERNS = ["(a", "a)", "[a", "a{3,2}", "*a", r"\d", "a{1000}"]


def regex_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions, groups, escapes and negated classes."""
    d = _cases(spark, [r[:2] for r in _PATTERNS], "p string, s string")
    doc = J.json_from(F.struct("s"))
    path = lambda f: F.concat(F.lit(f"$[?{f}(@, '"), F.col("p"), F.lit("')]"))
    found = lambda f: F.size(J.json_select_values(doc, path(f))) > 0
    return d.select("id", found("match").alias("whole"), found("search").alias("part"))


def regex_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, [(p,) for p in _BAD_PATTERNS], "p string")
    return d.select("id", J.json_regex_error("p").isNotNull().alias("bad"))


#: Paths and whether they are well formed: blanks, the whole query, the types of functions' arguments and results.
_PATHS = [
    ("$", True), ("$.a", True), ("$ .a [ 'b' , 0 ]", True), ("$[?@.a == 1 && ( @.b )]", True), (" $.a", False), ("$.a ", True), ("$ ", False), ("$. a", False), ("a", False),
    ("$[?length(@.a) > 1]", True), ("$[?length(@.*) > 1]", False), ("$[?count(@.*) == 2]", True), ("$[?count(1) == 2]", False), ("$[?length(@.a)]", True), ("$[?match(@.a, 'x') == true]", True),
    ("$[?match(@.a, 'x')]", True), ("$[?value(@..a) == 1]", True), ("$[?@.* == 1]", True), ("$[?nothing(@)]", False), ("$[?length(@.a, 1) > 1]", False), ("$[9007199254740992]", False), ("$[01]", False), ("$[1:2:0]", True),
]


def path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, [(p,) for p, _ in _PATHS], "p string")
    return d.select("id", J.json_path_error("p").isNull().alias("good"))


_PATCH_TEXTS = [
    ('[{"op":"add","path":"/b","value":1,"note":"x"}]', True), ('[{"op":"add","path":"/b"}]', False), ('[{"op":"nothing","path":"/b"}]', False), ('[{"path":"/b","value":1}]', False), ('{"op":"remove","path":"/a"}', False), ('[{"op":"move","path":"/b"}]', False), ("[]", True), ('[{"op":"remove","path":"a"}]', False),
]


def patch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with unknown members, and such as can't be read."""
    rows, d = [], None
    for i, (text, _) in enumerate(_PATCH_TEXTS):
        try:
            one = spark.range(1).select(F.lit(i).alias("id"), J.json_modify(F.lit('{"a":0}'), text)["error"].isNull().alias("good"))
            d = one if d is None else d.unionByName(one)
        except J.JsonError:  # patches that are literals are read on the driver
            rows.append((i, False))
    bad = spark.createDataFrame(rows, "id int, good boolean")
    return bad if d is None else d.unionByName(bad)


query(_values([r[1:] for r in _STRINGS], "value", "kind"))(string_escapes)
query(_values([r[1:] for r in _POINTERS], "value", "kind"))(pointer_tokens)
query(_values([r[2:] for r in _SCALARS], "flag", "value"))(scalar_roots)
query(_values([r[2:4] for r in _PATTERNS], "whole", "part"))(regex_forms)
query(_values([(True,) for _ in _BAD_PATTERNS], "bad"))(regex_errors)
query(_values([r[1:] for r in _PATHS], "good"))(path_checks)
query(_values([r[1:] for r in _PATCH_TEXTS], "good"))(patch_texts)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def filter_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which no node is found: an anti-join of a filter with a negation."""
    d = orders(spark, sf_dir).select("o_orderkey", J.json_select_values("doc", "$.items[?@.q > 40]").alias("v"))
    all_keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return all_keys.join(d.where("size(v) > 0").select("o_orderkey"), "o_orderkey", "left_anti")


@query(f"SELECT c_custkey, o_orderkey {_JOIN} WHERE NOT (o_totalprice > 200000)")
def filter_negated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negated filter over the node table, as an anti-join."""
    found = _nodes(spark, sf_dir).select("$.orders[?!(@.o_totalprice > 200000) && !@.nothing].o_orderkey")
    return found.select("c_custkey", F.col("number").cast("bigint").alias("o_orderkey"))


@query(f"SELECT c_custkey, o_orderkey {_JOIN} WHERE o_totalprice < c_acctbal * 1 OR o_orderkey = c_custkey")
def filter_two_queries_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node compared with another one of the document, over the node table."""
    found = _nodes(spark, sf_dir).select("$.orders[?@.o_totalprice < $.c_acctbal || @.o_orderkey == $.c_custkey].o_orderkey")
    return found.select("c_custkey", F.col("number").cast("bigint").alias("o_orderkey"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-")
    return f"{found.rstrip('/')}/skarn-{name}-{uuid.uuid4().hex}"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
