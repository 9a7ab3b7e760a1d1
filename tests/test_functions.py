"""Column functions, SQL, native and relational plans, sources, streaming, on a session."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skarn import catalog, operators, sources, streaming
from skarn import functions as J
from skarn.core import values
from skarn.core.errors import ParseError, PatchError, PathError, PointerError
from skarn.core.evaluate import select, select_values
from skarn.core.jsonpath import compile_path
from skarn.core.parse import parse
from skarn.plans import lowering
from skarn.plans.nodes import NodeTable, NotRelational, shred

DOCS = [
    '{"a": 1, "b": [1, 2.5, "x", null, true], "c": {"d": "é", "e": []}}',
    '{"a": "1", "b": {"x": 1}, "n": null}',
    "[3, [4, {\"a\": 5}], 7.0]",
    '"text"',
    "null",
    " 12 ",
    "{} 1",
    '{"k": 1, "k": 2}',
    None,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string").cache()


def column(docs, c):
    return [r[0] for r in docs.orderBy("id").select(c).collect()]


def test_parse_and_types(docs):
    assert column(docs, J.json_valid("doc")) == [True] * 6 + [False, False, None]
    assert column(docs, J.json_type("doc")) == ["object", "object", "array", "string", "null", "number", None, None, None]
    errors = column(docs, J.try_json_parse("doc"))
    assert [e and (e.value, e.error and (e.error.kind, e.error.pos)) for e in errors][5:] == [("12", None), (None, ("UnexpectedToken", 3)), (None, ("DuplicateName", 9)), None]
    assert column(docs, J.json_is_null("doc")) == [False] * 4 + [True, False, None, None, None]
    assert column(docs, J.json_object_entries("doc"))[1] == [("a", '"1"'), ("b", '{"x":1}'), ("n", "null")]
    assert column(docs, J.json_array_items("doc"))[2] == ["3", '[4,{"a":5}]', "7"]
    good = docs.where("id < 6")
    assert column(good, J.json_long("doc")) == [None] * 5 + [12] and column(good, J.json_double("doc")) == [None] * 6
    assert column(good, J.json_str("doc"))[3] == "text" and column(good, J.json_number("doc"))[5] == "12"
    assert column(good, J.json_decimal("doc", 10, 2))[4:] == [None, 12]
    with pytest.raises(Exception, match="UnexpectedToken"):
        docs.select(J.json_parse("doc")).collect()


def test_binary(spark):
    rows = spark.createDataFrame([(0, bytearray(b'{"a": "\xc3\xa9"}')), (1, bytearray(b'"\xff"'))], "id int, doc binary")
    assert column(rows, J.json_valid("doc")) == [True, False]
    assert column(rows, J.try_json_parse("doc"))[0].value == '{"a":"é"}'


def test_access(docs):
    good = docs.where("id < 6")
    assert column(good, J.json_get("doc", "a")) == ["1", '"1"', None, None, None, None]
    assert column(good, J.json_get("doc", 1)) == [None, None, '[4,{"a":5}]', None, None, None]
    assert column(good, J.json_get("doc", "n"))[1] == "null"
    taken = column(good, J.json_take("doc", "a"))
    assert taken[1] == ('"1"', '{"a":null,"b":{"x":1},"n":null}') and taken[2] == (None, '[3,[4,{"a":5}],7]') and column(good, J.json_take("doc"))[3] == ('"text"', "null")
    objects = docs.where("id < 2")
    assert column(objects, J.json_pointer("doc", "/c/d")) == ['"é"', None] and column(good, J.json_pointer("doc", ""))[3] is None
    tried = column(good, J.try_json_pointer("doc", "/a"))
    assert tried[0] == ("1", None) and tried[2].value is None and tried[2].error.kind == "InvalidIndex" and tried[3] == (None, None)
    assert column(objects, J.json_pointer("doc", F.lit("/b"))) == ['[1,2.5,"x",null,true]', '{"x":1}']


def test_paths(docs):
    good = docs.where("id < 6")
    assert column(good, J.json_select("doc", "$..a"))[2] == [("$[1][1]['a']", "5")]
    assert column(good, J.json_select_paths("doc", "$.*"))[1] == ["$['a']", "$['b']", "$['n']"]
    assert column(good, J.json_select_values("doc", F.when(F.col("id") == 0, "$.a").otherwise("$")))[:2] == [["1"], ['{"a":"1","b":{"x":1},"n":null}']]
    many = column(good, J.json_select_many("doc", {"a": "$.a", "all": "$.*"}))
    assert many[1] == (['"1"'], ['"1"', '{"x":1}', "null"])
    assert column(good, J.npath_to_pointer(F.lit("$['a'][0]")))[0] == "/a/0"


def test_plan_time_errors():
    with pytest.raises(PathError):
        J.json_select("doc", "$[")
    with pytest.raises(PointerError):
        J.json_pointer("doc", "x")
    with pytest.raises(PatchError):
        J.json_modify("doc", "[{}]")


def test_changes(docs):
    good = docs.where("id < 3")
    patch = '[{"op": "add", "path": "/z", "value": {"q": 1}}, {"op": "test", "path": "/a", "value": 1}]'
    got = column(good, J.json_modify("doc", patch))
    assert got[0].error is None and got[0].doc.endswith('"z":{"q":1}}')
    assert got[1].doc.endswith('"z":{"q":1}}') and (got[1].error.kind, got[1].error.pos) == ("NotEqual", 1)
    got = column(good, J.json_try_modify("doc", F.lit(patch)))
    assert got[1].doc == '{"a":"1","b":{"x":1},"n":null}' and got[2].error.kind == "Pointer"


def test_comparison(docs):
    one = docs.limit(1)
    q = lambda c: one.select(c).first()[0]
    assert q(J.json_equals(F.lit('{"a":1,"b":2.0}'), F.lit('{"b":2,"a":1}'))) and not q(J.json_equals(F.lit("1"), F.lit("1.0"), "reference"))
    assert q(J.json_compare(F.lit("1"), F.lit("2"))) == -1 and q(J.json_compare(F.lit("1"), F.lit('"2"'))) is None
    assert q(J.json_hash(F.lit('{"a":1,"b":2}'))) == q(J.json_hash(F.lit('{"b":2.0,"a":1}')))
    assert q(J.json_literal({"a": [1, None, "é"]})) == '{"a":[1,null,"é"]}' and q(J.json_pretty(F.lit("[]"))) == "[]"
    assert [q(J.json_from(c)) for c in (F.lit(1), F.lit('a"b'), F.lit(None).cast("string"), F.array(F.lit(1)))] == ["1", '"a\\"b"', "null", "[1]"]


def test_sql(spark, docs):
    J.register(spark)
    docs.where("id < 6").createOrReplaceTempView("skarn_docs")
    got = spark.sql("SELECT id, json_type(doc) t, CASE WHEN id < 2 THEN json_pointer(IF(id < 2, doc, 'null'), '/a') END p, json_select_values(doc, '$.b[*]') v FROM skarn_docs ORDER BY id").collect()
    assert got[0] == (0, "object", "1", ["1", "2.5", '"x"', "null", "true"]) and got[3].p is None
    each = spark.sql("SELECT id, e.* FROM skarn_docs, LATERAL json_each(doc, '$[?@ > 2]') e ORDER BY id, pos").collect()
    assert [tuple(r) for r in each] == [(2, 0, "$[0]", "3"), (2, 1, "$[2]", "7")]


PATHS = [
    "$", "$.a", "$['b']", "$.b[0]", "$.b[-1]", "$.b[-9]", "$.b[*]", "$.b[1:3]", "$.b[::-1]", "$.b[3:0:-2]", "$.b[-2:]", "$.b[5:]", "$.b[?@ > 1]", "$.b[?@ == null]", "$.b[?@ != 'x']", "$.b[?@ == true || @ == 'x']",
    "$.b[?!(@ >= 2)]", "$.b['x','y',0]", "$.b[?length(@) == 1]", "$.b[?match(@, '[a-z]')]", "$.b[?search(@, 'x')]", "$.b[?@.q]", "$.b[?@.q > 1 && @.r]", "$.b[?!@.q]", "$.b[?@.q < $.a]",
    "$.b[?count(@[*]) == 2]", "$.b[?value(@['q','zz']) == 2]", "$.b[?@[?@ == 2]]", "$.b[?@.q != 2]", "$.b[?2 < @]", "$.b[?1 == 1.0]", "$.b[?count(@.*)]", "$.b[*].q", "$.b[0,0]", "$.b[?length(@.r) > 1].r",
]


def random_documents(n):
    rng = random.Random(7)
    leaf = lambda: rng.choice([0, 1, 2, 2.5, -1, "x", "xy", "", None, True, False, 1.0])
    item = lambda: rng.choice([leaf, leaf, lambda: {"q": leaf(), "r": leaf()}, lambda: {"q": leaf()}, lambda: [leaf(), leaf()], dict, list])()
    return [json.dumps({"a": leaf(), "b": [item() for _ in range(rng.randrange(6))]} if rng.random() < 0.9 else rng.choice([{"b": {"x": leaf(), "y": leaf()}}, leaf(), [item()], {}])) for _ in range(n)]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame(list(enumerate(random_documents(120))), "id int, doc string").cache()


@pytest.mark.parametrize("path", PATHS)
def test_native_agrees(many, path):
    assert lowering.is_native(path)
    rows = many.withColumn("v", lowering.parsed("doc"))
    got = rows.orderBy("id").select("doc", F.transform(lowering.native_values(F.col("v"), path), lambda x: F.to_json(x)).alias("n")).collect()
    query = compile_path(path)
    for r in got:
        wanted = select_values(parse(r.doc), query)
        assert [json.loads(x) for x in r.n] == wanted or _sorted(r.n, wanted, path, r.doc), (path, r.doc)


def _sorted(got, wanted, path, doc):
    """Members come by name; all else is equal in order."""
    key = lambda x: json.dumps(x, sort_keys=True)
    return isinstance(parse(doc).get("b"), dict) and sorted(map(key, map(json.loads, got))) == sorted(map(key, wanted))


def test_not_native():
    for path in ("$..a", "$[?@.a == @.b]", "$[?match(@.a, @.b)]", "$[?match(@, '(a*)*b')]", "$[?@.* == 1]"):
        assert not lowering.is_native(path)


def test_native_stays_in_the_jvm(many):
    plan = many.select(F.explode(lowering.native_values(lowering.parsed("doc"), "$.b[?@.q > 1].r")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


RELATIONAL = [
    "$", "$.a", "$.b[*]", "$.b[0]", "$.b[-1]", "$.b[1:4:2]", "$.b[::-1]", "$..q", "$..[0]", "$..*", "$.b[0,1]", "$..['q','r']", "$.b[?@.q]", "$.b[?!@.q]", "$.b[?@.q > 1 || @.r == 'x'].r", "$.b[?@ != 2]", "$[?@ == 1]",
    "$..[?@.q == null]", "$.b[?$.a]", "$.b[?$.a == 1]", "$.b[?@[0] == 2]", "$.b[::0]", "$.b[-3:-1]", "$['b','a']",
]


@pytest.mark.parametrize("path", RELATIONAL)
def test_nodes_agree(many, path, shredded):
    got = {}
    for r in shredded.select(path).select("id", "ord", "npath").collect():
        got.setdefault(r.id, []).append((r.ord, r.npath))
    query = compile_path(path)
    for i, doc in many.collect():
        assert [p for _, p in sorted(got.get(i, []))] == [p for p, _ in select(parse(doc), query)], (path, doc)


@pytest.fixture(scope="module")
def shredded(many):
    return NodeTable(shred(many, "doc", "id").cache(), "id")


def test_nodes(docs, shredded):
    rows = shred(docs, "doc", "id").where("id = 0").orderBy("node").collect()
    assert [(r.node, r.last, r.parent, r.depth, r.kind) for r in rows[:4]] == [(0, 10, None, 0, "object"), (1, 1, 0, 1, "number"), (2, 7, 0, 1, "array"), (3, 3, 2, 2, "number")]
    assert shred(docs, "doc", "id").where("id >= 6").count() == 0
    with pytest.raises(NotRelational):
        shredded.select("$[?length(@) > 1]")


def test_operators(docs, spark):
    good, bad = operators.split_valid(docs.where("doc is not null"), "doc")
    assert good.count() == 6 and sorted(r.error.kind for r in bad.collect()) == ["DuplicateName", "UnexpectedToken"]
    rows = operators.select_nodes(good, "doc", "$.b[*]").orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.value) for r in rows[:2]] == [(0, 0, "1"), (0, 1, "2.5")]
    assert operators.select_nodes(good, "doc", "$.zz", outer=True).count() == 6
    assert operators.extract(good, "doc", {"a": "$.a", "d": "$.c.d"}).orderBy("id").first() == (0, "1", '"é"')
    changed = operators.change(good, "doc", '[{"op": "remove", "path": "/a"}]').orderBy("id").collect()
    assert changed[1].doc == '{"b":{"x":1},"n":null}' and changed[3].error.kind == "PathNotFound"
    same = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":2.0,"a":1}',), ("[1]",), (None,)], "doc string")
    assert sorted(r.n for r in operators.distinct_documents(same, "doc").collect()) == [1, 2]


def test_sources(spark, docs, tmp_path):
    good, _ = operators.split_valid(docs.where("doc is not null"), "doc")
    sources.write_json_lines(good.select(J.json_compact("doc").alias("doc")), "doc", str(tmp_path / "lines"))
    assert sources.json_lines(spark, str(tmp_path / "lines")).where(J.json_valid("doc")).count() == 6
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "one.json").write_bytes(b'\xef\xbb\xbf{"a": [1]}')
    (tmp_path / "files" / "two.json").write_bytes(b'"\xff"')
    files = sources.json_files(spark, str(tmp_path / "files")).orderBy("path")
    assert [r[0] for r in files.select(J.json_valid("doc")).collect()] == [True, False]
    people = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    things = spark.createDataFrame([(1, 5), (1, 3)], "of int, x int")
    got = dict(sources.nested(people, things, "k", "of", "things", ["x"]).collect())
    assert got == {1: '{"k":1,"name":"a","things":[{"x":3},{"x":5}]}', 2: '{"k":2,"name":"b","things":[]}'}


def test_streaming(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 6}:00", json.dumps({"k": i % 2})) for i in range(12)] + [("2024-01-01 00:00:00", "{bad")]
    data = spark.createDataFrame(rows, "ts string, doc string").select(F.to_timestamp("ts").alias("ts"), "doc")
    data.write.parquet(str(tmp_path / "in"))
    stream = streaming.table_stream(spark, str(tmp_path / "in"), data.schema)
    counts = streaming.windowed_counts(streaming.valid_documents(stream, "doc"), "doc", "$.k", "ts", "3 minutes", "1 minute", "bigint")
    run = counts.writeStream.format("memory").queryName("skarn_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.window.start.minute, r.value, r.n) for r in spark.table("skarn_counts").collect())
    assert got == [(0, 0, 4), (0, 1, 2), (3, 0, 2), (3, 1, 4)]


def test_errors_are_equal_by_value():
    assert ParseError("A", 1) == ParseError("A", 1) and ParseError("A", 1) != PathError("A", 1) and "at index 1" in str(ParseError("A", 1))


def test_integers_of_many_digits(spark):
    """Exact numbers have no bound on their digits."""
    whole = "1" + "0" * 5000
    docs = [f"[{whole}]", f"[{whole}.50]", "[-" + "9" * 4301 + "]", "[123456789012345678901234567890123456789.5]", f"[{whole}"]
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select(J.try_json_parse("d", exact=True).alias("r")).collect()
    assert [r.r.value for r in rows] == [*docs[:4], None] and rows[4].r.error.kind == "UnexpectedEof"
    assert values.canonical(parse(docs[3], True)) == docs[3] and values.canonical(parse(docs[1], True)) == docs[1].replace(".50", ".5")
    assert not values.equals(parse(docs[0], True), parse(f"[{whole[:-1]}1]", True))


def test_errors_as_columns(spark):
    rows = spark.createDataFrame([("$.a",), ("$[",), (None,)], "p string").select(J.json_path_error("p").alias("e"), J.json_regex_error("p").alias("r")).collect()
    assert rows[0].e is None and rows[1].e.kind and rows[1].e.pos is not None and rows[2].e is None and rows[1].r.kind


def test_node_table_compares_queries(spark):
    """A comparison of two singular queries over the node table gives what the exact evaluator gives."""
    docs = ['{"t":3,"l":[{"x":3,"y":3},{"x":2,"y":"2"},{"x":null,"y":null},{"y":1},{},{"x":true,"y":true},{"x":"a","y":"b"},{"x":5,"y":4}]}', '{"l":[{"x":1},{}]}', '{"t":"b","l":[{"x":"a"},{"x":[1],"y":2}]}']
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, d string")
    nodes = NodeTable(shred(rows, "d", "id"), "id")
    for op in ("==", "!=", "<", "<=", ">", ">="):
        for other in ("@.y", "$.t"):
            path = f"$.l[?@.x {op} {other}]"
            wanted = sorted((r.id, p) for r in rows.select("id", J.json_select_paths("d", path).alias("p")).collect() for p in r.p)
            assert sorted((r.id, r.npath) for r in nodes.select(path).collect()) == wanted, path
    both = spark.createDataFrame([(1, '[{"x":[1],"y":[1]}]')], "id long, d string")
    with pytest.raises(Exception, match="exact evaluator"):
        NodeTable(shred(both, "d", "id"), "id").select("$[?@.x == @.y]").collect()


def test_types_of_nodes(spark):
    d = spark.createDataFrame([('{"a":[1,"x",null,true,{}]}',)], "d string")
    assert d.select(J.json_select_types("d", "$..*").alias("t")).first().t == ["array", "number", "string", "null", "boolean", "object"]


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(df):
    """Rows of the largest batch that a Python function gets of df's documents."""
    import pyarrow as pa

    def rows(a: pa.Array) -> pa.Array:
        return pa.array([len(a)] * len(a), pa.int64())

    return df.select(F.arrow_udf(rows, "bigint")("d").alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("use", [lambda df: df.select(J.json_valid("d")), lambda df: df.select(J.json_try_modify("d", "[]")), lambda df: shred(df, "d", "id"), lambda df: J.register(df.sparkSession)])
def test_batches_to_python_are_bounded_by_bytes(spark, use):
    """Whatever a batch's 10,000 rows would hold; a limit that is set is kept."""
    d = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit('["'), F.repeat(F.lit("x"), 8000), F.lit('"]')).alias("d"))
    before = spark.conf.get(LIMIT, None)
    try:
        spark.conf.unset(LIMIT)
        use(d)
        assert largest_batch(d) * 8000 < 3_000_000
        spark.conf.set(LIMIT, "1m")
        use(d)
        assert spark.conf.get(LIMIT) == "1m"
    finally:
        spark.conf.set(LIMIT, before) if before else spark.conf.unset(LIMIT)


def test_tables_bound_batches_of_their_own_session(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t.parquet"))
    other = spark.newSession()
    other.conf.unset(LIMIT)
    catalog.table(other, str(tmp_path), "t")
    assert other.conf.get(LIMIT, None)


def test_values_after_a_patch(docs, spark):
    """As a path over the changed document, without printing it and parsing it again."""
    good = docs.where("id < 6 or id = 8")
    for patch in ('[{"op": "add", "path": "/b", "value": [7, null]}, {"op": "remove", "path": "/a"}]', "[]", '[{"op": "copy", "from": "/a", "path": "/b/-"}]'):
        for path in ("$.b[-1]", "$.*", "$..a"):
            for p in (patch, F.lit(patch)):
                got = column(good, J.json_try_modify_values("doc", p, path))
                twice = good.withColumn("c", J.json_try_modify("doc", p)).select("id", J.json_select_values("c.doc", path).alias("v"), "c.error").orderBy("id").collect()
                assert [g and (g["values"], g.error) for g in got] == [(r.v, r.error) if r.v is not None else None for r in twice], (patch, path)
    whole = spark.createDataFrame([('{"a":1e300,"b":[]}',)], "doc string")
    got = whole.select(J.json_try_modify_values("doc", '[{"op": "copy", "from": "/a", "path": "/b/-"}]', "$.b[*]").alias("r")).first().r
    assert got == (["1" + "0" * 300], None)
    for wrong in (("[", "$"), ("[]", "$[")):
        with pytest.raises((PatchError, PathError)):
            J.json_try_modify_values("doc", *wrong)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith("patch_") and n in catalog._PATCHES])
def test_patch_queries_pass_documents_to_python_once(spark, tmp_path, name):
    spark.createDataFrame([(i, f"c{i}", i / 4) for i in range(4)], "c_custkey long, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(10 + i, i % 3, "F", 1e20 * i, None) for i in range(7)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()[name](spark, str(tmp_path))
    wanted = catalog._PATCHES[name][2]
    assert sorted(map(tuple, got.collect())) == [(i, i if wanted == "c_custkey" else wanted and int(wanted), True) for i in range(4)]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 1
