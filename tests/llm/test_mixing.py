"""Poisson replication: distribution, target weights, order, odd rows."""

import collections
import hashlib
import math

from skarn.llm import mixing


def rows(spark, n=400):
    data = [(i, "x" * (10 + i % 7), f"s{i % 3}" if i % 5 else "big", "keep") for i in range(n)]
    data += [(None, "null id", "s0", "a"), (None, "null id", "s0", "a"), (n, None, "s1", "b"), (n + 1, "no source", None, "c"), (n + 2, "", "rest", "d")]
    return spark.createDataFrame(data, "doc_id long, text string, source string, mix_copy string"), data


def drawn(seed, key, mean):
    """Copies by summing probabilities, in the slow way."""
    chunks, total = max(1, math.ceil(mean / 16)), 0
    for i in range(chunks):
        u = (int(hashlib.md5(f"{seed}|{key}|{i}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
        m, k = mean / chunks, 0
        p = c = math.exp(-m)
        while c <= u:
            k += 1
            p *= m / k
            c += p
        total += k
    return total


def test_counts_and_order(spark):
    docs, data = rows(spark)
    weights = {"s0": 0.6, "s1": 0.1, "big": 0.001, "none": 0.2, "*": 0.3}
    out = mixing.replicate(docs, weights, "t")
    assert out.columns == ["doc_id", "text", "source", "mix_copy", "mix_key"]
    size = collections.Counter()
    group = lambda s: s if s in weights and s != "*" else "*"
    for _, text, source, _ in data:
        size[group(source)] += len(text or "")
    total = sum(size.values())
    wanted = collections.Counter()
    for d, text, source, _ in data:
        mean = weights[group(source)] / sum(weights.values()) * total / size[group(source)]
        wanted[d, text, source] += drawn("t", hashlib.md5((text or "").encode()).hexdigest() if d is None else d, mean)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got) == +wanted
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert got == mixing.replicate(docs.repartition(5), weights, "t").collect()
    assert max(r.mix_copy for r in got) >= 3


def test_large_rates_and_weights(spark):
    docs = spark.createDataFrame([(i, "ab", "tiny" if i < 4 else "huge") for i in range(800)], "doc_id long, text string, source string")
    got = collections.Counter(r.source for r in mixing.replicate(docs, {"tiny": 0.5, "huge": 0.5}).collect())
    assert abs(got["tiny"] - 400) < 100 and abs(got["huge"] - 400) < 100
    assert mixing.replicate(docs, {"huge": 1.0}).where("source = 'tiny'").count() == 0
    assert mixing.replicate(docs.limit(0), {"huge": 1.0}).count() == 0 and mixing.replicate(docs, {}).count() == 0


def test_no_python(spark):
    docs, _ = rows(spark, 10)
    plan = mixing.replicate(docs, {"s0": 1.0, "*": 1.0})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_of_copies(spark, monkeypatch):
    """Rows of large rates are exploded in blocks that are dealt out, to the same copies."""
    docs = spark.createDataFrame([(i, "ab", "tiny" if i < 2 else "huge", "x") for i in range(9000)], "doc_id long, text string, source string, __n string")
    whole = mixing.replicate(docs, {"tiny": 0.9, "huge": 0.1}, "b")
    assert "RoundRobin" not in (plan := whole._jdf.queryExecution().toString()) and plan.count("Generate") > 0
    wanted = collections.Counter((r.doc_id, r.mix_copy, r.mix_key) for r in whole.collect())
    rate = 0.9 * 9000 / 2
    assert collections.Counter(k[0] for k in wanted if k[0] < 2) == {i: drawn("b", i, rate) for i in range(2)}
    monkeypatch.setattr(mixing, "BLOCK", 1 << 40)
    assert collections.Counter((r.doc_id, r.mix_copy, r.mix_key) for r in mixing.replicate(docs, {"tiny": 0.9, "huge": 0.1}, "b").collect()) == wanted


def test_clashing_names(spark):
    data = [(i, "ab", "s", 7, "k", 8, "x") for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, __n int, __key string, __first int, MIX_KEY string")
    out = mixing.replicate(docs, {"*": 1.0})
    assert out.columns == ["doc_id", "text", "source", "__n", "__key", "__first", "mix_copy", "mix_key"]
    assert {(r["__n"], r["__key"], r["__first"]) for r in out.collect()} == {(7, "k", 8)}
