"""Toxicity: held-out accuracy, folds, odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from skarn.llm import toxicity

BAD = ["grubl", "snarff", "plodd"]


def text(rng, toxic):
    words = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 120))]
    if toxic:
        for _ in range(rng.randint(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", "en", "er", "ish"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    docs = [(i, t, "x", 0.5) for i, t, _ in rows] + [(None, "grubl", "x", 0.5), (901, None, "x", 0.5), (902, "", "x", 0.5), (903, "grubl snarff " * 30_000, "x", 0.5), (5, rows[5][1], "x", 0.5)]
    labels = [(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (7, None), (99999, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_held_out(spark, tables):
    docs, labels, rows = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 905
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id)) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if fold(i)]
    assert np.mean([by[i].predicted == y for i, y in held]) > 0.97
    assert by[903].predicted == 1 and by[901].score == by[902].score < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels, _ = tables
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_bounds_and_empty(spark, tables):
    docs, labels, _ = tables
    at, w = toxicity.train(docs, labels, max_labelled=20)
    assert len(at) == len(w) <= (1 << toxicity.BITS) + 1
    assert [r.score for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()] == [0.5] * 3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_regularised_places_stay_out():
    state = toxicity.Ftrl(l1=1.0)
    for _ in range(50):
        state.learn(np.array([5, 9]), 1)
        state.learn(np.array([9]), 0)
    at, w = state.model()
    assert 5 in at and w[list(at).index(5)] > 0


def test_against_plain_loops(spark):
    """Weights of the array form against FTRL-proximal written out number by number."""
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(40), rng.randint(0, 9))), rng.randint(0, 1)) for _ in range(300)]
    state = toxicity.Ftrl(l1=0.7)
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else 0.7
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for at, label in rows:
        state.learn(np.array(at, np.int64), label)
        every = [*at, bias]
        w = {i: weight(i) for i in every}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in every:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    where, w = state.model()
    wanted = {i: weight(i) for i in z if weight(i)}
    assert len(wanted) > 10 and sorted(wanted) == where.tolist() and np.allclose([wanted[i] for i in where.tolist()], w, rtol=1e-9)


def slow_places(text):
    """Features of a text, place by place."""
    words, out = re.findall(r"\w+", text.lower()), set()
    mask = (1 << 64) - 1
    h = lambda w: xxhash.xxh64_intdigest(w.encode(), 7)
    salts = [int(s) for s in toxicity._SALTS]
    place = lambda x: (x * salts[0] & mask) >> 64 - toxicity.BITS
    for w in words:
        out |= {place(h(w)), *(place(h(w[:n] + "-")) for n in (4, 5) if len(w) > n)}
    for gap in (1, 2):
        for a, b in zip(words, words[gap:]):
            out.add(place((h(a) * salts[gap] & mask) ^ ((h(b) << 31 | h(b) >> 33) & mask)))
    return sorted(out)


def test_train_and_score_by_brute_force(spark):
    """The whole operator against rows learnt one by one in the documented order."""
    rng = random.Random(8)
    rows = [(i, text(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(4, rows[4][1])] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert all(toxicity.features(t).tolist() == slow_places(t) for _, t, _ in rows[:20])
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    turns = spark.createDataFrame([(e, r[0]) for e in range(toxicity.EPOCHS) for r in known], "epoch int, doc_id long").selectExpr("epoch", "doc_id", "xxhash64(epoch, doc_id) as turn").collect()
    state, by = toxicity.Ftrl(l1=toxicity.L1 * math.sqrt(len(known))), {r[0]: r for r in rows}
    for t in sorted(turns, key=lambda t: (t.epoch, t.turn, t.doc_id)):
        state.learn(np.array(slow_places(by[t.doc_id][1])), by[t.doc_id][2])
    at, w = state.model()
    weights = dict(zip(at.tolist(), w.tolist()))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for i, t, _ in rows:
        x = sum(weights.get(p, 0.0) for p in [*slow_places(t), 1 << toxicity.BITS])
        assert abs(got[i] - 1 / (1 + math.exp(-x))) < 1e-9


def test_clashing_names(spark, tables):
    docs, labels, _ = tables
    odd = docs.selectExpr("doc_id", "text", "'a' as __text", "5 as __score", "6 as __predicted")
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and {(r["__text"], r["__score"], r["__predicted"]) for r in kept.collect()} == {("a", 5, 6)}
    assert kept.count() == toxicity.drop_toxic(docs, labels).count()
