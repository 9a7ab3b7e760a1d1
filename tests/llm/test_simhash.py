"""SimHash: fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from skarn.llm import base as shared
from skarn.llm import overlap, simhash

ODD = ["", None, "a", "A b", "a b c d", "Straße ÄÖ Ünique x", "a\x0bb\x0cc\td\ne f", "x " * 5000, " ", "a b c d e", "a b c d e"]


def slow_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, d=4):
    """{row: smallest id reachable} by comparing all."""
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash.fingerprint(text or "").tolist() == [slow_fingerprint(text)]
    wide = simhash.fingerprint(text or "", words=4)
    assert wide[0] == slow_fingerprint(text) and len(wide) == 4


def clustered(n, seed=1):
    """Fingerprints of which many are a few bits apart."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("thresholds", [None, [(0, 21, 1), (21, 42, 1), (42, 64, 0)], [(0, 32, 2), (32, 64, 1)]])
@pytest.mark.parametrize("bucket_rows", [64, 50_000])
def test_links(spark, thresholds, bucket_rows):
    fps = sorted(set(clustered(600)))
    rows = spark.createDataFrame([([simhash._signed(x)],) for x in fps], "fp array<bigint>")
    parts = [(0, simhash.mask_of(list(range(a, b))), t) for a, b, t in thresholds] if thresholds else simhash.plan_parts(np.array(fps, np.uint64)[:, None], len(fps))
    found = simhash.links(rows, parts, bucket_rows=bucket_rows).distinct()
    edges = [(a[0], b[0]) for a, b in found.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges)
    root = {r.node[0]: r.root[0] for r in simhash.roots(found).collect()}
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(root.get(simhash._signed(x), simhash._signed(x)), set()).add(i)
    wanted = {}
    for i, x in enumerate(components(fps, range(len(fps)))):
        wanted.setdefault(x, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_thresholds_cover():
    rng = np.random.default_rng(3)
    for words, reach in ((1, 4), (2, 9), (4, 31)):
        sample = rng.integers(0, 2**63, (300, words), dtype=np.uint64)
        for n in (10, 10**6, 10**9, 10**12):
            parts = simhash.plan_parts(sample, n, reach)
            assert sum(t + 1 for _, _, t in parts) == reach + 1
            masks = [m << 64 * w for w, m, _ in parts]
            assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


@pytest.mark.parametrize("n", [3, 40, 200, 1000])
def test_forest(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, (5, 2), dtype=np.uint64)
    fps = centres[rng.integers(0, 5, n)].copy()
    flip = rng.random((n, 2, 64)) < 0.04
    fps ^= np.packbits(flip, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    fps = np.unique(np.concatenate((fps, rng.integers(0, 2**63, (n // 2, 2), dtype=np.uint64))), axis=0)
    as_int = [int(a) | int(b) << 64 for a, b in fps]
    edges = simhash.forest_of(fps, 9)
    assert all((as_int[a] ^ as_int[b]).bit_count() <= 9 for a, b in edges)
    forest = simhash._Forest()
    assert all(forest.link(a, b) for a, b in edges)
    wanted = components(as_int, range(len(as_int)), 9)
    assert [forest.find(i) for i in range(len(as_int))] == wanted


def edited(rng, words, share):
    """A copy of which about so many words are others."""
    return [w if rng.random() > share else "".join(rng.choices("klmnopq", k=6)) for w in words]


def test_stage_finds_edited_copies(spark):
    """Copies with shingles that overlap by 0.82 or more go, other texts stay."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    texts, near, shingles = [], 0, lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.choice([60, 200, 800]))
        texts.append((1000 + i, " ".join(words)))
        copy = edited(rng, words, 0.014)
        a, b = shingles(words), shingles(copy)
        if copy != words and len(a & b) / len(a | b) >= 0.82:
            texts.append((5000 + i, " ".join(copy)))
            near += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert near > 60 and kept >= {i for i, _ in texts if i < 5000}
    assert len(kept) - 150 <= 0.06 * near


def test_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(10)]
    texts = list(ODD)
    for b in base:
        texts += [b, b.upper(), b.replace("\n", "  ")]
        parts = b.split()
        parts[rng.randrange(200)] = "changed"
        texts.append(" ".join(parts))
    ids = [*range(3, 3 + len(texts) - 1), None]
    docs = spark.createDataFrame(list(zip(ids, texts, ["clash"] * len(texts), [1] * len(texts))), "doc_id long, text string, fp string, component_id long")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [slow_fingerprint(t) for t in texts]
    wanted = sorted((i is None, i, f"{f:016x}", c) for i, f, c in zip(ids, fps, components(fps, ids)))
    assert got == wanted
    kept = simhash.drop_near_duplicates(docs, k=4, words=1, d=4, probed=1, reach=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[3] for w in wanted})


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    same = spark.createDataFrame([(1, "x y")] * 3 + [(None, "x y"), (None, None)], "doc_id long, text string")
    assert [r.component_id for r in same.transform(simhash.near_duplicates).orderBy("component_id").collect()] == [None, 1, 1, 1, 1]
    assert sorted(map(str, (r.doc_id for r in simhash.drop_near_duplicates(same).collect()))) == ["1", "None"]


def overlap_of(one, two):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    a, b = shingles(one), shingles(two)
    return len(a & b) / len(a | b)


def family(seed, groups, copies, least=60, most=400):
    """Texts by id; each group has edited copies of one text, whose overlaps lie on both sides of 0.8."""
    rng, texts = random.Random(seed), {}
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    line = " ".join(rng.choices(vocabulary, k=12))
    for g in range(groups):
        words = rng.choices(vocabulary, k=rng.randint(least, most))
        texts[g * 1000] = " ".join([*words, line])
        for c in range(1, copies):
            texts[g * 1000 + c] = " ".join([*edited(rng, words, rng.uniform(0.002, 0.035)), line])
    return texts


def wanted_of(texts):
    """The smallest id of each component of all pairs with an overlap of 0.8 or more, and the numbers of pairs by side."""
    forest, near, far = simhash._Forest(), 0, 0
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if a // 1000 == b // 1000:
                o = overlap_of(texts[a], texts[b])
                near, far = near + (o >= 0.8), far + (0.65 <= o < 0.8)
                if o >= 0.8:
                    forest.link(a, b)
    return {forest.find(i) for i in ids}, near, far


def test_stage_finds_every_pair(spark):
    """All pairs with an overlap of 0.8 or more, at whatever distance of their fingerprints."""
    texts = family(3, 250, 2)
    wanted, near, _ = wanted_of(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert near > 100 and not kept - wanted


def test_large_buckets(spark):
    """A large group of near copies takes several rounds, and gives the components of brute force."""
    texts = family(8, 2, 120, 100, 200)
    wanted, near, far = wanted_of(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert near > 1000 and far > 1000
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == wanted


@pytest.mark.parametrize("block", [5, 40])
@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_large_buckets_in_blocks(spark, monkeypatch, block, broadcast):
    """The same when buckets are cut into blocks, with and without a broadcast of them."""
    monkeypatch.setattr(overlap, "BLOCK_ROWS", block)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    texts = family(9, 2, 90, 100, 200)
    wanted, near, far = wanted_of(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert near > 500 and far > 500
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == wanted


def test_blocks(spark):
    """Each two rows of a large bucket meet once and on different sides, or in one block, but for two of its main component;
    small buckets stay whole."""
    rows = [(key, sid, 1, 7 if sid % 4 else sid, [0]) for key, n in ((1, 50), (2, 9), (3, 31)) for sid in range(n)]
    rows += [(4, sid, 1, 7, [0]) for sid in range(40)]
    known = spark.createDataFrame(rows, "key long, sid long, n int, root long, sketch array<long>")
    large = overlap.large_buckets(known.select("key", "sid"), known, 10)
    assert {r.key: (r["count"], r.most, r.own, r.others) for r in large.collect()} == {1: (50, 7, 4, 2), 3: (31, 7, 3, 1), 4: (40, 7, 4, 0)}
    met, whole, places = {}, {}, {}
    for r in overlap.dealt(known, large, len(rows)).collect():
        places.setdefault((r.key, r.sub), []).append((r.sid, r.side, r.root))
        whole[r.key, r.sid] = r.sub == 0 and r.cut == 1
    for (key, _), here in places.items():
        for x, (a, side, root) in enumerate(here):
            for b, other, second in here[x + 1 :]:
                if root != second and (side == 0 or side != other):
                    pair = (key, min(a, b), max(a, b))
                    met[pair] = met.get(pair, 0) + 1
    roots = {(key, sid): root for key, sid, _, root, _ in rows}
    assert set(met) == {(k, a, b) for k, n in ((1, 50), (2, 9), (3, 31)) for a in range(n) for b in range(a + 1, n) if roots[k, a] != roots[k, b]}
    assert set(met.values()) == {1}
    assert all(w == (key == 2) for (key, _), w in whole.items()) and not any(k == 4 for k, _ in whole)


def test_stage_keeps_lesser_overlaps(spark):
    """No document goes for overlaps below 0.8 alone."""
    texts = family(4, 250, 2)
    wanted, _, far = wanted_of(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert far > 40 and not wanted - kept


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_roots(spark, monkeypatch, few):
    """Components of random links, chains and a hub, by rounds of all tasks, by one task, and by both."""
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 10)
    rng, forest = random.Random(4), simhash._Forest()
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2400)]
    for a, b in pairs:
        forest.link(a, b)
    got = {r.node: r.root for r in simhash.roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got.keys() == {x for a, b in pairs if a != b for x in (a, b)}
    groups = [{}, {}]
    for x, root in got.items():
        groups[0].setdefault(root, set()).add(x)
        groups[1].setdefault(forest.find(x), set()).add(x)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))
