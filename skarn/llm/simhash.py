"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has one or more words of 64 bits.  Their bits are grouped into parts, correlated bits together; part i
gets a threshold t_i with sum(t_i + 1) = reach + 1, so two fingerprints at distance `reach` or less differ in at most t_i
bits of at least one part.  The number of parts and the thresholds come from a dynamic programme over estimated costs:
rows of signatures and candidate pairs, the latter from a bounded sample of fingerprints.  A fingerprint meets its
partners in buckets (part, bits of the part), its own and those within t_i; each bucket is verified by popcount at
distance d and reduced to a spanning forest, so a group of n copies gives n - 1 links and never n * n.  With parts over
all words and reach = d no link is lost; beyond that, links are found with a probability that many parts make high.
Buckets above `bucket_rows` are dealt anew by the bits outside the part, which is exact, until they fit.  Components
come from contraction rounds over the links.

Nulls and ties: a null text counts as empty; texts without words have fingerprint zero; a null doc_id is a document
of its group but never names it (component_id is null only where all ids of the group are null).  Repeated rows stay
rows.  An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Of the deduplicating stage; what it links by is in `overlap`.
DEDUP_SHINGLE = 5
#: Fingerprints that the estimate of candidate counts reads, at most.
SAMPLE = 2048
#: Rows of a bucket that one task holds; 64 at least, so that larger buckets have bits left to be dealt by.
BUCKET_ROWS = 50_000
#: Microseconds of one signature row (made, shuffled, sorted) and of one word of a candidate pair.
ROW_COST, PAIR_COST = 4.0, 0.002
#: Largest threshold of a part; its flips are listed in the plan.
MOST = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15
#: Multipliers of a 64-bit finaliser, from which further words are made.
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingle_spans(text: str, k: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by one space, and the byte spans of all k-word shingles in it."""
    words = text.encode().translate(LOWER).split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(words) else ends
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    elif len(words):
        starts, ends = starts[:1], ends[-1:]
    return joined, starts.tolist(), ends.tolist()


def mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def _word(h: np.ndarray, j: int) -> np.ndarray:
    """The hashes as they count for word j: themselves, or mixed anew."""
    return mixed(h + np.uint64(j * int(_MIX[0]) & (1 << 64) - 1)) if j else h


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = sum((_set_bits(h[i : i + _CHUNK]) for i in range(0, len(h), _CHUNK)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, k: int = SHINGLE, words: int = 1) -> np.ndarray:
    """Bit b of a word is 1 if it is set in over half of the shingles' hashes; all 0 without words."""
    joined, starts, ends = shingle_spans(text, k)
    digest, counts = xxhash.xxh64_intdigest, np.zeros((words, BITS), np.int64)
    for i in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], "<u8")
        for j in range(words):
            counts[j] += _set_bits(_word(h, j))
    return np.packbits(2 * counts > len(starts), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE, words: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, the fingerprint's words as signed longs; one row per row."""
    mine = docs.select(*(docs[c] for c in keep), base.text_of(docs, text).alias("__text"))
    schema = T.StructType([*(mine.schema[c] for c in keep), T.StructField("fp", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), k, words) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), _column(np.array(found, np.uint64).reshape(-1, words))], [*keep, "fp"])

    return base.mapped(mine, run, schema)


def _column(fps: np.ndarray) -> pa.Array:
    """Rows of words as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * fps.shape[1]), pa.array(fps.reshape(-1).view(np.int64)))


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, words)


# ---- parts and thresholds


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m parts of one word, of nearly equal width; each grows from the strongest remaining pair by the bit most
    correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        if i == m - 1:
            parts.append(left)
            break
        seed = max(left, key=lambda b: (corr[b, left].max(), -b))
        part = [seed]
        left = [b for b in left if b != seed]
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def mask_of(part: list[int]) -> int:
    return sum(1 << b for b in part)


def plan_parts(sample: np.ndarray, n: int, reach: int = DISTANCE, verified: int = 1) -> list[tuple[int, int, int]]:
    """(word, mask, threshold) of each part that is probed, for n fingerprints: the cheapest allocation over all numbers
    of parts up to reach + 1.  sample: rows of the words that have parts; verified: how many words a pair compares."""
    words = sample.shape[1]
    best: tuple[float, list[tuple[int, int, int]]] = (math.inf, [])
    i, j = np.triu_indices(min(len(sample), 1024), 1)
    xors = sample[i] ^ sample[j]
    for each in range(1 if words > 1 else 2, (reach + 1) // words + 1):
        masks = [(w, mask_of(p)) for w in range(words) for p in group_bits(sample[:, w], each)]
        cost = []
        for w, mask in masks:
            width = mask.bit_count()
            near = np.bincount(np.bitwise_count(xors[:, w] & np.uint64(mask)), minlength=BITS + 1)
            row = [0.0]
            for t in range(min(MOST, width, reach) + 1):
                ball = sum(math.comb(width, x) for x in range(t + 1))
                p = max(near[: t + 1].sum() / max(1, len(xors)), ball / 2.0**width)
                row.append(ROW_COST * n * (1 + (ball - 1) / 2) + PAIR_COST * verified * p * n * n / 2)
            cost.append(row)
        # dp[u]: the cheapest way to give u units (threshold + 1 each) to the parts so far
        dp: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(math.inf, ())] * (reach + 1)
        for row in cost:
            dp = [min((dp[u - x][0] + row[x], (*dp[u - x][1], x)) for x in range(min(u + 1, len(row)))) for u in range(reach + 2)]
        if dp[reach + 1][0] < best[0]:
            best = (dp[reach + 1][0], [(w, mask, x - 1) for (w, mask), x in zip(masks, dp[reach + 1][1]) if x])
    return best[1]


def flips(mask: int, t: int) -> list[int]:
    """All non-empty flips of at most t bits of the mask."""
    bits, out, layer = [1 << b for b in range(BITS) if mask >> b & 1], [], [(0, 0)]
    for _ in range(t):
        layer = [(v | bits[i], i + 1) for v, at in layer for i in range(at, len(bits))]
        out += [v for v, _ in layer]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(numbers: list[int]) -> Column:
    return F.expr("cast(split('" + ",".join(str(_signed(v)) for v in numbers) + "', ',') as array<bigint>)")


def _probes(word: Column, own: Column, every: Column, lowest: Column) -> Column:
    """The keys beside its own that a fingerprint probes; lowest has the lowest bit of each flip."""
    return F.transform(F.filter(every, lambda v, i: word.bitwiseAND(F.get(lowest, i)) == 0), lambda v: own.bitwiseXOR(v))


def _of_part(i: int):
    return lambda key: F.struct(F.lit(i).alias("part"), key.alias("key"))


def signatures(fps: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(part, key, fp): each fingerprint in its own bucket of each part and in those that it probes.  Of two that
    differ by a flip, only that with a 0 at the flip's lowest bit probes, so a pair meets once."""
    each = []
    for i, (w, mask, t) in enumerate(parts):
        word = F.get("fp", F.lit(w))
        own = word.bitwiseAND(F.lit(_signed(mask)))
        keys = F.array(own)
        if t > 0:
            every = flips(mask, t)
            keys = F.concat(keys, _probes(word, own, _longs(every), _longs([v & -v for v in every])))
        each.append(F.transform(keys, _of_part(i)))
    return fps.select("fp", F.explode(F.concat(*each)).alias("s")).select("s.part", "s.key", "fp")


# ---- buckets


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


_SEEDS = 64


def forest_of(fps: np.ndarray, d: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of rows, of the links within d in one bucket.  What has been reached is compared with
    the unreached rows only, so a dense group costs about one pass; rows without links go by blocks."""
    words = [np.ascontiguousarray(fps[:, w]) for w in range(fps.shape[1])]

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.uint16)
        for w in words:
            out += np.bitwise_count(w[a][:, None] ^ w[b][None, :])
        return out <= d

    left, edges = np.arange(len(fps)), []
    while len(left) > 1:
        seeds = left[:_SEEDS]
        met = near(seeds, left)
        met[np.arange(len(seeds)), np.arange(len(seeds))] = False
        links = met.sum(axis=1)
        x = int(links.argmax())
        if not links[x]:
            left = left[len(seeds) :]
            continue
        front, stay = left[x : x + 1], np.ones(len(left), bool)
        stay[: len(seeds)][links == 0] = False
        stay[x] = False
        left = left[stay]
        while len(front) and len(left):
            some, front = front[:_SEEDS], front[_SEEDS:]
            met = near(some, left)
            hit = met.any(axis=0)
            reached = left[hit]
            edges += zip(some[met[:, hit].argmax(axis=0)].tolist(), reached.tolist())
            front, left = np.concatenate((front, reached)), left[~hit]
    return edges


def small_links(bucket: np.ndarray, fps: np.ndarray, d: int) -> list[tuple[int, int, int]]:
    """(bucket, row, row) links of many small buckets at once; rows are sorted by bucket."""
    out, shift, at = [], 1, np.arange(len(fps))
    while len(at := at[at + shift < len(fps)]) and len(at := at[bucket[at] == bucket[at + shift]]):
        near = at[np.bitwise_count(fps[at] ^ fps[at + shift]).sum(axis=1) <= d]
        out += zip(bucket[near].tolist(), near.tolist(), (near + shift).tolist())
        shift += 1
    return out


_LINK = "a array<bigint>, b array<bigint>, part bigint, key bigint"
_SMALL = 48


def _scan(words: int, d: int, bucket_rows: int):
    """Reads rows (part, key, fp) sorted by bucket.  Gives links (a, b, -1, 0), and of a bucket that is too large its
    rows (fp, null, part, key)."""

    def out(a: np.ndarray, b: np.ndarray | None, part: int = -1, key: int = 0) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.list_(pa.int64())) if b is None else _column(b)
        marks = (pa.array(np.full(len(a), x, np.int64)) for x in (part, key))
        return pa.RecordBatch.from_arrays([_column(a), other, *marks], ["a", "b", "part", "key"])

    def ended(part: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, each of bucket_rows at most."""
        if not len(fp):
            return
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
        bucket, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(starts, len(fp)))
        rows, forest, at = [], _Forest(), -1
        few = np.flatnonzero((size[bucket] <= _SMALL) & (size[bucket] > 1))
        # within one bucket a forest is enough
        for k, a, b in sorted(small_links(bucket[few], fp[few], d)):
            if k != at:
                forest, at = _Forest(), k
            if forest.link(a, b):
                rows.append((few[a], few[b]))
        for k in np.flatnonzero(size > _SMALL):
            s = starts[k]
            rows += [(s + a, s + b) for a, b in forest_of(fp[s : s + size[k]], d)]
        for i in range(0, len(rows), 20_000):
            some = np.array(rows[i : i + 20_000])
            yield out(fp[some[:, 0]], fp[some[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, words), np.uint64)]
        hot = None
        for b in batches:
            part, key = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            fp = _matrix(b.column(2), words)
            if hot is not None:
                rest = (part != hot[0]) | (key != hot[1])
                at = int(np.argmax(rest)) if rest.any() else len(fp)
                if at:
                    yield out(fp[:at], None, *hot)
                part, key, fp = part[at:], key[at:], fp[at:]
                if not len(fp):
                    continue
                hot = None
            held = [np.concatenate(x) for x in zip(held, (part, key, fp))]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            at = len(last) - int(last.sum())
            yield from ended(*(x[:at] for x in held))
            held = [x[at:] for x in held]
            if len(held[0]) > bucket_rows:
                hot = (int(held[0][0]), int(held[1][0]))
                yield out(held[2], None, *hot)
                held = [x[:0] for x in held]
        yield from ended(*held)

    return run


def links(fps: DataFrame, parts: list[tuple[int, int, int]], d: int = DISTANCE, words: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect those that are within d and share a bucket; written."""
    spark = fps.sparkSession
    todo, found = signatures(fps, parts), None
    # the bits on which the fingerprints of a bucket need not agree, by part
    free = {i: [(w, b) for w in range(words) for b in range(BITS) if w != own or not mask >> b & 1] for i, (own, mask, _) in enumerate(parts)}
    while True:
        dealt = todo.repartition(base.shuffle_partitions(spark), "part", "key").sortWithinPartitions("part", "key", "fp")
        here = base.written(base.mapped(dealt, _scan(words, d, bucket_rows), _LINK), "links")
        these = here.where("part = -1").select("a", "b")
        found = these if found is None else found.unionByName(these)
        hot = here.where("part >= 0")
        if hot.isEmpty():
            return found
        # A pair of one hot bucket differs in d bits at most, so it agrees on one of d + 1 groups of the free bits.
        finer, each = {}, []
        for i in sorted(free):
            for g in (free[i][j :: d + 1] for j in range(d + 1)):
                if g:
                    own = [F.get("a", F.lit(w)).bitwiseAND(F.lit(_signed(mask_of([b for v, b in g if v == w])))) for w in sorted({w for w, _ in g})]
                    key = F.struct(F.lit(len(finer)).cast("long").alias("part"), F.xxhash64("part", "key", *own).alias("key"))
                    each.append(F.when(F.col("part") == i, key))
                    finer[len(finer)] = [x for x in free[i] if x not in g]
        todo = hot.select(F.col("a").alias("fp"), F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("s")).select("s.part", "s.key", "fp").distinct()
        free = finer


#: Links that one task joins at most, by count; more are contracted by all tasks until so few are left.
FEW_LINKS = 100_000


def _joined(kind: pa.DataType):
    """Reads few links (a, b); gives (node, root) of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nodes, forest = {}, [], _Forest()
        for b in batches:
            for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends = []
                for x in pair:
                    key = tuple(x) if isinstance(x, list) else x
                    if key not in number:
                        number[key] = len(nodes)
                        nodes.append(x)
                    ends.append(number[key])
                forest.link(*ends)
        for i in range(0, len(nodes), 20_000):
            some = range(i, min(i + 20_000, len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array([nodes[j] for j in some], kind), pa.array([nodes[forest.find(j)] for j in some], kind)], ["node", "root"])

    return run


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links; written.  Contraction rounds: each node moves to that of its neighbourhood
    with the smallest hash, links follow, until they are few enough for one task; hashed order makes the rounds few.  Hubs
    are looked up by broadcast, so that no task gets all links of one."""
    with base.scope(edges.sparkSession):
        edges = base.written(edges.where("a <> b").distinct(), "edges")
        where: DataFrame | None = None
        kind = edges.schema["a"].dataType
        while n := edges.count():
            if few := n <= FEW_LINKS:
                schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
                arrow = pa.list_(pa.int64()) if isinstance(kind, T.ArrayType) else pa.int64()
                step = base.written(base.mapped(edges.select("a", "b").repartition(1), _joined(arrow), schema), "step")
            else:
                both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                least = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("x"))), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("x")))
                step = base.written(both.groupBy("a").agg(least.alias("s"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.col("s.x").alias("root"), "n"), "step")
            if where is None:
                where = step.select("node", "root")
            else:
                sizes = where.groupBy("root").agg(F.count("*").alias("n"))
                here = base.written(sizes.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root"), "ups")
                where = base.looked_up(where, here, "root", "n", where.count(), "left")
                where = base.written(where.select("node", F.coalesce("up", "root").alias("root")), "roots")
            if few:
                break
            for side in ("a", "b"):
                here = step.select(F.col("node").alias(side), F.col("root").alias("to"), "n")
                edges = base.looked_up(edges, here, side, "n", 2 * n).drop(side).withColumnRenamed("to", side)
            edges = base.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        if where is None:  # no links at all
            where = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return base.written(where, "roots", outlives=True)


def linked(distinct: DataFrame, d: int = DISTANCE, reach: int | None = None, words: int = 1, probed: int = 1, sample: int = SAMPLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) of a written table of distinct fingerprints fp, by parts and thresholds that its size and a sample give."""
    drawn = [r[0] for r in base.drawn(distinct, "fp", sample).collect()]
    parts = plan_parts(np.array(drawn, np.int64).view(np.uint64).reshape(-1, words)[:, :probed], distinct.count(), d if reach is None else reach, words)
    return links(distinct.select("fp"), parts, d, words, bucket_rows)


def components(fps: DataFrame, d: int = DISTANCE, reach: int | None = None, words: int = 1, probed: int = 1, sample: int = SAMPLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root, copies, component_id) for each distinct fingerprint of a written table (doc_id, fp): the fingerprint that
    stands for the component, how many rows have this one, and the smallest doc_id in the component; written."""
    with base.scope(fps.sparkSession):
        distinct = base.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
        found = roots(linked(distinct, d, reach, words, probed, sample, bucket_rows))
        named = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = base.written(named, "named")
        least = base.written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
        out = base.looked_up(named, least, "root", "n", named.count())
        return base.written(out.select("fp", "root", "copies", "component_id"), "components", outlives=True)


def near_duplicates(docs: DataFrame, text: str = "text", k: int = SHINGLE, d: int = DISTANCE, sample: int = SAMPLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document, by fingerprints of one word."""
    fps = base.written(fingerprints(docs, text, k), "fingerprints")
    by = components(fps, d, sample=sample, bucket_rows=bucket_rows).select("fp", "copies", "component_id")
    named = base.looked_up(fps, by, "fp", "copies", fps.count())
    return named.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", k: int = DEDUP_SHINGLE, words: int = 1, d: int | None = None, probed: int = 1, reach: int | None = None) -> DataFrame:
    """One row of each component, that with the smallest doc_id (nulls last; of equal ids the smallest hash of the
    row's text, then of the whole row); repeated rows count once.  All columns of docs.  Links are overlaps of
    `overlap.OVERLAP` or more between sets of shingles, found by fingerprints within d bits and by prefixes, and verified;
    or, where d is given, fingerprints within d bits alone."""
    from . import overlap

    spark, none = docs.sparkSession, -(1 << 63)
    i, h, r = base.unused(docs, "__i", "__h", "__r")
    keys = {i: F.coalesce(docs["doc_id"].cast("long"), F.lit(none)), h: F.xxhash64(base.text_of(docs, text)), r: F.xxhash64(*base.hashable(docs))}
    slim = docs.select(*(c.alias(x) for c, x in zip(keys.values(), "ihr")), base.text_of(docs, text).alias("text"))
    with base.scope(spark):
        if d is None:
            each = base.written(overlap.described(slim, k, overlap.OVERLAP, overlap.late_shingles(slim, k)), "described")
            first = F.min(F.struct((F.col("i") == none).alias("n"), "i", "h", "r")).alias("m")
            sets = base.written(each.groupBy("sid").agg(first, *(F.first(c).alias(c) for c in ("n", "sketch", "wide", "prefix", "fp"))), "sets")
            each = base.written(each.select("i", "h", "r", F.col("sid").alias("node")), "each")
            found = roots(overlap.links(slim, sets, k))
        else:
            each = base.written(fingerprints(slim.withColumn("doc_id", F.when(F.col("i") != none, F.col("i"))), "text", k, words, ("doc_id", "i", "h", "r")), "fingerprints")
            found = components(each, d, reach, words, probed).select(F.col("fp").alias("node"), "root")
            each = each.withColumnRenamed("fp", "node")
        rows = base.written(each.groupBy("i", "h", "r", "node").agg(F.count("*").alias("n")), "rows")
        nodes = rows.groupBy("node").agg(F.min(F.struct((F.col("i") == none).alias("n"), "i", "h", "r")).alias("m"))
        best = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("m"))
        best = base.written(best.select("m.i", "m.h", "m.r"), "best")
        names = [F.col(x).alias(y) for x, y in zip("ihr", keys)]
        gone = base.written(rows.join(best, ["i", "h", "r"], "left_anti").select(*names), "gone", outlives=True)
        again = base.written(rows.where("n > 1").join(best, ["i", "h", "r"]).select(*names), "again", outlives=True)
    marked = docs.withColumns(keys)
    kept = base.without(marked, list(keys), gone)
    if not again.isEmpty():
        once = kept.join(F.broadcast(again) if again.count() <= base.BROADCAST_ROWS else again, list(keys), "left_semi").dropDuplicates(list(keys))
        kept = base.without(kept, list(keys), again).unionByName(once)
    return kept.select(docs.columns)
