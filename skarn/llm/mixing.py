"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The size of each named source and of all others together (`REST`) gives its mean repetition rate: target weight times
total size over own size, so that the expected mix has the weights and the old total size.  Each document draws its
number of copies from a Poisson distribution with that mean, by inverting the distribution function at a uniform number
made from a hash of seed and document; a mean above `CHUNK` is a sum of equal smaller ones with draws of their own.  The
copies are exploded where the row is and sorted, over all partitions, by a hash of seed, document and copy: a global
shuffle that any run repeats.  Where a group's mean allows for more than `BLOCK` copies of a row, its rows are exploded to
blocks of so many first, and those dealt to all tasks.  The sizes are one small row for each name given, so a source with
a third of all rows is no burden.

Nulls and ties: a null source belongs to the others; a null text has size 0; a document is known by its id, or where
that is null by its text, so repeated rows get equal counts.  A source of size 0 or of weight 0 yields nothing.  Equal
shuffle keys come in order of id and copy.  A very long text is a row like any other.  An empty table gives an empty
table.  Extra columns stay, whatever their names; the two new ones are mix_copy (from 0) and mix_key, and replace columns
of that name in whatever case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

REST = "*"
CHUNK = 16.0
#: Terms of the distribution function; the rest is below 1e-40 for a mean of CHUNK.
TERMS = 100
#: Copies of a row that one task makes at once.
BLOCK = 4096


def _number(*parts: Column | str) -> Column:
    """60 hashed bits as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, names: list[str], text: str = "text") -> dict[str, int]:
    """Characters of each named source and of all others: one number a name."""
    group = F.when(F.col("source").isin([n for n in names if n != REST]), F.col("source")).otherwise(F.lit(REST))
    return {r[0]: r[1] or 0 for r in docs.groupBy(group.alias("g")).agg(F.sum(F.char_length(base.text_of(docs, text)).cast("long"))).collect()}


def rates(size: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    """Mean repetition rate by group."""
    total, weight = sum(size.values()), sum(weights.values())
    return {g: weights.get(g, 0.0) / weight * total / size[g] if size[g] else 0.0 for g in size} if weight else {}


def _distribution(mean: float) -> list[float]:
    """P(X <= k) for k below TERMS."""
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(TERMS):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return out


def replicate(docs: DataFrame, weights: dict[str, float], seed: str = "mix-1", text: str = "text") -> DataFrame:
    """The mixed rows in shuffled order: all columns of docs, mix_copy, mix_key."""
    names = list(weights)
    rate = rates(sizes(docs, names, text), weights)
    kept = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")]
    n, k, first = base.unused(docs, "__n", "__key", "__first")
    key = F.coalesce(docs["doc_id"].cast("string"), F.md5(base.text_of(docs, text)))
    source = docs["source"].cast("string")
    counts, large, blocked = F.lit(0), F.lit(False), False
    for group, mean in rate.items():
        if mean <= 0:
            continue
        chunks = max(1, math.ceil(mean / CHUNK))
        steps = F.expr("cast(split('" + ",".join(map(repr, _distribution(mean / chunks))) + "', ',') as array<double>)")

        def drawn(i: Column, steps: Column = steps) -> Column:
            u = (_number(seed, key, i.cast("string")).cast("double") + 0.5) / float(1 << 60)
            # as a lambda's variable the number is made once, not for every step
            return F.get(F.transform(F.array(u), lambda x: F.size(F.filter(steps, lambda c: c <= x))), F.lit(0))

        count = drawn(F.lit(0)) if chunks == 1 else F.aggregate(F.sequence(F.lit(0), F.lit(chunks - 1)), F.lit(0), lambda a, i: a + drawn(i))
        here = ~F.coalesce(source.isin([n for n in names if n != REST]), F.lit(False)) if group == REST else F.coalesce(source == group, F.lit(False))
        counts = F.when(here, count).otherwise(counts)
        if chunks * TERMS > BLOCK:  # a chunk has less than TERMS copies
            large, blocked = large | here, True
    parts = base.shuffle_partitions(docs.sparkSession)
    counted = docs.withColumn(n, counts).withColumn(k, key)
    each = F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("mix_copy")
    copies = counted.where(~large & (F.col(n) > 0)).select(*(docs[f"`{c}`"] for c in kept), k, each)
    if blocked:
        blocks = counted.where(large & (F.col(n) > 0)).withColumn(first, F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(BLOCK))))
        blocks = blocks.repartition(parts, k, first)
        each = F.explode(F.sequence(F.col(first), F.least(F.col(first) + BLOCK, F.col(n)) - 1)).alias("mix_copy")
        copies = copies.unionByName(blocks.select(*(blocks[f"`{c}`"] for c in kept), k, each))
    copies = copies.withColumn("mix_key", _number(seed, F.lit("order"), F.col(k), F.col("mix_copy").cast("string")))
    # the key is uniform, so the ranges of a global sort are known without a pass that samples them
    part = F.least(F.lit(parts - 1), F.floor(F.col("mix_key").cast("double") / float(1 << 60) * parts).cast("int"))
    return copies.repartitionById(parts, part).sortWithinPartitions("mix_key", k, "mix_copy").drop(k)


def sql(weights: dict[str, float], seed: str = "mix-1") -> str:
    """The same for DuckDB, over documents."""
    total = sum(weights.values())
    named = ", ".join(f"'{n}'" for n in weights if n != REST)
    values = ", ".join(f"('{n}', {w / total!r})" for n, w in weights.items())
    number = lambda of: f"CAST('0x' || substr(md5({of}), 1, 15) AS BIGINT)"
    return f"""
WITH d AS (
  SELECT doc_id, text, lang, source, n_chars, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS g,
    coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k
  FROM documents),
size AS (SELECT g, sum(length(coalesce(text, ''))) AS n FROM d GROUP BY g),
rate AS (
  SELECT size.g, w.w * (SELECT sum(n) FROM size) / size.n AS mean
  FROM size JOIN (VALUES {values}) w(g, w) ON size.g = w.g WHERE size.n > 0 AND w.w > 0),
chunked AS (SELECT g, greatest(1, ceil(mean / {CHUNK}))::INT AS chunks, mean / greatest(1, ceil(mean / {CHUNK})) AS m FROM rate),
steps AS (
  SELECT g, chunks, list(c ORDER BY t) AS cdf FROM (
    SELECT g, chunks, t, sum(exp(-m + t * ln(m) - lgamma(t + 1))) OVER (PARTITION BY g ORDER BY t) AS c
    FROM chunked, range(0, {TERMS}) r(t)) GROUP BY g, chunks),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(0, s.chunks), lambda i: len(list_filter(s.cdf,
    lambda c: c <= (CAST({number(f"'{seed}|' || d.k || '|' || CAST(i AS VARCHAR)")} AS DOUBLE) + 0.5) / {float(1 << 60)!r})))) AS n
  FROM d JOIN steps s ON d.g = s.g)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INT) AS mix_copy,
  {number(f"'{seed}|order|' || k || '|' || CAST(c AS VARCHAR)")} AS mix_key
FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS c FROM drawn WHERE n > 0)"""
