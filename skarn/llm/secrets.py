"""Secret scans: three base patterns, and character Markov models for what the patterns miss.  DataFrame functions only.

Base spans are the leftmost matches of each pattern that don't overlap, those that are too short dropped afterwards.
Candidates beside them are runs of `CANDIDATE` characters or more that identifiers and keys are made of.  Two first-order
Markov models of characters, of random strings and of ordinary identifiers, give each candidate the mean log-likelihood
ratio of its steps; candidates above `RATIO` that touch no base span become spans of kind markov.

The models are trained on labelled samples: random strings made from hashes (`RANDOM` of each of six alphabets), and the
words, and pairs of words joined as identifiers are, of at most `SAMPLE` documents, those with the smallest hash of doc_id.  What comes to
the driver is a count for each pair of characters, at most 68 * 68 numbers.

Positions come from the lengths of matches and of the text between them, summed in blocks, so that a text with many
matches costs little more than its length; a run is read once, in pieces, and runs meet base spans in one order.  Nulls
and ties: a null text counts as empty; a null doc_id stays null; repeated rows stay rows.  An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Kinds in their order, each with its pattern, the group that has to be long enough, and how long.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A run that is too short hides no longer one, so these two can ask for the length at once.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Documents and random strings that training reads, at most.
SAMPLE, RANDOM = 2000, 4096
RATIO = 0.5
_BLOCK, _PIECE = 256, 4096


def _scan(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of all elements before each, from zero on; in blocks, so that no long array is copied again and again."""

    def folded(a: Column, first: Column) -> Column:
        return F.aggregate(a, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda a: F.aggregate(a, zero, lambda acc, x: op(acc, x)))
    firsts = folded(totals, zero)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("a"), F.slice(firsts, 1, F.size(blocks)).alias("f")), lambda z: F.slice(folded(z["a"], z["f"]), F.lit(1), F.size(z["a"]))))


def _before(lengths: Column) -> Column:
    """Sums of all elements before each."""
    return _scan(lengths, F.lit(0).cast("long"), lambda s, x: s + x)


def _places(v: Column) -> Column:
    """The characters of a string by their place in ALPHABET, in pieces of bounded length; each is read once."""
    pieces = F.regexp_extract_all(v, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return F.transform(pieces, lambda p: F.transform(F.split(p, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def _matches(df: DataFrame, text: str, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """df with the array column name: (s, e, v) of each match whose group is long enough; v is the group's text."""
    lit, none = F.lit(pattern), F.array().cast("array<struct<s:bigint,e:bigint,v:string>>")
    df = df.withColumn("__m", F.regexp_extract_all(text, lit, F.lit(0)))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("__l", F.zip_with("__g", "__m", lambda g, m: (F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))).cast("long")))
    df = df.withColumn("__b", F.when(F.size("__m") > 0, _before(F.col("__l"))))
    df = df.withColumn("__v", F.when(F.size("__m") > 0, F.regexp_extract_all(text, lit, F.lit(group)))) if group else df.withColumn("__v", F.col("__m"))
    n = F.size("__m")
    spans = F.transform(
        F.arrays_zip(F.slice("__b", F.lit(1), n).alias("b"), F.slice("__g", F.lit(1), n).alias("g"), F.col("__m").alias("m"), F.col("__v").alias("v")),
        lambda z: F.struct((z["b"] + F.char_length(z["g"])).alias("s"), (z["b"] + F.char_length(z["g"]) + F.char_length(z["m"])).alias("e"), z["v"].alias("v")),
    )
    kept = F.filter(spans, lambda x: F.char_length(x["v"]) >= least)
    return df.withColumn(name, F.when(n > 0, kept).otherwise(none)).drop("__m", "__g", "__l", "__b", "__v")


def _steps(strings: DataFrame, column: str) -> dict[tuple[int, int], int]:
    """How often each pair of neighbours (0: the start) occurs in the strings; characters by their place in ALPHABET."""
    placed = strings.where(F.char_length(column) > 0).select(F.flatten(_places(F.col(column))).alias("to"))
    placed = placed.withColumn("of", F.concat(F.array(F.lit(0)), F.slice("to", F.lit(1), F.size("to") - 1)))
    rows = placed.select(F.explode(F.arrays_zip(F.col("of").alias("a"), F.col("to").alias("b"))).alias("p")).groupBy("p.a", "p.b").count().collect()
    return {(r[0], r[1]): r[2] for r in rows}


def train(docs: DataFrame, sample: int = SAMPLE, random: int = RANDOM) -> list[float]:
    """The log-likelihood ratio of each step, by 68 * (place before) + place."""
    spark, n = docs.sparkSession, len(ALPHABET) + 1
    digest = F.sha2(F.concat(F.lit("random|"), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    made = F.array(digest, F.upper(digest), coded, F.regexp_replace(coded, "[+/=]", ""), F.upper(F.regexp_replace(coded, "[+/=]", "")), F.translate(coded, "+/", "-_"))
    randoms = spark.range(random).select(F.explode(made).alias("s"))
    drawn = base.drawn(docs, "doc_id", sample)  # sample bounds the broadcast
    texts = docs.join(F.broadcast(drawn), "doc_id", "left_semi").select(base.text_of(docs).alias("t"))
    words = texts.select(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{3,}(?![A-Za-z0-9])"), F.lit(0)).alias("w"))
    joined = F.transform("w", lambda w, i: F.concat(w, F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit(""), F.lit("/")), (i % 4 + 1).cast("int")), F.when(i % 4 == 2, F.initcap(F.coalesce(F.get("w", i + 1), F.lit("")))).otherwise(F.coalesce(F.get("w", i + 1), F.lit("")))))
    shouted = F.transform(F.filter(joined, lambda w, i: i % 8 == 0), lambda w: F.upper(w))
    ordinary = words.select(F.explode(F.concat("w", joined, shouted)).alias("s"))

    def logs(counts: dict[tuple[int, int], int], weight: float) -> list[float]:
        out = []
        for a in range(n):
            row = [counts.get((a, b), 0) + weight for b in range(n)]
            total = math.log(sum(row))
            out += [math.log(x) - total for x in row]
        return out

    return [r - o for r, o in zip(logs(_steps(randoms, "s"), 1.0), logs(_steps(ordinary, "s"), 1.0))]


def scan(docs: DataFrame, model: list[float] | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id and found: an array of (s, k, e) of all spans by start, then kind (its place in KINDS)."""
    model = train(docs) if model is None else model
    n = len(ALPHABET) + 1
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in model) + "', ',') as array<double>)")
    df = docs.select("doc_id", base.text_of(docs).alias("text"))
    for name, pattern, group, least in BASE:
        df = _matches(df, "text", name, pattern, group, least)
    df = _matches(df, "text", "run", CANDIDATE, 0, 0).drop("text")

    def likely(v: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
        step = lambda acc, x: F.struct((acc["sum"] + F.element_at(table, acc["at"] * n + x + 1)).alias("sum"), x.alias("at"))
        total = F.aggregate(_places(v), start, lambda acc, piece: F.aggregate(piece, acc, step), lambda acc: acc["sum"])
        return total / F.char_length(v) > ratio

    spans = lambda name, k: F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    df = df.withColumn("__base", F.concat(*(spans(x[0], k) for k, x in enumerate(BASE))))
    df = df.withColumn("__more", spans(F.filter("run", lambda r: likely(r["v"])), 3))
    df = df.withColumn("__all", F.sort_array(F.concat("__base", "__more")))
    # a run touches a base span if one before it ends behind its start, or one behind it starts before its end
    far = F.lit((1 << 63) - 1)
    ends = _scan(F.transform("__all", lambda x: F.when(x["k"] < 3, x["e"]).otherwise(F.lit(-1).cast("long"))), F.lit(-1).cast("long"), F.greatest)
    starts = F.reverse(_scan(F.transform(F.reverse("__all"), lambda x: F.when(x["k"] < 3, x["s"]).otherwise(far)), far, F.least))
    mixed = (F.size("__base") > 0) & (F.size("__more") > 0)
    # one array of all three: what a lambda refers to may be made again for each element
    zipped = F.arrays_zip(F.col("__all").alias("x"), ends.alias("before"), starts.alias("after"))
    alone = F.filter(zipped, lambda z: (z["x"]["k"] < 3) | ((z["before"] <= z["x"]["s"]) & (z["after"] >= z["x"]["e"])))
    return df.select("doc_id", F.when(mixed, F.transform(alone, lambda z: z["x"])).otherwise(F.col("__all")).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from scan's rows."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(text(F.filter("found", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )
