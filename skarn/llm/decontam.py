"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text's tokens are its runs of letters and its numbers.  Numbers, names (tokens with a capital that don't begin a
sentence) and units (right after a number) become typed placeholders, all other tokens are lower-cased; so a question
keeps its template when its parameters change.  Windows of `WINDOW` tokens of documents and benchmark items meet in a
hash join.  Matches of one alignment (document place minus item place) are then checked for slot consistency: each slot
value of the item has to stand for one value in the document.  An item leaks into a document if consistent alignments
cover `COVERAGE` of its windows.

A second probe takes neighbouring placeholders of one type for one slot, whatever number of tokens they are, so that
`Paris` may become `New York` and `300` `3 000`.  To it a word with a capital is a name at the beginning of a sentence or
text, too, unless the benchmark has it both there and in lower case (`how`, `the`).  An item also leaks by it if one
consistent alignment covers `RUN` consecutive tokens, whatever share of the item they are.  What the first probe finds
keeps the figures of that.  Both probes are made in one pass over the documents, for windows of all lengths.

The benchmark's windows are broadcast if they are `BROADCAST_ROWS` at most, by count; beyond that the join shuffles.
Documents are never shuffled for the broadcast join: their windows are made, looked up and dropped in the scan's stage.
The shuffled join moves the windows' hashes alone.

Nulls and ties: a null text counts as empty; a null doc_id is a document like any other.  Items of fewer tokens than a
window have one window, themselves.  Items of fewer than `LEAST` tokens can't be told from chance and are left out, unless
a smaller `least` is given; then their lower-cased tokens have to be met as they are.  Repeated rows count as one document.
Very long texts are a row each; empty tables give no leaks.  Extra columns are not read, and stay in what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW, LEAST = 8, 4
COVERAGE, CONSISTENT = 0.5, 0.8
#: Consecutive tokens that are a leak by themselves.
RUN = 13
BROADCAST_ROWS = 200_000
#: Words that may begin a sentence without being a name: so many at most, the most frequent ones.
OPENERS = 5_000
#: A token; the mark that ends a sentence, with up to three more characters, stays with the word behind it.
TOKEN = r"(?:[.!?:\n][^\p{L}\p{N}]{0,3})?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"
#: Words that are units after a number.
UNITS = (
    "kg g mg lb oz km m cm mm mi ft in yd l ml s ms min h hr kw w v percent day days hour hours minute minutes second "
    "seconds week weeks month months year years mile miles meter meters metre metres foot feet inch inches pound pounds "
    "gram grams liter liters litre litres dollar dollars euro euros cent cents"
).split()
_MARKS = (".", "!", "?", ":", "\n")


def _digit(t: Column) -> Column:
    return F.substring(t, 1, 1).between("0", "9")


def _bare(t: Column) -> Column:
    """Lower-cased, without the mark that it may carry."""
    return F.lower(F.when(F.substring(t, 1, 1).isin(*_MARKS), F.regexp_replace(t, r"^[^\p{L}]+", "")).otherwise(t))


def _canonical(raw: Column) -> Column:
    """Typed placeholders and plain words, token by token."""

    def one(t: Column, i: Column) -> Column:
        unit = F.lower(t).isin(*UNITS) & (i > 0) & F.coalesce(_digit(F.get(raw, i - 1)), F.lit(False))
        return F.when(_digit(t), "#").when(F.substring(t, 1, 1).isin(*_MARKS), _bare(t)).when(unit, "%").when(t != F.lower(t), "@").otherwise(t)

    return F.transform(raw, one)


def _tokens(df: DataFrame, keys: list[Column], text: Column) -> DataFrame:
    """raw and canon."""
    return df.select(*keys, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("raw")).withColumn("canon", _canonical(F.col("raw")))


def _begins(t: Column, i: Column) -> Column:
    return (i == 0) | F.substring(t, 1, 1).isin(*_MARKS)


def openers(items: DataFrame, most: int = OPENERS) -> list[str]:
    """The words, lower-cased, that the items have both at the beginning of a sentence and in lower case."""
    raw = _tokens(items, [], base.text_of(items)).select(F.explode(F.transform("raw", lambda t, i: F.struct(_begins(t, i).alias("first"), _bare(t).alias("word"), (t == F.lower(t)).alias("low")))).alias("t")).select("t.*")
    seen = raw.groupBy("word").agg(F.max("first").alias("first"), F.max(~F.col("first") & F.col("low")).alias("low"), F.count("*").alias("n"))
    return sorted(r[0] for r in seen.where("first and low").orderBy(F.desc("n"), "word").limit(most).select("word").collect())


def _templates(t: DataFrame, words: list[str]) -> DataFrame:
    """t with the second probe's arrays: starts, where its tokens begin in raw (from 0), and canon1, what they are."""
    raw = F.col("raw")

    def one(t: Column, i: Column, canon: Column) -> Column:
        low = _bare(t)
        name = _begins(t, i) & ~_digit(t) & (t != F.lower(t))
        return F.when(name, F.when(low.isin(*words), low).otherwise("@") if words else F.lit("@")).otherwise(canon)

    t = t.withColumn("__typed", F.transform(F.arrays_zip(raw.alias("r"), F.col("canon").alias("c")), lambda z, i: one(z["r"], i, z["c"])))
    typed = F.col("__typed")
    again = lambda c, i: (i > 0) & c.isin("#", "@", "%") & (c == F.get(typed, i - 1))
    first = F.transform(typed, lambda c, i: F.when(~F.coalesce(again(c, i), F.lit(False)), i))
    t = t.withColumn("starts", F.filter(first, lambda i: i.isNotNull()))
    return t.withColumn("canon1", F.transform("starts", lambda s: F.get(typed, s))).drop("__typed")


def _raw_of(probe: Column, at: Column, n: Column) -> Column:
    """The raw texts of n tokens from place at; a merged token has those of all that it stands for, with spaces."""
    starts = F.col("starts")
    one = lambda s, j: F.array_join(F.slice("raw", s + 1, F.coalesce(F.get(starts, at + j), F.size("raw")) - s), " ")
    return F.when(probe == 1, F.transform(F.slice(starts, at, n), one)).otherwise(F.slice("raw", at, n))


def _hashed(canon: Column) -> Column:
    return F.transform(canon, lambda x: F.xxhash64(x))


def _window(hashes: Column, at: Column, n: Column, probe: int) -> Column:
    return F.xxhash64(F.slice(hashes, at, n), F.lit(probe))


def item_windows(items: DataFrame, words: list[str], window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """w (hash), probe, len, item_id, at, total (windows of the item), and the window's raw tokens and canon.  Probe 0 is the
    plain one, 1 that of merged slots, 2 that of items of fewer than LEAST tokens."""
    t = _templates(_tokens(items, [items["item_id"]], base.text_of(items)).where(F.size("raw") >= least), words)
    exact = F.transform("raw", _bare)
    each = [t.where(F.size("raw") >= LEAST).withColumn("probe", F.lit(0)), t.where(F.size("canon1") >= LEAST).withColumn("canon", F.col("canon1")).withColumn("probe", F.lit(1))]
    if least < LEAST:
        each.append(t.where(F.size("raw") < LEAST).withColumn("canon", exact).withColumn("probe", F.lit(2)))
    found = None
    for p, x in enumerate(each):
        x = x.withColumn("len", F.least(F.lit(window), F.size("canon"))).withColumn("total", F.size("canon") - F.col("len") + 1)
        x = x.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("total"))))
        at, n = F.col("at"), F.col("len")
        x = x.select(_window(_hashed(F.col("canon")), at, n, p).alias("w"), "probe", "len", "item_id", "at", "total", _raw_of(F.lit(p), at, n).alias("item_raw"), F.slice("canon", at, n).alias("item_canon"))
        found = x if found is None else found.unionByName(x)
    return found


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT, broadcast_rows: int = BROADCAST_ROWS, run: int = RUN, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, matched: a row for each document and item that leaks into it."""
    words = openers(items)
    theirs = base.written(item_windows(items, words, window, least), "windows")
    small = theirs.count() <= broadcast_rows
    text = base.text_of(docs)
    t = _templates(_tokens(docs, [docs["doc_id"], F.xxhash64(text).alias("text_hash")], text), words)
    t = t.select("doc_id", "text_hash", "raw", "starts", _hashed(F.col("canon")).alias("h0"), _hashed(F.col("canon1")).alias("h1"), *([_hashed(F.transform("raw", _bare)).alias("h2")] if least < LEAST else []))

    kinds = sorted((r[0], r[1]) for r in theirs.select("probe", "len").distinct().collect()) or [(0, window)]  # at most three for each length up to window

    def places(kind: int) -> Column:
        """Numbers of which the upper bits say which kind of window, the lower ones at which place."""
        probe, n = kinds[kind]
        # a filter on the size would be pushed below the tokens and make them all again
        last, first = F.size(f"h{probe}") - F.lit(n) + 1, F.lit(kind << 40)
        return F.when(last > 0, F.sequence(first + 1, first + last)).otherwise(F.array().cast("array<bigint>"))

    each = t.withColumn("code", F.explode(places(0) if len(kinds) == 1 else F.concat(*map(places, range(len(kinds))))))
    each = each.withColumn("kind", F.shiftright("code", 40)).withColumn("place", F.col("code").bitwiseAND((1 << 40) - 1).cast("int"))
    of = lambda values: F.lit(values[0]) if len(values) == 1 else F.coalesce(*(F.when(F.col("kind") == i, v) for i, v in enumerate(values)))
    w = [_window(F.col(f"h{p}"), F.col("place"), F.lit(n), p) for p, n in kinds]
    each = each.withColumn("w", w[0] if len(w) == 1 else of(w)).withColumn("probe", of([F.lit(p) for p, _ in kinds])).withColumn("len", of([F.lit(n) for _, n in kinds]))
    each = each.select("doc_id", "text_hash", "raw", "starts", "place", "w", "probe", "len")
    keys = ["w", "probe", "len"]
    if small:
        hits = each.join(F.broadcast(theirs.withColumnsRenamed({"probe": "__probe", "len": "__len"})), "w").where("probe = __probe and len = __len")
    else:  # the windows are shuffled without the tokens, which come back for the few documents that were met
        met = base.written(each.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), "place", *keys).join(theirs, keys), "met")
        own = base.written(met.select("__id", "__h").distinct(), "documents")
        same = lambda a, b: a["doc_id"].eqNullSafe(b["__id"]) & (a["text_hash"] == b["__h"])
        raw = t.select("doc_id", "text_hash", "raw", "starts").distinct()
        raw = raw.join(F.broadcast(own) if own.count() <= base.BROADCAST_ROWS else own, same(raw, own), "left_semi")
        hits = met.join(raw, same(raw, met))
    found = hits.select("doc_id", "text_hash", "item_id", "probe", "total", "at", (F.col("place") - F.col("at")).alias("shift"), "item_raw", "item_canon", _raw_of(F.col("probe"), F.col("place"), F.col("len")).alias("doc_raw"))
    slots = F.filter(
        F.transform(F.arrays_zip("item_canon", "item_raw", "doc_raw"), lambda z: F.struct(z["item_canon"].alias("c"), _bare(z["item_raw"]).alias("i"), _bare(z["doc_raw"]).alias("d"))),
        lambda s: s["c"].isin("#", "@", "%"),
    )
    one = ["doc_id", "text_hash", "item_id", "probe", "total"]
    # of one alignment each place of the item has one partner, so what is collected is bounded by the item
    aligned = found.withColumn("slots", slots).groupBy(*one, "shift").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["c"], s["i"]))))
    ahead = max(0, run - window)  # so many windows further on begins the last of those that make up a run
    at = F.col("sorted")
    long = F.exists(F.transform(at, lambda a, i: F.coalesce(F.get(at, i + ahead) == a + ahead, F.lit(False))), lambda x: x)
    aligned = aligned.where(values >= consistent * F.size("slots")).withColumn("sorted", F.sort_array("at"))
    aligned = aligned.withColumn("long", (F.col("probe") == 1) & (F.col("total") > ahead) & long)
    whole = aligned.groupBy(*one).agg(F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("matched"), F.max("long").alias("long"))
    whole = whole.where((F.col("matched") >= coverage * F.col("total")) | F.col("long"))
    best = whole.groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct("probe", (-F.col("matched")).alias("m"), "total")).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", F.col("b.total").cast("long").alias("n_windows"), (-F.col("b.m")).cast("long").alias("matched"))


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, matched; for repeated ids the fullest match."""
    return leaks(docs, items, least=least).groupBy("doc_id", "item_id", "n_windows").agg(F.max("matched").alias("matched"))


def drop_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs without leaks; all columns."""
    i, h = base.unused(docs, "__i", "__h")
    number = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    bad = leaks(docs, items, least=least).select(number(F.col("doc_id")).alias(i), F.xxhash64("text_hash", F.col("doc_id").isNull()).alias(h)).distinct()
    marked = docs.withColumns({i: number(docs["doc_id"]), h: F.xxhash64(F.xxhash64(base.text_of(docs)), docs["doc_id"].isNull())})
    return base.without(marked, [i, h], base.written(bad, "leaks")).select(docs.columns)


def sql() -> str:
    """The same for DuckDB, over documents and benchmark; windows meet as text."""
    token = TOKEN.replace("\\n", "' || chr(10) || '")
    marks = ", ".join("chr(10)" if m == "\n" else f"'{m}'" for m in _MARKS)
    units = ", ".join(f"'{u}'" for u in UNITS)
    bare = lambda t: f"lower(CASE WHEN substr({t}, 1, 1) IN ({marks}) THEN regexp_replace({t}, '^[^\\p{{L}}]+', '') ELSE {t} END)"
    digit = lambda t: f"substr({t}, 1, 1) BETWEEN '0' AND '9'"
    canon = f"""list_transform(raw, lambda t, i: CASE WHEN {digit("t")} THEN '#' WHEN substr(t, 1, 1) IN ({marks}) THEN {bare("t")}
      WHEN lower(t) IN ({units}) AND i > 1 AND {digit("raw[i - 1]")} THEN '%' WHEN t <> lower(t) THEN '@' ELSE t END)"""
    cut = lambda c, at: f"list_slice({c}, {at}, {at} + len - 1)"
    return f"""
WITH b0 AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{token}') AS raw FROM benchmark),
b1 AS (SELECT item_id, raw, {canon} AS canon, least({WINDOW}, len(raw)) AS len FROM b0 WHERE len(raw) >= {LEAST}),
b2 AS (SELECT *, len(raw) - len + 1 AS total, unnest(range(1, len(raw) - len + 2)) AS ipos FROM b1),
b AS (SELECT item_id, len, total, ipos, {cut("raw", "ipos")} AS item_raw, {cut("canon", "ipos")} AS item_canon FROM b2),
d0 AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS h, regexp_extract_all(coalesce(text, ''), '{token}') AS raw FROM documents),
d1 AS (SELECT doc_id, h, raw, {canon} AS canon FROM d0),
d2 AS (SELECT doc_id, h, raw, canon, len, unnest(range(1, len(raw) - len + 2)) AS place
  FROM d1, (SELECT DISTINCT len FROM b) WHERE len(raw) >= len),
d AS (SELECT doc_id, h, len, place, {cut("raw", "place")} AS doc_raw, {cut("canon", "place")} AS doc_canon FROM d2),
hits AS (
  SELECT doc_id, h, item_id, total, ipos, place - ipos AS shift, unnest(list_zip(item_canon, item_raw, doc_raw)) AS z
  FROM d JOIN b ON d.len = b.len AND list_aggregate(doc_canon, 'string_agg', ' ') = list_aggregate(item_canon, 'string_agg', ' ')),
aligned AS (
  SELECT doc_id, h, item_id, total, shift,
    count(DISTINCT z[1] || '|' || {bare("z[2]")}) FILTER (WHERE z[1] IN ('#', '@', '%')) AS n_values,
    count(DISTINCT z[1] || '|' || {bare("z[2]")} || '|' || {bare("z[3]")}) FILTER (WHERE z[1] IN ('#', '@', '%')) AS n_slots
  FROM hits GROUP BY ALL),
whole AS (
  SELECT x.doc_id, x.h, x.item_id, x.total, count(DISTINCT x.ipos) AS matched
  FROM hits x JOIN aligned a ON x.doc_id IS NOT DISTINCT FROM a.doc_id AND x.h = a.h AND x.item_id = a.item_id AND x.shift = a.shift
  WHERE a.n_values >= {CONSISTENT} * a.n_slots GROUP BY ALL)
SELECT doc_id, item_id, CAST(total AS BIGINT) AS n_windows, max(matched) AS matched
FROM whole WHERE matched >= {COVERAGE} * total GROUP BY doc_id, item_id, total"""
