"""Token counts: the exact histogram of encoded lengths, and what follows from its suffix sums.

Documents are counted by encoded length (partial counts first, so a common length is no burden).  With the sums over
all longer documents, each length L answers for a context limit of L: the tokens kept when every document is cut at L,
the documents that fit, the share of documents at most that long (hence quantiles).  The suffix sums are taken in two
levels, inside runs of `RUN` lengths and over the runs, so that no task sorts the whole histogram's rows.

Nulls and ties: a null text counts as empty, of length 0 (plus the end id where one is added).  Repeated rows count
each.  An empty table gives an empty histogram.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, tokens

RUN = 256


def encoded_lengths(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, extra: int = 0) -> DataFrame:
    """n_tokens of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = tokens.encoder(vocabulary).lengths
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(lengths(b.column(0)) + extra, pa.int64())], ["n_tokens"])

    return base.mapped(docs.select(base.text_of(docs).alias("text")), run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From rows of n_tokens: for each length that occurs n_tokens, documents, documents_at_least, tokens_at_least (sums
    over this and greater lengths), tokens_kept (all tokens when documents are cut at this length), documents_at_most,
    total_documents, total_tokens."""
    counted = lengths.groupBy("n_tokens").agg(F.count("*").alias("documents")).withColumn("__run", F.floor(F.col("n_tokens") / RUN))
    counted = base.written(counted, "histogram")
    runs = counted.groupBy("__run").agg(F.sum("documents").alias("__d"), F.sum(F.col("documents") * F.col("n_tokens")).alias("__t"))
    above = Window.orderBy(F.desc("__run")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    whole = Window.orderBy(F.desc("__run")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select(
        "__run",
        F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__da"),
        F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__ta"),
        F.sum("__d").over(whole).alias("total_documents"),
        F.sum("__t").over(whole).alias("total_tokens"),
    )
    down = Window.partitionBy("__run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    inside = counted.withColumn("__di", F.sum("documents").over(down)).withColumn("__ti", F.sum(F.col("documents") * F.col("n_tokens")).over(down))
    out = inside.join(runs, "__run")
    least, tokens_least = F.col("__di") + F.col("__da"), F.col("__ti") + F.col("__ta")
    return out.select(
        "n_tokens",
        "documents",
        least.alias("documents_at_least"),
        tokens_least.alias("tokens_at_least"),
        (F.col("total_tokens") - tokens_least + least * F.col("n_tokens")).alias("tokens_kept"),
        (F.col("total_documents") - least + F.col("documents")).alias("documents_at_most"),
        "total_documents",
        "total_tokens",
    )


def kept_at(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens kept and the documents cut when every document is cut at limit, from the sums of the shortest
    length above it (all tokens and none, where there is no such length)."""
    above, first = F.col("n_tokens") > limit, F.struct("n_tokens", "documents_at_least", "tokens_at_least")
    found = histogram.agg(F.min(F.when(above, first)).alias("a"), F.max("total_tokens").alias("t"))
    kept = F.col("t") - F.coalesce(F.col("a.tokens_at_least") - F.col("a.documents_at_least") * limit, F.lit(0))
    return found.select(F.coalesce(kept, F.lit(0)).alias("tokens_kept"), F.coalesce("a.documents_at_least", F.lit(0)).alias("documents_cut"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    asked = [F.min(F.when(F.col("documents_at_most") >= F.lit(s) * F.col("total_documents"), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    return histogram.agg(*asked).select(F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)))).alias("s")).select("s.*")
