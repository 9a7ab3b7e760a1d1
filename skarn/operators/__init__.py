"""DataFrame forms of the column functions: rows of nodes, extraction, changes, grouping by equal documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import json_canonical, json_select, json_select_many, json_try_modify, try_json_parse


def select_nodes(df: DataFrame, doc: str, path: str, outer: bool = False) -> DataFrame:
    """A row for each node that a path selects: the other columns, pos (from 0), path, value.  outer: rows without nodes
    stay, with nulls."""
    explode = F.posexplode_outer if outer else F.posexplode
    rest = [c for c in df.columns if c != doc]
    return df.select(*rest, explode(json_select(doc, path)).alias("pos", "__n")).select(*rest, "pos", "__n.path", "__n.value")


def extract(df: DataFrame, doc: str, paths: dict[str, str], keep_document: bool = False) -> DataFrame:
    """The first value of each path as a column of text; the document is parsed once for all of them."""
    rest = [c for c in df.columns if keep_document or c != doc]
    found = df.select(*rest, json_select_many(doc, paths).alias("__v"))
    return found.select(*rest, *(F.get(F.col("__v")[n], F.lit(0)).alias(n) for n in paths))


def split_valid(df: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a well-formed document, the other rows with an error column)."""
    checked = df.withColumn("__c", try_json_parse(doc))
    good = checked.where("__c.error is null").drop("__c")
    return good, checked.where("__c.error is not null").withColumn("error", F.col("__c.error")).drop("__c")


def change(df: DataFrame, doc: str, patch: str) -> DataFrame:
    """Each document after a patch, all or nothing, and a column error, null where it went through."""
    rest = [c for c in df.columns if c != doc]
    changed = df.select(*rest, json_try_modify(doc, patch).alias("__c"))
    return changed.select(*rest, F.col("__c.doc").alias(doc), F.col("__c.error").alias("error"))


def distinct_documents(df: DataFrame, doc: str) -> DataFrame:
    """One row for each different document, whatever the order of members or the spelling of numbers: canonical, n."""
    return df.where(F.col(doc).isNotNull()).groupBy(json_canonical(doc).alias("canonical")).agg(F.count("*").alias("n"))
