"""Documents from files and to files, by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """path and doc (binary) of each file: one document a file, bytes unchecked until it is parsed."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("doc"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc of each line."""
    return spark.read.text(path).where("length(trim(value)) > 0").select(F.col("value").alias("doc"))


def documents(df: DataFrame, *columns: str, name: str = "doc") -> DataFrame:
    """Rows as documents: a JSON object of the named columns (or all), members in their order."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias(name))


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, member: str, order: list[str | Column]) -> DataFrame:
    """key and doc of each parent row: its columns and, as an array member, its children in order.  One shuffle each on
    the key; parents without children have an empty array."""
    fields = [c for c in children.columns if c != child_key]
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("__row"))))
    grouped = children.groupBy(F.col(child_key).alias("__key")).agg(F.transform(ordered, lambda x: x["__row"]).alias("__rows"))
    both = parents.join(grouped, parents[key] == grouped["__key"], "left")
    empty = F.array().cast(grouped.schema["__rows"].dataType)
    return both.select(key, F.to_json(F.struct(*parents.columns, F.coalesce("__rows", empty).alias(member)), {"ignoreNullFields": "false"}).alias("doc"))


def write_json_lines(df: DataFrame, doc: str, path: str, compression: str = "none") -> None:
    """One document a line; documents are to be compact, so that they have no line breaks."""
    df.select(F.col(doc).alias("value")).write.option("compression", compression).text(path)
