"""The column functions in Structured Streaming.  All of them are stateless, so they work there as they are; these are
the usual shapes around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import json_valid
from skarn.plans.lowering import native_first, parsed


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def valid_documents(stream: DataFrame, doc: str) -> DataFrame:
    """The rows whose documents are well-formed."""
    return stream.where(json_valid(doc))


def windowed_counts(stream: DataFrame, doc: str, path: str, time: str, window: str, late: str, kind: str = "string") -> DataFrame:
    """How often each value of a singular path occurs in each tumbling window; rows later than `late` are left out."""
    value: Column = F.try_variant_get(native_first(parsed(doc), path), "$", kind)
    return stream.withWatermark(time, late).groupBy(F.window(time, window), value.alias("value")).agg(F.count("*").alias("n"))
