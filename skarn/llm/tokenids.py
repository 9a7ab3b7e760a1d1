"""Token ids as binary shards: whole texts encoded, ended by END, packed by Simple-8b in ascending doc_id order.

Documents are dealt by ranges of doc_id; each task streams its range in order and rolls shards at a size.  A shard is
written under a temporary name and moved to its own, which depends on its range and number only, so that a repeated
attempt replaces equal bytes.  The manifest, a table, lists the shards that count; what failed attempts have left is
removed once it is written.

Nulls and ties: a null text counts as empty (its ids are END alone); a null doc_id comes first; equal doc_ids are in
order of their texts, repeated rows stay rows.  An empty table gives no shards.  Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, simple8b, tokens

ROLL_BYTES = 32 << 20
_MANIFEST = "part int, number int, name string, documents long, ids long, bytes long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str = tokens.VOCABULARY, end: int = tokens.END, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the shards into folder; gives their manifest (part, number, name, documents, ids, bytes), in order of
    (part, number), as a written table."""
    spark = docs.sparkSession
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text"))
    dealt = base.ranges(slim, "doc_id", base.shuffle_partitions(spark)).sortWithinPartitions("__part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, encode = base.Files(folder), tokens.encoder(vocabulary).encode
        last = np.array([end], "<u4")
        out, rows, part, number, held = None, [], -1, 0, ""

        def finish():
            out.close()
            out.stream.close()
            name = f"ids-{part:05d}-{number:05d}.s8b"
            files.move(held, name)
            rows.append((part, number, name, len(out.docs), int(sum(out.counts)), out.bytes))

        try:
            for b in batches:
                for i, found, here in zip(b.column(0).to_pylist(), encode(b.column(1)), b.column(2).to_pylist()):
                    if out is not None and (here != part or out.bytes >= roll_bytes):
                        finish()
                        out, number = None, number + 1 if here == part else 0
                    if out is None:
                        part, held = here, f".{uuid.uuid4().hex}.tmp"
                        out = simple8b.Writer(files.create(held))
                    out.add(i, np.concatenate((found, last)))
            if out is not None:
                finish()
        except BaseException:
            files.drop(held)
            raise
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "number", "name", "documents", "ids", "bytes"])

    manifest = base.written(base.mapped(dealt.select("doc_id", "text", "__part"), run, _MANIFEST), "manifest")
    base.remove(spark, folder, ".*.tmp")
    return manifest


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the shards."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    at = manifest.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    at = at.select("name", "bytes", "before").repartition(base.shuffle_partitions(manifest.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = base.Files(folder)
        for b in batches:
            for name, size, before in zip(*(c.to_pylist() for c in b.columns)):
                with files.open(name) as stream:
                    rows = []
                    for row in simple8b.read(stream, size):
                        rows.append((row[0], row[1] + before, row[2], row[3]))
                        if len(rows) == 10_000:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return base.mapped(at, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, end: int = tokens.END) -> DataFrame:
    """Writes the shards to the shared folder and reads them back: a row for each document."""
    folder = base.work_path(docs.sparkSession, "ids")
    return read_shards(write_shards(docs, folder, vocabulary, end), folder)
