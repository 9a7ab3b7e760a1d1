"""WARC: a deterministic sharded writer, and a reader.

Pages are dealt by ranges of page_id and sorted; each task streams its range into gzip'd records, one member each, and
rolls files by compressed size.  All headers are made anew, record ids and digests from the content, dates from a
parameter, so equal input gives equal files.  A file is written under a temporary name and moved to its own when it is
whole; the manifest, a table written last, names the files that count, with their sizes.

Of pages with equal payloads of `least_bytes` bytes or more, the one with the smallest page_id is a response, the others
are revisits that refer to it (by record id, URI and date) and hold no payload.  Which ones those are is decided on digests
alone: a page whose payload occurs again gets a small row beside it, and both meet in the sort, so payloads are shuffled
once.  Those rows come from a join on the digest; the few digests that many pages share are broadcast to it, so a payload
of a third of all pages is no burden.  What failed attempts have left is removed once the manifest is written.

Nulls and ties: a null html is an empty payload; a null url is empty; a null page_id sorts first, is never what others
refer to unless all are null, and comes back null.  Of rows with equal page_id and payload the first (by url) is the
response and the rest revisit it.  Header values keep no line breaks.  An empty table gives no files.  Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_MANIFEST = "part int, number int, name string, records long, bytes long"
_BREAKS = str.maketrans({"\r": "%0D", "\n": "%0A"})


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{sha1}|{url}')}>"


def record(kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE, refers_to_url: str = "") -> bytes:
    """One record, not compressed.  A revisit's block is the HTTP header alone; length and digest are of the payload, which
    is that of the response to refers_to_url on page refers_to."""
    sha1 = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, url, sha1),
        "WARC-Date": date,
        "WARC-Target-URI": url.translate(_BREAKS),
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else page_id,
        "X-Payload-Length": len(payload),
    }
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, refers_to_url, sha1)
        head["WARC-Refers-To-Target-URI"] = refers_to_url.translate(_BREAKS)
        head["WARC-Refers-To-Date"] = date
        head["X-Refers-To-Page"] = "" if refers_to is None else refers_to
    head["Content-Length"] = len(block)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time or a name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip'd record; holds one record."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if out:
                raise ValueError("the archive ends inside a record")
            return
        out.append(z.decompress(data))
        if z.eof:
            rest, z = z.unused_data, zlib.decompressobj(31)
            head, _, block = b"".join(out).partition(b"\r\n\r\n")
            out = []
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            yield fields, block[: int(fields["Content-Length"])]


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """sha, first and first_url, the page that answers, and how many pages have it, of each payload that occurs more than
    once."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    number = pages["page_id"].cast("long")
    page = F.struct(number.isNull().alias("null"), number.alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"))
    slim = pages.select(page.alias("p"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    found = slim.groupBy("sha").agg(F.min("p").alias("p"), F.count("*").alias("pages")).where("pages > 1")
    return found.select("sha", F.col("p.page_id").alias("first"), F.col("p.url").alias("first_url"), "pages")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes the archives into folder; gives their manifest (part, number, name, records, bytes), a written table."""
    with base.scope(pages.sparkSession):
        return _write(pages, folder, least_bytes, roll_bytes, date)


def _write(pages: DataFrame, folder: str, least_bytes: int, roll_bytes: int, date: str) -> DataFrame:
    spark = pages.sparkSession
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    mine = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), payload.alias("html"))
    slim = base.written(mine.select("page_id", F.sha1("html").alias("sha")), "digests")
    same = base.written(revisits(pages, least_bytes), "payloads")
    # a row for each page whose payload occurs again; it sorts before the page
    marks = base.looked_up(slim, same, "sha", "pages", slim.count()).distinct()
    rows = marks.select("page_id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("html"), "sha", "first", "first_url").unionByName(
        mine.select("page_id", "url", "html", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_url"))
    )
    dealt = base.ranges(rows, "page_id", base.shuffle_partitions(spark), of=mine).sortWithinPartitions("__part", "page_id", F.col("html").isNotNull(), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = base.Files(folder)
        out, held, made, part, number, n, size = None, "", [], -1, 0, 0, 0
        page: tuple = ()
        marked: dict[str, tuple[int | None, str]] = {}  # of one page_id: its payloads that occur again
        answered: set[str] = set()

        def finish():
            out.close()
            name = f"pages-{part:05d}-{number:05d}.warc.gz"
            files.move(held, name)
            made.append((part, number, name, n, size))

        try:
            for b in batches:
                for page_id, url, html, sha, first, first_url, here in zip(*(c.to_pylist() for c in b.columns)):
                    if page != (here, page_id):
                        page, marked, answered = (here, page_id), {}, set()
                    if sha is not None:
                        marked[sha] = first, first_url
                        continue
                    key = hashlib.sha1(html).hexdigest()
                    kind, answer = "response", marked.get(key, (None, ""))
                    if key in marked:
                        kind = "revisit" if answer[0] != page_id or key in answered else "response"
                        answered.add(key)
                    if out is not None and (here != part or size >= roll_bytes):
                        finish()
                        out, number = None, number + 1 if here == part else 0
                    if out is None:
                        part, held, n, size = here, f".{uuid.uuid4().hex}.tmp", 0, 0
                        out = files.create(held)
                    data = member(record(kind, page_id, url, html, answer[0], date, answer[1]))
                    out.write(data)
                    n, size = n + 1, size + len(data)
            if out is not None:
                finish()
        except BaseException:
            files.drop(held)
            raise
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "number", "name", "records", "bytes"])

    dealt = dealt.select("page_id", "url", "html", "sha", "first", "first_url", "__part")
    manifest = base.written(base.mapped(dealt, run, _MANIFEST), "manifest", outlives=True)
    base.remove(spark, folder, ".*.tmp")
    return manifest


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits) of each record.  A
    response's payload is checked against its digest and length."""
    named = manifest.select("name").repartition(base.shuffle_partitions(manifest.sparkSession))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def number(text: str) -> int | None:
        return int(text) if text else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = base.Files(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with files.open(name) as stream:
                    for head, block in records(stream):
                        kind, sha1, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        payload = None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != n or digest(payload) != sha1:
                                raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], n, sha1, kind, number(head.get("X-Refers-To-Page", "")), payload and payload.decode() if payload is not None else None))
                        held += len(block)
                        if held >= 8 << 20 or len(rows) == 5000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return base.mapped(named, run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to of each page."""
    folder = base.work_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least_bytes), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sql(least_bytes: int = 0) -> str:
    """What round_trip returns, for DuckDB, over pages whose page_id is unique."""
    digit = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {shift}) & 31) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, CASE WHEN n >= {least_bytes} THEN min(page_id) OVER (PARTITION BY x) ELSE page_id END AS first FROM p),
d AS (SELECT x, string_agg({" || ".join(digit(s) for s in (15, 10, 5, 0))}, '' ORDER BY g) AS digest
  FROM (SELECT x, g, CAST('0x' || substr(x, 5 * g + 1, 5) AS INT) AS v FROM (SELECT DISTINCT x FROM p), range(0, 8) r(g)) GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f JOIN d ON f.x = d.x"""
