"""WARC archives: a writer through Spark's own commit, and a splittable reader.

Writing: each record is one gzip member.  Members are rows that Spark's text writer puts into files byte for byte
(``ISO-8859-1``); the line separator is an empty gzip member, so every file is a valid multi-member gzip archive and
only whole files are ever committed.

Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the
others are ``revisit`` records (profile identical-payload-digest) that refer to it; smaller ones are all responses.

Reading: each file is divided into byte ranges, and each range is a task's input of its own: ranges are numbered and
dealt to as many partitions as there are runs of ``TASK_BYTES`` bytes.  A task looks for the gzip magic in its range,
accepts a candidate when its member's head decodes to a WARC version line, and owns the records that start inside,
reading past the end of the range to finish the last one.  Compressed data that looks like a header is rejected by
that check.

A null payload is empty.  A null id cannot be referred to: such a page is always a response.  Rows with equal ids and
payloads are all responses, or all revisit the same id.  Null URLs become empty.  Empty tables give an archive without
records and an empty result.  Only the three named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An empty gzip member: the separator between records.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC = b"\x1f\x8b\x08"
TASK_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    d = hashlib.md5(f"page:{page_id}".encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; a revisit has no payload of its own."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) < n:
        raise ValueError("a record is shorter than its Content-Length")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": number("X-Payload-Length"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": rest[:n],
    }


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as archives at ``path``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    digests = pages.filter((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    # one row per repeated payload and per page that revisits; payloads are shuffled once, to meet them
    first = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = digests.join(first, "digest").filter("page_id < refers_to").distinct()
    revisits = revisits.select("page_id", "digest", "refers_to")

    def members(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)], pa.binary())], names=["member"])

    joined = pages.join(revisits, ["page_id", "digest"], "left")
    rows = joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(members, "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class _Window:
    """Bytes of a file on demand; keeps one buffer."""

    def __init__(self, source, size: int, step: int):
        self.source, self.size, self.step, self.start, self.data = source, size, step, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.start or at + n > self.start + len(self.data):
            self.start, self.data = at, self.source.read_at(min(max(n, self.step), self.size - at), at)
        return self.data[at - self.start : at - self.start + n]


def _inflate(win: _Window, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at``, or None; with ``most`` only that much content is decoded."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= win.size:
                return None
            chunk = win.get(pos, 65536)
            pos += len(chunk)
            out.append(z.decompress(chunk, most or 0))
            if most and (sum(map(len, out)) >= most or z.unconsumed_tail):
                break
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def records_in(source, size: int, start: int, end: int, step: int = 1 << 20) -> Iterator[dict]:
    """Records whose member starts in start..end of a file."""
    win, at = _Window(source, size, step), start
    while at < end:
        chunk = win.get(at, min(step, end - at + len(MAGIC) - 1))
        hit = chunk.find(MAGIC)
        if hit < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        head = _inflate(win, at, 16)
        if head is None or (head[0] and not head[0].startswith(b"WARC/1.")):
            at += 1
            continue
        if not head[0]:  # a separator, or chance
            at += len(SEPARATOR) if win.get(at, len(SEPARATOR)) == SEPARATOR else 1
            continue
        whole = _inflate(win, at)
        if whole is None:
            at += 1
            continue
        yield parse_record(whole[0])
        at = whole[1]


def read_warc(spark: SparkSession, path: str, range_bytes: int = 4 << 20, task_bytes: int = TASK_BYTES) -> DataFrame:
    """All records below ``path``: see ``RECORD``.  A task reads about ``task_bytes``, and one range at least."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    total = files.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(1, -(-total // max(task_bytes, range_bytes)), min(-(-total // range_bytes), spark.sparkContext.defaultParallelism))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("at"))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    rows: list[dict] = []
                    held = 0
                    for r in records_in(source, row["length"], row["at"], min(row["at"] + range_bytes, row["length"])):
                        rows.append(r)
                        held += len(r["payload"])
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    # a number of partitions that adaptive execution does not change, with ranges in turn
    return ranges.repartition(tasks).mapInArrow(read, RECORD)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in RECORD.split(", ")])

ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
big AS (SELECT d, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < r THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < r THEN r END AS refers_to
FROM p LEFT JOIN big ON p.d = big.d AND p.n >= 1000
"""
