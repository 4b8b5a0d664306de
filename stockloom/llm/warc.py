"""WARC archives: an index first, then coalesced byte-range reads of the selected records.

Each task writes one archive of gzip members, a member per record, and an index row (file, offset,
length, URL, digest) for each. A reader sorts the index rows it selects by file and offset, joins
ranges that touch or nearly touch, fetches each joined range once and parses the records in it.

Of pages with equal payloads, those with the largest ``page_id`` are responses and the others revisit
them; a page without an id counts as smaller than any other. Nulls: a null html is an empty payload,
a null URL an empty target. Extra columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm.common import ARROW_ROWS, shared_dir, slices, written

INDEX = "file string, offset long, length long, url string, digest string, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes of archives that a task reads back.
TASK_BYTES = 32 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str | None) -> int | None:
    number = name[len("<urn:page:") : -1] if name else "none"
    return None if number == "none" else int(number)


def record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """The bytes of one record and its payload's digest; a revisit keeps the HTTP head and no payload."""
    digest = payload_digest(payload)
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> dict:
    """A record's headers, HTTP headers and payload; a response's payload must match its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"fields": fields, "http": lines, "payload": payload, "digest": digest}


def revisits(pages: DataFrame) -> DataFrame:
    """Pages that repeat a payload: ``page_id, refers_to``, the largest page_id with that payload.

    Payloads are compared by two digests computed in the scan; only they are shuffled, and a payload's
    pages are first reduced to their number and largest id.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("sha1"))
    groups = keys.groupBy("sha1").agg(F.count(F.lit(1)).alias("pages"), F.max("page_id").alias("refers_to")).filter("pages > 1")
    # Written first, so that Spark may split the pages of a payload that very many share.
    groups = written(groups, shared_dir(pages.sparkSession, "payloads"))
    later = keys.join(groups, "sha1").filter("refers_to IS NOT NULL AND NOT (page_id <=> refers_to)")
    return later.select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write the archives under ``folder`` and return the index as a written table."""
    # Written first, so its size is known when Spark chooses how to join the pages to it.
    again = written(revisits(pages), f"{folder}-revisits").select(F.col("page_id").alias("again"), F.col("sha1").alias("again_sha1"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"))
    placed = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.sha1("html") == F.col("again_sha1")), "left")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, out, offset = TaskContext.get(), None, 0
        name = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in slices(batches, 2):
            if out is None:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
            found = []
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                raw, digest = record(page, url, html.encode("utf-8", "surrogatepass"), refers_to)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                found.append((name, offset, len(member), url, digest, page))
                offset += len(member)
            columns = list(zip(*found))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "offset", "length", "url", "digest", "page_id"])
        if out is not None:
            out.close()

    return written(placed.select("page_id", "url", "html", "refers_to").mapInArrow(archive, INDEX), f"{folder}-index", ARROW_ROWS)


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """Sorted records (offset, length) as joined reads (offset, length, records)."""
    out: list[list[int]] = []
    for offset, length in rows:
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([offset, length, 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, with_payload: bool = False, gap: int = 16_384, most: int = 4 << 20) -> DataFrame:
    """The records of the index rows, read back from the archives by coalesced byte ranges.

    ``gap``: bytes between two records that are read rather than skipped. ``most``: bytes of one read,
    unless a single record is longer. With ``with_payload`` the rows also hold the payload (binary;
    null for revisits).
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, source = None, None
        for batch in batches:
            files = batch.column(0).to_pylist()
            places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != name:
                    name = files[i]
                    system, path = fs.FileSystem.from_uri(name)
                    source = system.open_input_file(path)
                at = i
                for offset, length, n in ranges(places[i:j], gap, most):
                    source.seek(offset)
                    held = source.read(length)
                    found = [parse(zlib.decompress(held[o - offset : o - offset + k], 31)) for o, k in places[at : at + n]]
                    at += n
                    yield rows(found)
                i = j

    def rows(found: list[dict]) -> pa.RecordBatch:
        columns = [
            pa.array([_page(x["fields"]["WARC-Record-ID"]) for x in found], pa.int64()),
            pa.array([int(x["http"]["Content-Length"]) for x in found], pa.int64()),
            pa.array([x["digest"] for x in found], pa.string()),
            pa.array([x["fields"]["WARC-Type"] for x in found], pa.string()),
            pa.array([_page(x["fields"].get("WARC-Refers-To")) for x in found], pa.int64()),
        ]
        if with_payload:
            columns.append(pa.array([x["payload"] if x["fields"]["WARC-Type"] == "response" else None for x in found], pa.binary()))
        return pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    schema = RECORDS + (", payload binary" if with_payload else "")
    # Dealt by stretches of the archives, so that the tasks follow from their bytes and not from the index's size.
    spark = index.sparkSession
    size = index.agg(F.sum("length")).collect()[0][0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / most))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def op9_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read every record back."""
    return read_records(write_archives(pages, shared_dir(spark, "warc")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
k AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS top FROM k GROUP BY hex),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(hex, 1 + 10 * (i // 8), 10)) AS BIGINT) // CAST(pow(32, 7 - i % 8) AS BIGINT) % 32, 1), '' ORDER BY i) AS payload_digest
      FROM m, range(32) r(i) GROUP BY hex)
SELECT k.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN k.page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.page_id = top THEN NULL ELSE top END AS refers_to
FROM k JOIN m USING (hex) JOIN d USING (hex)
"""
