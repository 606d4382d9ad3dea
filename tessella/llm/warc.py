"""WARC archives: written as text records, read back by boundary-chain verification.

Writing. Each row becomes one WARC/1.1 record with an HTTP response block. Of payloads that are equal and have at
least `revisit_bytes` bytes, the one with the largest page_id is stored as a response; the others become revisit records that name it and
keep its headers. The records are strings that end in a blank line, so Spark's own text writer, with that blank line as the line
separator, puts them on any file system it knows; no payload is shuffled. Each task gathers its records into files of about `file_bytes`
bytes (a larger record has a file of its own).

Reading. Files are read whole (Spark's limit is 2 GB). Tasks emit
every offset where a record may begin, with the offset where its successor would: the magic, a parsable header of any length and
a Content-Length. Magic inside a payload makes such a candidate too, so candidates prove nothing by themselves. Within each file, pointer
jumping from offset zero, doubling the stride each step, retains those on the chain; an archive whose chain
doesn't end at its last byte is reported as damaged. Only the retained records are parsed.

Defined results: a null html is an empty payload; a null url leaves out the target header; rows with a null page_id or a repeated one are written
and read back as often as they occur, null ids as responses; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import new_path, stored, tune

MAGIC = b"WARC/1.1\r\n"
REVISIT_BYTES, FILE_BYTES = 1000, 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01T00:00:00Z"


def with_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, broadcast_rows: int = 250_000) -> DataFrame:
    """Adds payload, size, sha1, and refers_to (the response's page_id where the row is a revisit).

    Only digests and ids are grouped. The rows that revisit another one are known by (page_id, digest); that list is broadcast
    up to broadcast_rows, else joined by a shuffle.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.encode("payload", "UTF-8"))})
    keys = rows.where((F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1", F.sha2("payload", 256).alias("exact"))
    copies = keys.groupBy("exact").agg(F.max("page_id").alias("refers_to"), F.first("sha1").alias("sha1"), F.count("*").alias("n")).where("n > 1")
    again, _ = stored(keys.join(copies.select("exact", "refers_to"), "exact").where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct(), "revisits")
    if again.count() <= broadcast_rows:
        again = F.broadcast(again)
    return rows.join(again, ["page_id", "sha1"], "left")


def records(rows: DataFrame) -> DataFrame:
    """The text of each record, without the blank line that ends it."""
    crlf = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf + crlf))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uuid = F.md5(F.concat_ws(" ", "page_id", "url", "sha1", F.monotonically_increasing_id().cast("string")))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    head = F.concat(
        F.lit("WARC/1.1" + crlf + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(crlf + "WARC-Record-ID: <urn:uuid:"), F.regexp_replace(uuid, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">" + crlf + f"WARC-Date: {EPOCH}" + crlf),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit(crlf)), F.lit("")),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit(crlf)), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{crlf}X-Refers-To-Page-Id: "), F.col("refers_to").cast("string"), F.lit(crlf))).otherwise(""),
        F.lit("WARC-Payload-Digest: "), digest, F.lit(crlf + "Content-Type: application/http; msgtype=response" + crlf + "Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(crlf + crlf), block,
    )
    return rows.select(head.alias("value"))


BREAK = "\r\n\r\n"


def _gathered(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records joined by blank lines, to about file_bytes bytes a row."""
        held, size = [], 0
        for b in batches:
            for record in b.column(0).to_pylist():
                held.append(record)
                size += len(record.encode())
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([BREAK.join(held)], pa.string())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([BREAK.join(held)], pa.string())], ["value"])

    return run


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of about so many bytes under path."""
    tune(pages.sparkSession)
    out = records(with_types(pages, revisit_bytes)).mapInArrow(_gathered(file_bytes), "value string")
    out.write.option("lineSep", BREAK).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


_head = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")
_length = re.compile(rb"(?:^|\n)content-length:[ \t]*(\d+)[ \t]*\r", re.IGNORECASE)


def candidate(buffer: bytes, at: int) -> tuple[int, int] | None:
    """(bytes of header, bytes of content) of the record that may begin there."""
    if (head := _head.match(buffer, at)) is None or (length := _length.search(head.group(1))) is None:
        return None
    return head.end() - at, int(length.group(1))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, at, next) of every candidate of a file."""
    for b in batches:
        for path, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out = []
            at = raw.find(b"WARC/1.")
            while at >= 0:
                if found := candidate(raw, at):
                    out.append((path, len(raw), at, at + sum(found) + 4))
                at = raw.find(b"WARC/1.", at + 1)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "size", "at", "next"])


def chain(at: np.ndarray, succ: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Which candidates are reachable from offset zero, by pointer jumping, and whether the chain ends at the last byte."""
    order = np.argsort(at)
    at, succ = at[order], succ[order]
    n = len(at)
    place = np.searchsorted(at, succ)
    hit = (place < n) & (at[np.minimum(place, n - 1)] == succ) if n else np.zeros(0, bool)
    jump = np.append(np.where(hit, place, n), n)  # n: beyond the chain
    reach = np.zeros(n + 1, bool)
    reach[:1] = n > 0 and at[0] == 0
    for _ in range(max(1, n).bit_length()):
        reach[jump[reach]] = True
        jump = jump[jump]
    reach = reach[:n]
    back = np.zeros(n, bool)
    back[order] = reach
    return back, bool(size == 0 or reach.any() and succ[reach].max() == size)


def _retained(pdf: pd.DataFrame) -> pd.DataFrame:
    keep, whole = chain(pdf["at"].to_numpy(), pdf["next"].to_numpy(), int(pdf["size"].iloc[0]))
    return pdf[keep].assign(whole=whole)[["path", "at", "next", "whole"]]


def boundaries(files: DataFrame) -> DataFrame:
    """(path, at, next, whole) of the true records of binary files; a file's candidates are bounded by its size."""
    found = files.select("path", "content").mapInArrow(_candidates, "path string, size long, at long, next long")
    return found.groupBy("path").applyInPandas(_retained, "path string, at long, next long, whole boolean")


def parse(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head = _head.match(raw)
    fields = dict(x.split(": ", 1) for x in head.group(1).decode().strip().split("\r\n"))
    block = raw[head.end() : head.end() + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"payload": payload, "payload_bytes": int(_length.search(http + b"\r\n").group(1))}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for at, end, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if end != len(raw):
                raise ValueError("a damaged archive: its chain of records doesn't reach the end")
            for x, y in zip(at, [*at[1:], end], strict=True):
                r = parse(raw[x:y])
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["WARC-Type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"record {r['WARC-Record-ID']}: payload and digest differ")
                number = lambda k, r=r: int(r[k]) if k in r else None
                out.append((number("X-Page-Id"), r.get("WARC-Target-URI"), r["payload_bytes"], digest, r["WARC-Type"], number("X-Refers-To-Page-Id"), r["payload"] if r["WARC-Type"] == "response" else None))
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, broadcast_records: int = 2_000_000, most_groups: int = 64) -> DataFrame:
    """Every record of the archives under path; revisits have no payload.

    The offsets of the records (8 bytes each) go to the files that hold them. Files are read in as many groups as keep a group near
    broadcast_records, and each group's offsets are broadcast; beyond most_groups they are joined by a shuffle.
    """
    tune(spark)

    def opened(*paths: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load([*paths]).select("path", "length", "content")

    def joined(files: DataFrame, lists: DataFrame) -> DataFrame:
        return files.join(lists, "path").select("at", "end", "content")

    files = opened(path)
    found, _ = stored(boundaries(files), "records")
    lists, _ = stored(found.groupBy("path").agg(F.sort_array(F.collect_list("at")).alias("at"), F.max("next").alias("end")), "chains")
    if not files.where("length > 0").select("path").join(lists, "path", "left_anti").isEmpty():
        raise ValueError("an archive has no record at its start")
    groups = max(1, -(-found.count() // broadcast_records))
    if groups > most_groups:
        content = joined(files, lists)
    else:
        lists = lists.withColumn("group", F.pmod(F.xxhash64("path"), F.lit(groups)))
        names: dict[int, list[str]] = {}
        for r in lists.select("group", "path").collect():  # one row a file, of at most most_groups * broadcast_records records in all
            names.setdefault(r["group"], []).append(r["path"])
        parts = [joined(opened(*names[g]), F.broadcast(lists.where(F.col("group") == g))) for g in sorted(names)]
        content = parts[0] if parts else joined(files, lists)
        for p in parts[1:]:
            content = content.unionAll(p)
    return content.mapInArrow(_parsed, PARSED)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), as read back from the archives written."""
    path = new_path(spark, "warc")
    write(pages, path)
    return read(spark, path).drop("payload", "url")
