"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames, frames follow each other in a bundle, and a seek table in a skippable frame ends it
(the public seekable format: any zstd reader can read the whole file).  The index maps a record to its bundle, frame and place inside
the unpacked frame, so that one record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, long_rows, stored

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, offset long, length long, start long, size long"


def open_fs(path: str):
    """A file system that any task can open, and the path in it: local, hdfs, s3, gs and what else Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (packed, unpacked) bytes, without checksums."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed, unpacked) of each frame of a bundle."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * entry)
    raw, at, out = file.read(n * entry), 0, []
    for i in range(n):
        packed, unpacked = struct.unpack_from("<II", raw, i * entry)
        out.append((at, packed, unpacked))
        at += packed
    return out


def _header_text(x: str) -> str:
    """Header values stand on one line: control characters are percent-encoded, and so is the per cent sign."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" or c == "%" else c for c in x)


def _record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header_text(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to): pages whose payload, of ``least_bytes`` or more, a page of larger id has too; with the largest such id."""
    keyed = pages.where("page_id is not null").select("page_id", F.coalesce("html", F.lit("")).alias("html")).where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    most = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lo")).where("lo < refers_to").drop("lo")
    return keyed.join(most, "digest").where("page_id < refers_to").select("page_id", "refers_to").distinct()


def write_bundles(pages: DataFrame, path: str, least_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) to bundles in the folder ``path``; returns the stored index.

    A payload is the html in UTF-8; null is empty.  Of pages with equal payloads of at least ``least_bytes``, the one with the largest
    page_id is a response, the others revisit it.  Repeated rows give a record each, under one record id.  ``date`` is the
    time of capture of all records (RFC 3339), by default now.  Rows without page_id can't be named and are left
    out.  A payload larger than a frame has a frame of its own.  No rows, no bundles.

    Each attempt of a task writes bundles under a name of its own and the index holds only those of the attempts that counted, so lost
    executors and repeated tasks leave at most unreferenced files.
    """
    rows = long_rows(pages).where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    seen = revisits(rows, least_bytes).select(F.col("page_id").alias("p"), "refers_to")
    rows = rows.join(seen, F.col("page_id") == F.col("p"), "left").drop("p")

    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        file, bundle, frames, at, n_bundles = None, "", [], 0, 0
        held, index = bytearray(), []

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal at, held, index
            packed = packer.compress(bytes(held))
            file.write(packed)
            yield pd.DataFrame([(p, bundle, len(frames), at, len(packed), s, n) for p, s, n in index], columns=["page_id", "bundle", "frame", "offset", "length", "start", "size"])
            frames.append((len(packed), len(held)))
            at, held, index = at + len(packed), bytearray(), []

        for batch in batches:
            for page_id, url, html, refers_to in batch.itertuples(index=False, name=None):
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                record = _record(page_id, url, payload, digest, len(payload), None if pd.isna(refers_to) else int(refers_to), date)
                if held and len(held) + len(record) > frame_bytes:
                    yield from flush()
                if file is not None and not held and at >= bundle_bytes:
                    file.write(seek_table(frames))
                    file.close()
                    file = None
                if file is None:
                    bundle = f"{name}-{n_bundles:04d}.warc.zst"
                    file, frames, at, n_bundles = fs.open_output_stream(f"{folder}/{bundle}", compression=None), [], 0, n_bundles + 1
                index.append((page_id, len(held), len(record)))
                held += record
        if file is not None:
            yield from flush()
            file.write(seek_table(frames))
            file.close()

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInPandas(run, INDEX), "warc-index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(page_id, type, refers_to, digest, payload_bytes, checked) of the records of an index, read from the bundles by frame; a task
    reads neighbouring frames, and so few bundles.

    ``checked``: the frame's place agrees with the bundle's seek table, the record names the page, and the digest is that of the
    payload (of revisits, which have none, that of the record they refer to is not looked up)."""
    frames = index.groupBy("bundle", "frame", "offset", "length").agg(F.collect_list(F.struct("page_id", "start", "size")).alias("records"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_fs(path)
        unpack = zstandard.ZstdDecompressor()
        name, file, table = None, None, []
        for batch in batches:
            out = []
            for bundle, frame, offset, length, records in batch.itertuples(index=False, name=None):
                if bundle != name:
                    if file is not None:
                        file.close()
                    name, file = bundle, fs.open_input_file(f"{folder}/{bundle}")
                    table = read_seek_table(file, file.size())
                file.seek(offset)
                raw = unpack.decompress(file.read(length))
                placed = table[frame] == (offset, length, len(raw))
                for r in records:
                    head, payload = parse_record(raw[r["start"] : r["start"] + r["size"]])
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    good = placed and head["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"
                    if kind == "response":
                        good = good and digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() and len(payload) == int(head["X-Payload-Length"])
                    to = head.get("WARC-Refers-To")
                    out.append((r["page_id"], kind, int(to[len("<urn:page:") : -1]) if to else None, digest, int(head["X-Payload-Length"]), good))
            made = pd.DataFrame(out, columns=["page_id", "type", "refers_to", "digest", "payload_bytes", "checked"])
            made["refers_to"] = made["refers_to"].astype("Int64")
            yield made
        if file is not None:
            file.close()

    schema = "page_id long, type string, refers_to long, digest string, payload_bytes long, checked boolean"
    return frames.repartitionByRange("bundle", "frame").sortWithinPartitions("bundle", "frame").mapInPandas(run, schema)


def op4_warc_bundles(spark, sf_dir):
    path = fresh_path(spark, "warc")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_records(index, path)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: Base32 has no function in SQL: each five bits of the hex digest are looked up.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, html, hex, array_to_string(list_transform(range(1, 41), lambda i: right('0000' || bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4)), '') AS b FROM p),
d AS (
  SELECT page_id, html, hex, max(page_id) OVER (PARTITION BY hex) AS top,
         array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * CAST(substr(b, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * j + 4, 1) AS INT) + CAST(substr(b, 5 * j + 5, 1) AS INT), 1)), '') AS digest
  FROM bits)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""
