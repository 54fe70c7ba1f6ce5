"""WARC writer and sequential reader (operator 10): one gzip member a record, payloads kept once."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import new_folder, sized_join, written
from .files import Replaced, opened

#: Compressed bytes after which a writer begins another archive, and bytes that the reader asks for at once.
ROLL, CHUNK = 64_000_000, 1 << 16
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def urn_page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as one gzip member: a response, or with refers_to a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": page_urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": quote(url or "urn:x-none", safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Payload-Digest": f"sha1:{digest32(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if refers_to is not None:
        head |= {"WARC-Refers-To": page_urn(refers_to), "WARC-Profile": PROFILE}
    data = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time, each decompressed as its bytes come."""
    left = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = left or stream.read(CHUNK)
            left = b""
            if not data:
                if parts or unpack.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(unpack.decompress(data))
        left = unpack.unused_data
        yield b"".join(parts)
        if not left and not (left := stream.read(CHUNK)):
            return


def fields(block: bytes) -> tuple[str, dict[str, str], int]:
    """The first line, the header fields and where the body starts."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a header does not end")
    first, *rest = block[:end].decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in rest)}, end + 4


def parsed(member: bytes) -> dict:
    """A record's fields; raises ValueError if its framing or the digest of its payload is wrong."""
    version, head, at = fields(member)
    size = int(head["content-length"])
    if not version.startswith("WARC/1.") or member[at + size :] != b"\r\n\r\n":
        raise ValueError("a record is not framed by its content length")
    block = member[at : at + size]
    _, http, body = fields(block)
    payload, digest = block[body:], head["warc-payload-digest"].removeprefix("sha1:")
    out = {"page_id": urn_page(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": None}
    if head["warc-type"] == "revisit":
        return out | {"refers_to": urn_page(head["warc-refers-to"]), "payload": None}
    if len(payload) != out["payload_bytes"] or digest32(payload) != digest:
        raise ValueError(f"the payload of {head['warc-record-id']} does not match its length or digest")
    return out | {"payload": payload}


def write_archives(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, refers_to -> archives; path, records, bytes of each. Each attempt has names of its own."""
    system, base = opened(folder)
    file, n = None, 0

    def closed() -> pa.RecordBatch:
        file.close()
        return pa.RecordBatch.from_arrays([pa.array([file.name.rsplit("/", 1)[1]]), pa.array([n], pa.int64()), pa.array([file.size], pa.int64())], ["name", "records", "bytes"])

    for b in batches:
        for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            if file is None:
                file, n = Replaced(system, base, f"pages-{uuid.uuid4().hex}.warc.gz"), 0
            file.write(record(page_id, url, (html or "").encode(), refers_to))
            n += 1
            if file.size >= ROLL:
                yield closed()
                file = None
    if file is not None:
        yield closed()


COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(batches: Iterator[pa.RecordBatch], folder: str, keep_payload: bool) -> Iterator[pa.RecordBatch]:
    system, base = opened(folder)
    for b in batches:
        for name, count in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
            rows, n, held = [], 0, 0
            with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for member in members(stream):
                    rows.append(parsed(member))
                    n += 1
                    if keep_payload:
                        held += len(member)
                    else:
                        rows[-1]["payload"] = None
                    if len(rows) >= 2000 or held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in COLUMNS.items()], list(COLUMNS))
                        rows, held = [], 0
            if n != count:
                raise ValueError(f"{name} has {n} records, not {count}")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in COLUMNS.items()], list(COLUMNS))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the manifest: name, records, bytes.

    Of equal payloads of at least least_bytes the row of the largest page_id is a response and the others are revisits of it;
    rows that share that id are responses each. A null html is an empty payload; a null page_id is smaller than any other,
    and payloads that only rows without id have are responses. A null url becomes urn:x-none. Other columns are not read.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = slim.withColumn("size", F.octet_length(F.coalesce("html", F.lit("")))).withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")))
    last = written(keyed.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last"), "warc-last")
    known = sized_join(keyed, last, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    return written(known.select("page_id", "url", "html", "refers_to").mapInArrow(partial(write_archives, folder=folder), "name string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives of a manifest, each archive read from its start to its end by one task."""
    return manifest.repartition(max(1, manifest.count())).mapInArrow(partial(read_archives, folder=folder, keep_payload=keep_payload), SCHEMA)


def query(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder, keep_payload=False).drop("payload", "url")


#: Base 32 by five bits at a time of the hexadecimal digest.
SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT payload, sha1(payload) AS hex, max(page_id) AS last FROM p GROUP BY payload),
bits AS (SELECT payload, i, (16 * (instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) + instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1)
                               // CAST(power(2, 3 - 5 * i % 4) AS BIGINT) % 32 AS v FROM h, range(32) t(i)),
digest AS (SELECT payload, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INTEGER), 1), '' ORDER BY i) AS digest FROM bits GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN h USING (payload) JOIN digest USING (payload)"""
