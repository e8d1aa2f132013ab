"""WARC archives: writer with revisit records, and a sequential reader.

Each record is one gzip member.  The reader goes through an archive once, block
by block: it inflates member by member, takes the header up to the empty line,
counts off the content length, and checks the block and payload digests while
the bytes go by, so memory does not grow with the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hotkeys import join_per_key
from .scratch import filesystem, folder, stored
from .textbytes import limit_batches

#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(-?\d+|none)>")
# Characters of a target address that stand as they are; others are percent-encoded.
_PLAIN = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"

_MANIFEST = "part bigint, seq bigint, path string, n_records bigint, n_bytes bigint"
_RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary, problem string, path string")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP header (with the
    payload's length) and leaves out the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                  min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), revisit, refers_to.  Of pages with equal
    payloads of ``min_bytes`` or more, the one with the largest id stays a
    response and the others revisit it; a null id counts as the smallest, and rows
    that share the largest id all stay responses.  Groups are found by digest; a page whose digest is that of a large share of
    all pages is matched without a shuffle."""
    p = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                     F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    seen = p.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(seen.where("n > 1"), "payloads")
    out = join_per_key(p, groups, "sha1", "n", p.count(), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", revisit.alias("revisit"),
                      F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives below ``path`` (default: a
    folder in the shared directory); each task writes its rows, in archives of
    about ``ARCHIVE_BYTES``.  Returns the stored manifest (part, seq, path,
    n_records, n_bytes); it lists only files of finished tasks."""
    spark = pages.sparkSession
    limit_batches(spark)
    root = path or folder(spark, "warc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        seq = records = size = 0
        out, at = None, ""

        def row():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "path": [at],
                "n_records": pa.array([records], pa.int64()), "n_bytes": pa.array([size], pa.int64())})
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    at = f"{root}/part-{part:06d}-{attempt}-{seq:06d}.warc.gz"
                    store, inside = filesystem(at)
                    store.create_dir(inside.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inside)
                m = record(r["page_id"], r["url"], r["html"].encode(), date, r["refers_to"], r["revisit"])
                out.write(m)
                records, size = records + 1, size + len(m)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield row()
                    out, seq, records, size = None, seq + 1, 0, 0
        if out is not None:
            out.close()
            yield row()
    cols = pages.select("page_id", "url", "html", "revisit", "refers_to")
    return stored(cols.mapInArrow(run, _MANIFEST), "warc-manifest")


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of each gzip member, in pieces."""
    left = b""
    while True:
        left = left or stream.read(_READ)
        if not left:
            return
        z = zlib.decompressobj(31)

        def pieces(z=z):
            nonlocal left
            while not z.eof:
                if not left:
                    left = stream.read(_READ)
                    if not left:
                        raise ValueError("the archive ends within a record")
                out = z.decompress(left, _READ)
                left = z.unused_data if z.eof else z.unconsumed_tail
                if out:
                    yield out
        body = pieces()
        yield body
        for _ in body:  # whatever the caller left
            pass


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(value: str) -> int | None:
    m = _ID.fullmatch(value)
    return int(m[1]) if m and m[1] != "none" else None


def _read_record(pieces: Iterator[bytes], payload: bool) -> dict:
    """One record: header, block counted off by its length, digests checked."""
    raw, end = bytearray(), -1
    while end < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record without end of header")
        seen = max(0, len(raw) - 3)
        raw += piece
        if raw[:7] != b"WARC/1."[:len(raw)]:
            raise ValueError("a member that is no WARC record")
        end = raw.find(b"\r\n\r\n", seen)
    head, buf = bytes(raw[:end]), bytes(raw[end + 4:])
    h = _headers(head)
    left = int(h["content-length"])
    block, body = hashlib.sha1(), hashlib.sha1()
    http, kept, size = b"", [], 0
    in_body = False
    while left > 0:
        if not buf:
            buf = next(pieces, b"")
            if not buf:
                raise ValueError("a record shorter than its content length")
        part, buf = buf[:left], buf[left:]
        left -= len(part)
        block.update(part)
        if not in_body:
            http += part
            if b"\r\n\r\n" in http:
                http, _, part = http.partition(b"\r\n\r\n")
                in_body = True
            else:
                part = b""
        if part:
            body.update(part)
            size += len(part)
            if payload:
                kept.append(part)
    tail = buf + b"".join(pieces)
    kind, stated = h.get("warc-type"), h.get("warc-payload-digest", "")
    problem = None
    if tail != b"\r\n\r\n":
        problem = "more than one record in a member" if tail.startswith(b"\r\n\r\nWARC/") else "no end of record"
    elif h.get("warc-block-digest") not in (None, "sha1:" + base64.b32encode(block.digest()).decode()):
        problem = "block digest differs"
    elif kind == "response" and stated not in ("", "sha1:" + base64.b32encode(body.digest()).decode()):
        problem = "payload digest differs"
    length = int(_headers(http).get("content-length", size))
    if kind == "response" and length != size and not problem:
        problem = "payload length differs"
    url = h.get("warc-target-uri")
    return {"page_id": _page(h.get("warc-record-id", "")), "url": None if url is None else unquote(url),
            "record_type": kind, "refers_to": _page(h.get("warc-refers-to", "")), "payload_bytes": length,
            "payload_digest": stated.removeprefix("sha1:") or None,
            "payload": b"".join(kept) if payload and kind == "response" else None, "problem": problem}


def read_archive(stream, payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order.  A record whose digest, length or
    framing is wrong carries a ``problem``; damage that hides where the next
    record begins ends the archive with a row that has only a problem."""
    try:
        for pieces in _members(stream):
            yield _read_record(pieces, payload)
    except (ValueError, KeyError, zlib.error) as e:
        yield {"problem": f"{type(e).__name__}: {e}"}


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Read the archives whose ``path`` the manifest lists: page_id, url,
    record_type, refers_to, payload_bytes, payload_digest (both of the full
    payload, for revisits as the record states them), payload (null unless
    asked for and stored), problem (null: all checks passed), path."""
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(_RECORD)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = filesystem(path)
                rows, held = [], 0
                with store.open_input_stream(at) as f:
                    for r in read_archive(f, payload):
                        rows.append({k: r.get(k) for k in arrow.names} | {"path": path})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
    n = min(max(1, manifest.count()), 20_000)
    return manifest.select("path").repartition(n).mapInArrow(run, schema)
