"""WARC archives: writer with revisit records, and a sequential reader.

Every record is one gzip member.  The reader pulls an archive through an
incremental zlib stream, frames records by their content length and verifies
block and payload digests on the way, so it holds one chunk and one header
block at a time, whatever the size of a record or an archive.

Writing: payloads are the UTF-8 html (null: empty).  Among records with equal
payloads of at least ``min_bytes`` bytes (SHA-1 and length) the smallest page
id is a ``response``, the others are ``revisit`` records that refer to it and
carry the HTTP header block only; its Content-Length keeps the full length.
A hot payload is found by a pre-aggregated minimum per digest and a join whose
hot keys AQE splits.  Tasks write archives of bounded size under names of
their own and return them as manifest rows; the manifest is checkpointed
before anything is read, so archives of failed attempts are never seen.

Cases: a null url is left out; a null page id is written as such, never
referred to, and revisits its group's smallest id if there is one; rows
repeated under the smallest id are all responses; an empty table gives no
archives and an empty result; other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut

CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20  # a new archive begins beyond this many compressed bytes
DATE = "2000-01-01T00:00:00Z"  # the tables carry no fetch time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])


def base32_sha1(sha: hashlib._Hash) -> str:
    return base64.b32encode(sha.digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response record, or a revisit if ``refers_to``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_urn(page_id)),
            ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", "sha1:" + base32_sha1(hashlib.sha1(payload))),
            ("WARC-Block-Digest", "sha1:" + base32_sha1(hashlib.sha1(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if refers_to is not None:
        head += [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


class _Member:
    """The decompressed bytes of one gzip member, pulled on demand."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.out, self.z = stream, rest, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress another chunk; False at the end of the member."""
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.raw or self.stream.read(CHUNK)
        self.raw = b""
        if not data:
            raise ValueError("archive ends inside a record")
        self.out += self.z.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.out:
            if not self.more():
                raise ValueError("record ends inside its header")
        head, _, self.out = self.out.partition(mark)
        return head

    def chunks(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.out and not self.more():
                raise ValueError("record is shorter than its Content-Length")
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream) -> Iterator[dict]:
    """Read an archive from a binary stream record by record; raises
    ValueError on broken framing or a digest that does not match."""
    rest = stream.read(CHUNK)
    while rest:
        member = _Member(stream, rest)
        head = _headers(member.until(b"\r\n\r\n"))
        block_sha, payload_sha, http, size = hashlib.sha1(), hashlib.sha1(), b"", 0
        in_payload = False
        for piece in member.chunks(int(head["content-length"])):
            block_sha.update(piece)
            if not in_payload:
                http += piece
                if b"\r\n\r\n" not in http:
                    continue
                http, _, piece = http.partition(b"\r\n\r\n")
                in_payload = True
            payload_sha.update(piece)
            size += len(piece)
        while member.more():
            pass
        if member.out != b"\r\n\r\n":
            raise ValueError("record is longer than its Content-Length")
        if "sha1:" + base32_sha1(block_sha) != head["warc-block-digest"]:
            raise ValueError("block digest does not match")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base32_sha1(payload_sha) != digest:
            raise ValueError("payload digest does not match")
        if kind == "revisit":
            size = int(_headers(http)["content-length"])
        yield {"page_id": page_of(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
               "record_type": kind, "refers_to": page_of(head.get("warc-refers-to")),
               "target_uri": head.get("warc-target-uri")}
        rest = member.z.unused_data or stream.read(CHUNK)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder`` (a path
    or URI that all executors reach); the manifest (path, records)."""
    payload = F.coalesce(F.encode(pages["html"], "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload")})
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    linked = rows.join(first, ["sha", "bytes"], "left").select("page_id", "url", "payload", other.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        made, out = [], None
        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{root}/{name}-{len(made):04d}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                    made.append({"path": f"{folder.rstrip('/')}/{path.rpartition('/')[2]}", "records": 0})
                out.write(record_bytes(*page))
                made[-1]["records"] += 1
                if out.tell() > ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(made, schema=MANIFEST)

    return cut(linked.mapInArrow(write, "path string, records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                count = 0
                with store.open_input_stream(place, compression=None) as stream:
                    for found in itertools.batched(read_records(stream), 4096):
                        count += len(found)
                        yield pa.RecordBatch.from_pylist(list(found), schema=RECORD)
                if count != records:
                    raise ValueError(f"{path} has {count} records instead of {records}")

    return manifest.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                     "refers_to long, target_uri string")
