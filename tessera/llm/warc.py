"""WARC archives: one gzip member per record, written and read sequentially.

Writing: payloads are digested on the JVM; of the pages with equal payloads
the one with the smallest id becomes a ``response`` record and the others
``revisit`` records that refer to it. Each task packs its records into archive
files of bounded size in the shared folder, publishing a file by rename.

Reading: a task opens the archives listed for it and reads them as streams.
Members are inflated piece by piece and framed as they come: header fields up
to the empty line, then as many bytes of block as Content-Length says, digested
on the way, then the two line ends, then the member must end. Memory is that
of one record. Block and payload digests are verified, and the number of
records against the list of archives.

Cases: a null payload is written as an empty one; a null id becomes ``null``
in the record id and stays null, a null url has no field and stays null. Rows
that repeat an id yield a record each; those of a payload's smallest id are
all responses, since no larger id is there to revisit from. An empty table
writes no archive and reads as an empty result. A damaged record, an archive
that ends within a member and one with fewer or more records than listed
raise ``WarcError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shared_dir, tune

ARCHIVE_BYTES = 8 << 20
#: Bytes of a header at most.
HEAD_BYTES = 1 << 20
CRLF = b"\r\n"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, kind: str, refers: int | None, payload: bytes, sha1: bytes, length: int) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header of the full payload only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is None:
        del fields[3]
    if kind == "revisit":
        fields[2:2] = [("WARC-Refers-To", name(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields) + CRLF
    return gzip.compress(head + block + CRLF + CRLF, 6, mtime=0)


def inflate(chunks: Iterator[bytes], piece: int = 1 << 16) -> Iterator[bytes | None]:
    """Decompressed pieces of at most ``piece`` bytes of a stream of gzip members; None ends each member."""
    z, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            begun = True
            try:
                out = z.decompress(chunk, piece)
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            if out:
                yield out
            chunk = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                yield None
                z, begun = zlib.decompressobj(31), False
        while begun and (out := z.decompress(z.unconsumed_tail, piece)):
            yield out
            if z.eof:
                yield None
                z, begun = zlib.decompressobj(31), False
    if begun:
        raise WarcError("the archive ends within a record")


class Frame:
    """One record, framed while its bytes arrive."""

    def __init__(self):
        self.head, self.fields, self.block, self.size, self.sha, self.end = bytearray(), None, bytearray(), 0, hashlib.sha1(), bytearray()

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            seen = max(0, len(self.head) - 3)
            self.head += data
            at = self.head.find(CRLF + CRLF, seen)
            if at < 0:
                if len(self.head) > HEAD_BYTES:
                    raise WarcError("no record header")
                return
            data = bytes(self.head[at + 4 :])
            lines = bytes(self.head[:at]).split(CRLF)
            if not lines[0].startswith(b"WARC/"):
                raise WarcError("no record header")
            self.fields = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
            if not self.fields.get("content-length", "").isdigit():
                raise WarcError("no Content-Length")
            self.size = int(self.fields["content-length"])
        own = data[: self.size - len(self.block)]
        self.sha.update(own)
        self.block += own
        self.end += data[len(own) :]
        if len(self.end) > 4:
            raise WarcError("Content-Length does not frame the block")

    def finish(self) -> dict:
        """Fields of the whole record; framing and digests are verified."""
        if self.fields is None:
            raise WarcError("no record header")
        if len(self.block) != self.size or self.end != CRLF + CRLF:
            raise WarcError("Content-Length does not frame the block")
        fields = self.fields
        if fields.get("warc-block-digest") != "sha1:" + base64.b32encode(self.sha.digest()).decode():
            raise WarcError("block digest differs")
        http, _, payload = bytes(self.block).partition(CRLF + CRLF)
        told = next((int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:")), -1)
        said, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("warc-type")
        if kind == "response" and (len(payload) != told or digest(payload) != said):
            raise WarcError("payload digest or length differs")
        number = lambda s: None if s is None or s == "null" else int(s)
        bare = lambda s: None if s is None else s.removeprefix("<urn:page:").removesuffix(">")
        return {
            "page_id": number(bare(fields.get("warc-record-id"))), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": number(bare(fields.get("warc-refers-to"))), "payload_bytes": told, "payload_digest": said,
            "payload": payload if kind == "response" else None,
        }


def records(chunks: Iterator[bytes], piece: int = 1 << 16) -> Iterator[dict]:
    """Records of a stream of compressed bytes, one at a time."""
    frame = Frame()
    for out in inflate(chunks, piece):
        if out is None:
            yield frame.finish()
            frame = Frame()
        else:
            frame.feed(out)


def members(chunks: Iterator[bytes], piece: int = 1 << 16) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    got: list[bytes] = []
    for out in inflate(chunks, piece):
        if out is None:
            yield b"".join(got)
            got = []
        else:
            got.append(out)


def parse(member: bytes) -> dict:
    """Fields of one decompressed record."""
    frame = Frame()
    frame.feed(member)
    return frame.finish()


def plan_records(pages: DataFrame, page_id: str, payload: str, url: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Choose record types. Payloads shorter than ``min_revisit_bytes`` are always responses."""
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        (F.col(url).cast("string") if url else F.lit("")).alias("url"),
        raw.alias("payload"), F.length(raw).cast("long").alias("size"), F.unhex(F.sha1(raw)).alias("sha1"),
    )
    first = rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "sha1", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull())
    return rows.select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers"), F.when(~again, F.col("payload")).alias("payload"), "size", "sha1",
    )


def write_warc(records: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records under ``uri``; a row per archive (path, n_records, bytes) when run.

    An archive is complete before it gets its name, so a retried task leaves
    no half file; the names listed in the result are those to read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own = uuid.uuid4().hex
            fs.create_dir(f"{root}/{own[:2]}", recursive=True)  # no folder holds all archives
            name = f"{root}/{own[:2]}/{own}"
            with fs.open_output_stream(name + ".tmp", compression=None) as out:
                for x in held:
                    out.write(x)
            fs.move(name + ".tmp", name + ".warc.gz")
            return pa.RecordBatch.from_pydict({"path": [f"{own[:2]}/{own}.warc.gz"], "n_records": [len(held)], "bytes": [size]})

        for batch in batches:
            for r in batch.to_pylist():
                held.append(x := record(r["page_id"], r["url"], r["kind"], r["refers"], r["payload"] or b"", r["sha1"], r["size"]))
                size += len(x)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return records.mapInArrow(run, "path string, n_records long, bytes long")


def read_warc(listed: DataFrame, uri: str) -> DataFrame:
    """Records of the archives that ``listed`` names under ``uri`` (path, n_records), opened by the tasks that read them."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, size, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for r in records(iter(lambda: stream.read(1 << 18), b"")):  # noqa: B023
                        out.append(r)
                        seen += 1
                        size += len(r["payload"] or b"")
                        if size > 4 << 20 or len(out) >= 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                if seen != told:
                    raise WarcError(f"{path} holds {seen} records of {told}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    n = listed.count()
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path", "n_records").repartition(max(1, min(n, max(parts, n // 64)))).mapInArrow(run, READ_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str | None = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    tune(spark)
    base = shared_dir(spark)
    uri = (base if "://" in base or base.startswith("file:") else f"file://{base}").rstrip("/") + f"/warc-{uuid.uuid4().hex}"
    uri = uri if "://" in uri else uri.replace("file:", "file://", 1)
    planned = plan_records(pages, page_id, payload, url, min_revisit_bytes)
    listed = uri + "-list"
    write_warc(planned, uri).write.parquet(listed)
    names = spark.read.parquet(listed)
    if names.isEmpty():
        return spark.createDataFrame([], T._parse_datatype_string(READ_SCHEMA))
    return read_warc(names, uri)
