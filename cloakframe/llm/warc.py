"""WARC archives: written and read one gzip member per record.

Writing goes by partition: each task writes archives of bounded size into a shared folder, under names that depend on
the partition alone, and moves a finished file into place, so a task that runs again leaves the same files.  Equal
payloads of at least ``REVISIT`` bytes are stored once, with the smallest id; the others become revisit records that
name it.  Which record is which is settled on digests and ids; only then are the payloads dealt out.

The reader is sequential: it takes a file in small chunks, inflates one member at a time, frames each record by its
Content-Length, and compares block and payload digests with those in the header.  A record is held in memory, a file
never is.

Defined cases: a null payload is empty, and below the limit, so it is a response; a null id is written without an id
and read back as null (it is never referred to, and refers to nothing); rows that repeat an id are records of their
own, and those equal to the first in id and payload are responses as well; an empty table gives no archives and no
rows; a record with a wrong digest or a truncated one is an error that names file and offset.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.staging import shared_folder, staged

#: Payloads of fewer bytes are never revisits.
REVISIT = 100
_ARCHIVE, _CHUNK, _LEVEL = 32 << 20, 1 << 16, 5
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, of any kind that pyarrow knows."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit without, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", _DATE)]
    if key is not None:
        fields.append(("WARC-Record-ID", f"<urn:page:{key}>"))
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else "%20" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block + b"\r\n\r\n") + deflate.flush()


@dataclass(frozen=True)
class Record:
    """A verified record; ``payload`` is null for a revisit, whose length and digest are those it refers to."""

    offset: int
    kind: str
    key: int | None
    url: str | None
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _members(stream, where: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, inflated piece by piece."""
    offset, waiting = 0, b""
    while True:
        inflate, content, used = zlib.decompressobj(31), bytearray(), 0
        while not inflate.eof:
            data = waiting or stream.read(_CHUNK)
            if not data:
                if used:
                    raise ValueError(f"{where} at {offset}: truncated member")
                return
            content += inflate.decompress(data)
            waiting = inflate.unused_data
            used += len(data) - len(waiting)
        yield offset, bytes(content)
        offset += used


def read(stream, where: str = "archive") -> Iterator[Record]:
    """The records of an open archive, in order."""
    for offset, content in _members(stream, where):
        end = content.find(b"\r\n\r\n")
        lines = content[:end].decode().split("\r\n")
        field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(field.get("content-length", "-1"))
        block, tail = content[end + 4:end + 4 + length], content[end + 4 + length:]
        if end < 0 or not lines[0].startswith("WARC/") or length < 0 or len(block) != length or tail != b"\r\n\r\n":
            raise ValueError(f"{where} at {offset}: not framed as a record")
        if field["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"{where} at {offset}: wrong block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, kind = field["warc-payload-digest"].removeprefix("sha256:"), field["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{where} at {offset}: wrong payload digest")
        yield Record(offset, kind, _key(field.get("warc-record-id")), field.get("warc-target-uri"),
                     _key(field.get("warc-refers-to")), size, digest, payload if kind == "response" else None)


def _key(name: str | None) -> int | None:
    return int(name.removeprefix("<urn:page:").removesuffix(">")) if name else None


def _first_of_equal(pages: DataFrame) -> DataFrame:
    """(key, digest, refers_to) of the pages that are revisits; pages: key, digest, n."""
    long = pages.where((F.col("n") >= REVISIT) & F.col("key").isNotNull())
    groups = long.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("size")).where("size > 1")
    return long.join(groups, "digest").where("key <> refers_to").select("key", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html") -> DataFrame:
    """Writes the archives and returns their manifest (path, records), written beside them."""
    given = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"),
                         F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    given = given.withColumn("digest", F.sha2("payload", 256))
    revisits = staged(_first_of_equal(given.select("key", "digest", F.length("payload").alias("n"))), "revisits")
    dealt = given.join(revisits.hint("shuffle_hash"), ["key", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done: list[tuple[str, int]] = []
        out, size, n = None, 0, 0

        def close() -> None:
            out.close()
            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            system.move(f"{base}/.{attempt}-{len(done)}", f"{base}/{name}")
            done.append((f"{folder}/{name}", n))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, digest, url, payload, refers_to = row
                if out is None:
                    out, size, n = system.open_output_stream(f"{base}/.{attempt}-{len(done)}"), 0, 0
                member = record(key, url, payload, digest, refers_to)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= _ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return staged(dealt.select("key", "digest", "url", "payload", "refers_to").mapInArrow(
        run, "path string, records long"), "manifest")


def records(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives, verified: path, offset, record_type, key, url, refers_to, payload_bytes,
    payload_digest and, if asked for, payload.  Archives are dealt out one by one."""
    names = ["path", "offset", "record_type", "key", "url", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    sql = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _place(path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(place, compression=None) as stream:
                    for r in read(stream, path):
                        row = (path, r.offset, r.kind, r.key, r.url, r.refers_to, r.payload_bytes, r.payload_digest)
                        rows.append((*row, r.payload) if payloads else row)
                        held += len(r.payload or b"") if payloads else 200
                        if held > 16 << 20:
                            yield _table(rows, names, kinds)
                            rows, held = [], 0
                if rows:
                    yield _table(rows, names, kinds)

    dealt = manifest.select("path").repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(run, ", ".join(f"{n} {sql[k]}" for n, k in zip(names, kinds)))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all pages to a new shared folder and reads the archives back."""
    spark = pages.sparkSession
    return records(spark, write(pages, shared_folder(spark, "archives"), id_col, url_col, payload_col), payloads=False)
