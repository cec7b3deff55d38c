"""WARC archives: pages written as records, one gzip member each, and read back in sequence.

Pages with equal payloads become one response, the page with the largest id, and revisits that refer to it
and hold the HTTP head without the payload. Each task writes one archive under a name of its own and renames
it; only one row an archive goes through the driver. The reader inflates one member at a time with zlib,
frames the block by its content length and verifies block and payload digests.

Defined results: a null page is an empty payload; payloads below ``least`` bytes are never revisits; rows
that share an id and a payload have one response among them; a null page_id orders below all others; an empty
table gives an empty result; other columns aren't used. A payload that very many pages share meets its one
response as the skewed left side of a join, which adaptive execution splits.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, numbered, open_store, put_file, small_batches
from .tokens import _make_folder

_READ = 1 << 18
#: Bytes inflated at once.
_STEP = 1 << 13
_DATE = "2020-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1, without a label."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page, uid: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{uid}>"


def page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return int(page) if page else None


def record(url: str, page, uid: int, payload: bytes, refers: tuple | None) -> bytes:
    """One record of a page, compressed as a gzip member: a response, or a revisit of ``refers`` (page, uid)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(page, uid)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else quote(c) for c in url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
    ]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*refers))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def members(stream, size: int = _READ) -> Iterator[bytes]:
    """The gzip members of a stream, inflated one at a time and ``_STEP`` bytes at once, so that what follows a member isn't copied for each."""
    data, at = memoryview(b""), 0
    while at < len(data) or (data := memoryview(stream.read(size))):
        at = 0 if at >= len(data) else at
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                data, at = memoryview(stream.read(size)), 0
                if not data:
                    raise ValueError("the archive ends within a record")
            part = data[at : at + _STEP]
            parts.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record, framed by its content length; the block's digest is verified."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("the content length doesn't frame the record")
    if fields["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("block digest")
    return fields, block


def read_record(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the payload (None for a revisit)."""
    fields, block = parse(raw)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError("payload digest")
    refers = page_of(fields["WARC-Refers-To"][1:-1]) if kind == "revisit" else None
    return page_of(fields["WARC-Record-ID"][1:-1]), size, said, kind, refers, payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write the archives and return (archive, records, size) for each."""
    spark = pages.sparkSession
    small_batches(spark, 512)
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = numbered(rows, "uid").withColumn("key", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.length("payload") >= least).groupBy("key").agg(F.max(F.struct("page", "uid")).alias("first"))
    firsts = materialize(firsts.select("key", F.col("first.page").alias("first_page"), F.col("first.uid").alias("first_uid")), "warc-first")
    rows = rows.join(firsts, "key", "left")
    revisit = F.coalesce((F.col("uid") != F.col("first_uid")) & (F.length("payload") >= least), F.lit(False))
    rows = rows.select("page", "uid", "url", "payload", revisit.alias("revisit"), "first_page", "first_uid")
    _make_folder(folder)

    def batches(it):
        part = TaskContext.get().partitionId()
        store, at = open_store(folder)
        n = size = 0

        def records():
            nonlocal n, size
            for batch in it:
                x = batch.to_pydict()
                for page, uid, u, body, again, fp, fu in zip(*(x[k] for k in ("page", "uid", "url", "payload", "revisit", "first_page", "first_uid"))):
                    data = record(u, page, uid, body, (fp, fu) if again else None)
                    n, size = n + 1, size + len(data)
                    yield data

        put_file(store, f"{at}/part-{part:06d}.warc.gz", records())
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.warc.gz"]), pa.array([n]), pa.array([size])], names=["archive", "records", "size"])

    made = rows.mapInArrow(batches, "archive string, records long, size long").where("records > 0").collect()
    return spark.createDataFrame(made, "archive string, records long, size long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def batches(it):
        store, at = open_store(folder)
        for batch in it:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(read_record(raw)[: len(names)])
                        if len(rows) >= 512:
                            yield _batch(rows, kinds, names)
                            rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    n = max(1, archives.count())
    return archives.repartition(min(n, 4 * archives.sparkSession.sparkContext.defaultParallelism)).mapInArrow(batches, schema)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = fresh_path(spark, "warc")
    return read_archives(write_archives(pages, folder), folder)
