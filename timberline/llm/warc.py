"""WARC archives compressed record by record with a Zstandard dictionary that the file itself carries.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record after it is a frame of
its own, compressed with that dictionary, so any record can be read alone. Each file's dictionary is built from its
first records, then the others stream; files end at a size. A file's name holds its task attempt, and the table of files
that Spark commits is the archive: what a lost or repeated attempt wrote is not in it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, written
from .wordhash import slices

# Fixed values of the format.
MAGIC = 0x184D2A5D
_RESPONSE = "response"
_REVISIT = "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records, and their bytes, from which a file's dictionary is built; the others do not wait for it.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 8 << 20
#: Compressed bytes from which a task begins another file, and bytes that a reader asks for at a time.
FILE_BYTES, CHUNK = 256 << 20, 32 << 10
#: Payloads that more than one page has, up to which their newest pages are broadcast (some 60 bytes each); beyond, each
#: payload's pages are dealt to SALTS tasks at most.
BROADCAST_ROWS, SALTS = 500_000, 32
_FILES = "path string, records long, bytes long"
_PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {_REVISIT if revisit else _RESPONSE}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:  # no address, but it comes back as it was
            head.append(f"X-Target: {json.dumps(url)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary of about that size; empty where there is too little to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _written(folder: str, date: str, level: int, file_bytes: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                for page_id, url, page, first, newest in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True):
                    yield record(page_id, url, (page or "").encode(), newest, newest is not None and first is not True, date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        where, base = fs.FileSystem.from_uri(folder)
        task, stream, number = TaskContext.get(), records(batches), 0
        where.create_dir(base, recursive=True)
        while True:
            sample, held = [], 0
            for x in stream:
                sample.append(x)
                held += len(x)
                if len(sample) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                    break
            if not sample:
                return
            learned = dictionary(sample)
            packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(learned) if learned else None, write_checksum=True)
            path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            n = size = 0
            with where.open_output_stream(path, compression=None) as to:
                if learned:
                    size += to.write(struct.pack("<II", MAGIC, len(learned)) + learned)
                for some in (sample, stream):
                    for x in some:
                        size += to.write(packer.compress(x))
                        n += 1
                        if size >= file_bytes and some is stream:
                            break
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return run


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive every page in files below folder (any address that pyarrow opens), one or more for each partition with
    rows; returns path, records, bytes of each file. The files are written when the result is read, once.

    Of equal payloads (null: empty) the row with the largest page id is the response; others are revisits of it. Rows
    that repeat that id are responses too. A null id is smaller than any; where all ids of a payload are null, each is a
    response. A null url leaves its header out. A very long page is one record, held whole while it is compressed. Pages
    stay in their partitions: payloads with copies, by their digests, come to them.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    newest = rows.select("id", digest.alias("digest")).groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("n")).filter("n > 1 AND newest IS NOT NULL")
    newest = written(newest.select("digest", "newest"), "newest")
    told = rows.withColumn("digest", digest)
    if newest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        told = told.join(F.broadcast(newest), "digest", "left")
    else:
        told = told.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        told = told.join(newest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["digest", "salt"], "left")
    told = told.select("id", "url", "html", F.col("id").eqNullSafe(F.col("newest")).alias("first"), "newest")
    return told.mapInArrow(_written(folder, date, level, file_bytes), _FILES)


def _frames(f) -> Iterator[bytes]:
    """The records of an open archive, one after another; of the file, a chunk is held at a time."""
    import zstandard

    head, learned = f.read(8), None
    if len(head) == 8 and struct.unpack_from("<I", head)[0] == MAGIC:
        learned, head = zstandard.ZstdCompressionDict(f.read(struct.unpack_from("<I", head, 4)[0])), b""
    opener, left, one, parts = zstandard.ZstdDecompressor(dict_data=learned), head, None, []
    while left or (left := f.read(CHUNK)):
        one = one or opener.decompressobj()
        parts.append(one.decompress(left))
        left = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one, parts = None, []
    if one is not None:
        raise ValueError("the archive ends inside a record")


def _parsed(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    intact = None if kind == _REVISIT else len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    url = json.loads(fields["X-Target"]) if "X-Target" in fields else fields.get("WARC-Target-URI")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-Id"), url, size, digest, kind, number("X-Refers-To-Page-Id"), intact


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in _PAGES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with where.open_input_file(path) as f:
                    for raw in _frames(f):
                        rows.append(_parsed(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of archives (a table with their path): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, intact (whether a response's payload has its length and digest; null for a revisit, which has none)."""
    return files.select("path").mapInArrow(_read(folder), _PAGES)


def archived(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Write pages to a new folder in the shared one, keep the list of files as a table, and read all of them back."""
    folder, listed = shared_folder(spark, "warc"), shared_folder(spark, "warc-files")
    write_archives(pages, folder, **columns).write.parquet(listed)
    files = spark.read.schema(_FILES).parquet(listed)
    return read_archives(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), folder)
