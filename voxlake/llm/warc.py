"""Dictionary-compressed WARC archives: writer and reader.

Each task writes archives of bounded size. An archive starts with a skippable frame that holds a Zstandard dictionary built
from records of the archive; then every record follows as a frame of its own, so that one can be read without the others.
A payload that was archived already is a revisit record, which names the record that holds it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.session import settle

#: Bytes of records in one archive, before compression.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
#: Fixed by the formats.
SKIPPABLE, DICTIONARY_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:page:"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """A response, or a revisit with the HTTP headers alone. Line breaks cannot be in a header and are left out of the URL."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's parts; the payload's length and digest are those of the full payload, also in a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    urn = lambda name: fields[name][len(_URN) + 1 : -1] if name in fields else None
    return {
        "page_id": urn("WARC-Record-ID") or None,
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": urn("WARC-Refers-To"),
        "payload_bytes": length if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
        "payload": None if revisit else payload,
    }


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records from all over the archive; where those are too few for that, they are the dictionary themselves."""
    size = sum(map(len, records))
    sample = records[:: max(1, size // SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    trained = _dictionary(records)
    packed = zstandard.compress(trained.as_bytes())
    yield struct.pack("<II", SKIPPABLE, len(packed)) + packed
    writer = zstandard.ZstdCompressor(level=3, dict_data=trained)
    for x in records:
        yield writer.compress(x)


def records_in(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary")
    raw = zstandard.decompress(stream.read(size))
    kind = zstandard.DICT_TYPE_FULLDICT if raw.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    rest = stream.read(1 << 16)
    while rest:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not (rest := rest or stream.read(1 << 16)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        rest = rest or stream.read(1 << 16)


def with_originals(pages: DataFrame, id_col: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """Adds `_first`: the smallest id with the same payload where the row is not that one itself, else null.

    Digests are counted before they are shuffled, and only those that repeat are joined. The join is between two plain
    exchanges, so that a payload that many pages share is split at run time.
    """
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    known = pages.withColumn("_digest", F.when(F.octet_length(content) >= min_revisit_bytes, F.sha1(content)))
    repeated = known.where("_digest is not null").groupBy("_digest").agg(F.count("*").alias("_n"), F.min(id_col).alias("_first")).where("_n > 1")
    joined = known.join(settle(repeated.select("_digest", "_first")), "_digest", "left").drop("_digest")
    return joined.withColumn("_first", F.when(~F.coalesce(F.col(id_col) == F.col("_first"), F.lit(False)), F.col("_first")))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row into archives in `folder` (any file system that pyarrow knows); returns what was written.

    Of equal payloads of at least `min_revisit_bytes`, the one with the smallest page id is a response, the others revisit
    it; rows that repeat its id are responses too. A null payload is empty; a row without an id is never the original of
    others, but a response where no row has one. Out: `path`, `records`, `bytes`, for the archives of tasks that ended
    well; a task that ran twice leaves files that are not listed. An empty table writes nothing.
    """
    named = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"), F.col(page_id).alias("_id"))
    rows = with_originals(named, "_id", "html", min_revisit_bytes).select("page_id", "url", "html", F.col("_first").cast("string").alias("first"))
    base = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, at = _file_system(base)
        system.create_dir(at)
        number, waiting, size = 0, [], 0

        def put() -> pa.RecordBatch:
            nonlocal number, waiting, size
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}.warc.zst"
            part, total = f"{at}/.{name}.{uuid.uuid4().hex}", 0
            with system.open_output_stream(part, compression=None) as out:
                for x in archive(waiting):
                    out.write(x)
                    total += len(x)
            system.move(part, f"{at}/{name}")
            done = pa.RecordBatch.from_pylist([{"path": f"{base}/{name}", "records": len(waiting), "bytes": total}])
            number, waiting, size = number + 1, [], 0
            return done

        for batch in batches:
            for key, link, payload, first in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                waiting.append(record(key, link, payload or b"", first, first is not None))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield put()
        if waiting:
            yield put()

    return settle(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(written: DataFrame) -> DataFrame:
    """All records of the archives at `path`: ids and references as strings, the payload of responses, and the length and
    digest of the full payload, which for a response are taken from the payload itself."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _file_system(path)
                with system.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for raw in records_in(stream):
                        rows.append(parsed(raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    paths = written.select("path").repartition(max(1, written.count()), F.xxhash64("path"))
    return paths.mapInArrow(read, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
