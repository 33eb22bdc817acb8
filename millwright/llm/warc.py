"""Operator 10: WARC archives with one zstd frame per record and a leading dictionary frame.

Writing: of records with equal payloads of ``least`` bytes or more the one with the smallest page id
is a response and the others revisit it.  Each task packs its records into archives of about
``archive_bytes``: a skippable frame that holds the dictionary, then a frame for every record.
Archives are rows (archive, content), the shape of Spark's binaryFile source, and move through the
shared folder like any table; ``read_archives`` takes either.

Reading: the dictionary is loaded from the leading skippable frame, frames are found by walking their
block headers, each record is decoded alone, and the version line, headers, lengths, record end
and payload digest are checked.  A bad record stops the read with its archive and offset.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import staged

BROADCAST_DIGESTS = 200_000  # about 30 MB
MAGIC_DICT = 0x184D2A5D  # skippable frame that holds the dictionary
MAGIC_FRAME = 0xFD2FB528
MAGIC_TRAINED = 0xEC30A437
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = re.compile(r"<urn:page:(-?\d+|null)>")


def _record(page, url, kind: str, digest: str, size: int, refers, html: bytes) -> bytes:
    block = _HTTP + html if kind == "response" else _HTTP
    url = re.sub(r"[\r\n\s]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url}"] if url is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"] if kind == "revisit" else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A trained dictionary, or the end of the samples as a raw one where there are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def pack_archive(records: list[bytes], sample_bytes: int = 1 << 20) -> bytes:
    import zstandard

    sample, total = [], 0
    for r in records:
        if total >= sample_bytes:
            break
        sample.append(r[:8192])
        total += len(sample[-1])
    raw = dictionary(sample)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", MAGIC_TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_checksum=True, write_content_size=True)
    return struct.pack("<II", MAGIC_DICT, len(raw)) + raw + b"".join(map(press.compress, records))


def frame_end(data: bytes, at: int) -> int:
    """End of the zstd frame at ``at``, from its header and block headers."""
    if struct.unpack_from("<I", data, at)[0] != MAGIC_FRAME:
        raise ValueError(f"no zstd frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def unpack_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame."""
    import zstandard

    at, loaded = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC_DICT:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = data[8:at]
        if raw[:4] == struct.pack("<I", MAGIC_FRAME):  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", MAGIC_TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
        loaded = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    reader = zstandard.ZstdDecompressor(dict_data=loaded) if loaded else zstandard.ZstdDecompressor()
    while at < len(data):
        if 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(data, at)
        yield at, reader.decompressobj().decompress(data[at:end])
        at = end


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record, checked."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    got = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header {line!r}")
        got[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in got:
            raise ValueError(f"no {name}")
    size = int(got["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size}, found {len(rest) - 4}")
    kind, digest = got["warc-type"], got.get("warc-payload-digest", "").removeprefix("sha256:")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
        if "x-payload-length" in got and int(got["x-payload-length"]) != len(payload):
            raise ValueError("payload length differs")
    page = _PAGE.fullmatch(got["warc-record-id"])
    refers = _PAGE.fullmatch(got.get("warc-refers-to", ""))
    number = lambda m: None if m is None or m[1] == "null" else int(m[1])
    return {"page_id": number(page), "url": got.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
            "payload_bytes": int(got.get("x-payload-length", len(payload))), "refers_to": number(refers), "payload": payload if kind == "response" else None}


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, records, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"part-{part:05d}-{serial:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack_archive(records)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html")]
            for page, url, kind, digest, n, refers, html in zip(*cols):
                records.append(_record(page, url, kind, digest, n, refers, html or b""))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush()
                    serial, records, size = serial + 1, [], 0
        if records:
            yield flush()

    return run


def write_archives(pages: DataFrame, least: int = 100, archive_bytes: int = 8 << 20) -> DataFrame:
    """(archive, content) rows for all pages; staged in the shared folder.

    Null html is an empty payload, a null url leaves the header out.  Page ids that are null never
    stand for a group; where all are null all records are responses.  Rows that repeat the smallest
    id of a group are responses too.  An empty table gives no archives, a very long page is one record,
    and columns besides page_id, url and html are left out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = staged(first, "first-pages")
    if first.count() <= BROADCAST_DIGESTS:  # else by a join that deals the payloads out
        first = F.broadcast(first)
    rows = rows.join(first, "payload_digest", "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    rows = rows.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_digest", "payload_bytes", F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("html")).alias("html"))
    return staged(rows.mapInArrow(_write(archive_bytes), "archive string, content binary"), "archives")


_RECORD = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}


def _records(name: str, data: bytes) -> Iterator[dict]:
    """Records of one archive; whatever is wrong with a frame or a record is told with its place."""
    import zstandard

    at = 0
    try:
        for at, record in unpack_archive(data):
            yield parse_record(record)
    except (ValueError, IndexError, struct.error, zstandard.ZstdError) as e:
        raise ValueError(f"{name}, at or after byte {at}: {e}") from e


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(_RECORD.items()))
    for batch in batches:
        for name, data in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
            found = _records(name, data)
            while rows := list(itertools.islice(found, 500)):
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of (archive, content) rows: page_id, url, record_type, payload_digest, payload_bytes,
    refers_to, payload.  For files use ``spark.read.format("binaryFile")`` with path as archive."""
    return archives.select("archive", "content").mapInArrow(_read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
