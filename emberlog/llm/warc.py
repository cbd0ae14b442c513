"""Dictionary-compressed web archives: one Zstandard frame per record, the dictionary in front."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import sampled
from emberlog.llm.tokenfiles import create

LEVEL = 6
REVISIT_BYTES = 1000
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES, SAMPLE_BYTES = 400, 64 << 10, 6 << 20
BATCH_BYTES = 8 << 20
# Frame numbers of Zstandard and of archives with a dictionary, the revisit profile.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One response, or a revisit of the response with the same payload (headers only)."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    fields.append(("WARC-Record-ID", f"<{_ID}{'' if page is None else page}>"))
    fields.append(("WARC-Date", date))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says; of a response also its payload, whose digest is compared."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if version != "WARC/1.1" or kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("damaged record")
    page = fields["WARC-Record-ID"][1 + len(_ID) : -1]
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": int(page) if page else None,
        "uri": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers[1 + len(_ID) : -1]) if refers else None,
    }


def write_archive(sink, records: Iterator[bytes], dictionary: bytes) -> int:
    """Skippable frame with the dictionary, then each record as a frame of its own with checksum."""
    sink.write(struct.pack("<2I", DICTIONARY_FRAME, len(dictionary)) + dictionary)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    count = 0
    for data in records:
        sink.write(compressor.compress(data))
        count += 1
    return count


def read_archive(source) -> Iterator[bytes]:
    """The records of an open file, one after the other."""
    magic, size = struct.unpack("<2I", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = source.read(size)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        frame = decompressor.decompressobj()
        made = []
        while not frame.eof:
            chunk = rest or source.read(1 << 16)
            rest = b""
            if not chunk:
                if made or frame.unconsumed_tail:
                    raise ValueError("cut off record")
                return
            made.append(frame.decompress(chunk))
        rest = frame.unused_data
        yield b"".join(made)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary, or none where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _sample(pages: DataFrame, date: str) -> list[bytes]:
    """About SAMPLE_RECORDS records from all of the table, each from a payload of at most
    SAMPLE_RECORD_BYTES, until they have SAMPLE_BYTES."""
    small = sampled(pages.where(F.octet_length("_html") <= SAMPLE_RECORD_BYTES), SAMPLE_RECORDS, "_id", "_html")
    rows = sorted(small.select("_id", "_url", "_html").collect(), key=lambda r: (r["_id"] is None, r["_id"] or 0, r["_html"]))
    found, size = [], 0
    for row in rows:
        data = record(row["_id"], row["_url"], bytes(row["_html"]), None, date)
        size += len(data)
        if size > SAMPLE_BYTES:
            break
        found.append(data)
    return found


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])


def _writer(folder: str, dictionary: bytes, date: str):
    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return

        def records():
            yield record(first["_id"], first["_url"], first["_html"], first["_refers"], date)
            for row in rows:
                yield record(row["_id"], row["_url"], row["_html"], row["_refers"], date)

        counts = []
        part = TaskContext.get().partitionId()
        path = create(folder, f"pages-{part:06d}.warc.zst", lambda sink: counts.append(write_archive(sink, records(), dictionary)))
        yield pa.RecordBatch.from_pylist([{"path": path, "records": counts[0]}], schema=_FILES)

    return run


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Archives every row below `folder` and returns the list of files (path, records).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least
    REVISIT_BYTES the one with the largest id is a response (so are rows that repeat that id) and
    the others revisit it; without an id in the group all are responses. Smaller payloads are
    responses. Groups are counted by digest and size, pre-aggregated, then joined back on them;
    adaptive execution splits a hot group. The dictionary is trained from a bounded sample and
    leads every file. `folder` must be one all executors reach through Arrow's file systems; the
    list, one row per file, reaches the driver. Null ids and urls leave their header empty or
    out. An empty table writes no file.
    """
    html = F.coalesce(F.encode(F.col(html_column), "UTF-8"), F.lit(b""))
    source = pages.select(F.col(id_column).cast("bigint").alias("_id"), F.col(url_column).alias("_url"), html.alias("_html"))
    dictionary = train_dictionary(_sample(source, date))
    keyed = source.withColumns({"_digest": F.sha1("_html"), "_bytes": F.octet_length("_html")})
    groups = (
        keyed.where(F.col("_bytes") >= REVISIT_BYTES)
        .groupBy("_digest", "_bytes")
        .agg(F.max("_id").alias("_head"), F.count("*").alias("_n"))
        .where("_n > 1 AND _head IS NOT NULL")
        .drop("_n")
    )
    refers = F.when(F.col("_id").isNull() | (F.col("_id") != F.col("_head")), F.col("_head"))
    rows = keyed.join(groups, ["_digest", "_bytes"], "left").select("_id", "_url", "_html", refers.alias("_refers"))
    files = rows.mapInArrow(_writer(folder, dictionary, date), "path string, records bigint").collect()
    return pages.sparkSession.createDataFrame(sorted(files), "path string, records bigint")


def _reader(payloads: bool):
    def run(batches):
        schema = pa.schema(
            [("page_id", pa.int64()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for row in batch.to_pylist():
                system, path = pafs.FileSystem.from_uri(row["path"])
                found, size = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for data in read_archive(source):
                        found.append(parsed(data) if payloads else parsed(data) | {"payload": None})
                        size += len(data)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(found, schema=schema)
                            found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, uri, payload (of responses, if asked for), payload_bytes, payload_digest, record_type
    and refers_to of every record in the listed files, one task per file; the digest of each
    response is compared with its payload."""
    schema = "page_id bigint, uri string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    count = max(1, min(files.count(), 100_000))
    return files.repartitionByRange(count, "path").mapInArrow(_reader(payloads), schema)
