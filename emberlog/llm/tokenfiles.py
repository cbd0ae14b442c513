"""Token files: independent Zstandard frames, found and checked through a trailing seek table.

A file is, in order:
- frames of up to FRAME_TOKENS tokens of whole documents (a longer document has one of its own). A
  frame's content is three little-endian 64-bit integers (documents, ids before the frame in the
  file, 1 if some id is null), the document ids, their token counts, one byte per document that is
  1 where the id is null, and the token ids as 32-bit integers;
- a skippable frame with the first and last document id of each frame;
- a skippable frame with the seek table of Zstandard's seekable format: compressed size,
  decompressed size and 32-bit checksum per frame, the number of frames, a descriptor with the
  checksum flag, and a closing magic number.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.tokens import encoded

FRAME_TOKENS = 1 << 16
FRAMES_PER_TASK = 64
LEVEL = 1
# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80


def _checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents, (id or None, ids as bytes), to an open binary file."""

    def __init__(self, sink):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=LEVEL)
        self.documents = self.tokens = 0
        self.frames: list[tuple[int, int, int, int, int]] = []
        self.held: list[tuple[int | None, bytes]] = []
        self.size = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) // 4 > FRAME_TOKENS:
            self._flush()
        self.held.append((doc, ids))
        self.size += len(ids) // 4

    def _flush(self) -> None:
        docs = np.array([d or 0 for d, _ in self.held], "<i8")
        null = np.array([d is None for d, _ in self.held], "u1")
        counts = np.array([len(ids) // 4 for _, ids in self.held], "<i8")
        head = struct.pack("<3q", len(docs), self.tokens, int(null.any()))
        content = b"".join([head, docs.tobytes(), counts.tobytes(), null.tobytes(), *[ids for _, ids in self.held]])
        frame = self.compressor.compress(content)
        self.sink.write(frame)
        self.frames.append((len(frame), len(content), _checksum(content), int(docs[0]), int(docs[-1])))
        self.documents += len(docs)
        self.tokens += int(counts.sum())
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = b"".join(struct.pack("<2q", *f[3:]) for f in self.frames)
        self.sink.write(struct.pack("<2I", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<3I", *f[:3]) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<2I", SEEK_TABLE, len(table)) + table)


class TokenFileReader:
    """Reads an open seekable file of known size; frames are read, decompressed and checked one by one."""

    def __init__(self, source, size: int):
        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a token file")
        source.seek(size - 9 - 12 * count)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table.T
        self.starts = np.r_[0, np.cumsum(self.sizes)][:-1]
        source.seek(int(self.sizes.sum()) + 8)
        self.range = np.frombuffer(source.read(16 * count), "<i8").reshape(count, 2)

    def frame(self, k: int) -> Iterator[tuple[int | None, int, bytes]]:
        """(document, ids before it in the file, its ids) of a frame's documents."""
        self.source.seek(int(self.starts[k]))
        content = self.decompressor.decompress(self.source.read(int(self.sizes[k])), max_output_size=int(self.raw[k]))
        if _checksum(content) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        count, before, _ = struct.unpack_from("<3q", content)
        docs = np.frombuffer(content, "<i8", count, 24)
        counts = np.frombuffer(content, "<i8", count, 24 + 8 * count)
        null = np.frombuffer(content, "u1", count, 24 + 16 * count)
        at = 24 + 17 * count
        for doc, size, missing in zip(docs.tolist(), counts.tolist(), null.tolist()):
            yield None if missing else doc, before, content[at : at + 4 * size]
            at, before = at + 4 * size, before + size

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, bytes]]:
        """The rows of these documents; only frames whose range can hold one are decompressed."""
        order = np.array(sorted(wanted), np.int64)
        for k, (first, last) in enumerate(self.range.tolist()):
            if np.searchsorted(order, first) < np.searchsorted(order, last, "right"):
                yield from ((doc, ids) for doc, _, ids in self.frame(k) if doc in wanted)


def create(folder: str, name: str, write) -> str:
    """Puts what `write(sink)` writes at folder/name, whole or not at all; returns the path. A task
    that runs again, or twice at a time, puts the same content there."""
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    draft = f"{base}/_{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as sink:
        write(sink)
    system.move(draft, f"{base}/{name}")
    return f"{folder}/{name}"


def _writer(folder: str, tokenizer: str, cut_at: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        rows = encoded(batches, tokenizer, cut_at)
        first = next(rows, None)
        if first is None:
            return
        part, made = TaskContext.get().partitionId(), []

        def write(sink):
            writer = TokenFileWriter(sink)
            writer.add(first[0]["_id"], first[1] + end)
            for row, ids in rows:
                writer.add(row["_id"], ids + end)
            writer.close()
            made.append(writer)

        path = create(folder, f"tokens-{part:06d}.zst", write)
        found = {"part": part, "path": path, "frames": len(made[0].frames), "documents": made[0].documents, "tokens": made[0].tokens}
        yield pa.RecordBatch.from_pylist([found], schema=_MANIFEST)

    return run


_MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("frames", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int, cut_at: str = "dropped", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes all documents to token files below `folder`, in ascending order of id within and across
    files (null ids first, equal ids by text), and returns the list of files: part, path, frames,
    documents, tokens, start (ids in the files before).

    A document's ids are those of `tokenizer` (a file every executor has) and `end_id`; null text is
    empty. Texts are range-sorted by id, one file per partition; a task holds one batch of
    documents and one frame. `folder` must be one all executors reach through Arrow's file
    systems. The list has one row per file and is all that reaches the driver. An empty table
    writes no file.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text"))
    tie = F.xxhash64("_text")
    order = source.repartitionByRange("_id", tie).sortWithinPartitions("_id", tie)
    files = order.mapInArrow(_writer(folder, tokenizer, cut_at, end_id), "part bigint, path string, frames bigint, documents bigint, tokens bigint")
    start, rows = 0, []
    for row in sorted(files.collect(), key=lambda r: r["part"]):
        rows.append((*row, start))
        start += row["tokens"]
    return spark.createDataFrame(rows, "part bigint, path string, frames bigint, documents bigint, tokens bigint, start bigint")


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            system, path = pafs.FileSystem.from_uri(row["path"])
            with system.open_input_file(path) as source:
                reader = TokenFileReader(source, source.size())
                for k in range(row["from"], min(row["from"] + FRAMES_PER_TASK, row["frames"])):
                    found = [{"doc_id": doc, "start": row["start"] + before, "ids": ids} for doc, before, ids in reader.frame(k)]
                    yield pa.RecordBatch.from_pylist(found, schema=schema)


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of every
    document in the listed files; tasks take ranges of frames, each frame's checksum is compared."""
    ranges = files.select("path", "frames", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1, F.lit(FRAMES_PER_TASK).cast("bigint"))).alias("from"))
    count = max(1, min(ranges.count(), 100_000))
    return ranges.repartitionByRange(count, "path", "from").mapInArrow(_reader, "doc_id bigint, start bigint, ids binary")
