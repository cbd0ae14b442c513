"""Packing of documents into training sequences along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cells
from emberlog.llm.tokens import encoded

SEQUENCE_TOKENS = 2048
BUCKETS, DIMENSIONS, BITS = 64, 4, 12
BATCH_ROWS = 4096


def _projection() -> np.ndarray:
    """The fixed matrix from hashed vectors to the curve's space."""
    return np.random.default_rng(20240229).standard_normal((BUCKETS, DIMENSIONS))


def document_point(text: bytes, matrix: np.ndarray) -> np.ndarray:
    """Hashed bag of four-byte grams of the whole text (A-Z lower-cased), signed, of unit length,
    projected; zeros for texts under four bytes."""
    data = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(DIMENSIONS)
    grams = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    slots = grams * np.uint32(2654435761) >> np.uint32(32 - (2 * BUCKETS).bit_length() + 1)
    counts = np.bincount(slots, minlength=2 * BUCKETS)
    vector = counts[:BUCKETS] - counts[BUCKETS:]
    length = np.sqrt(float(vector @ vector))
    return vector @ matrix / length if length else np.zeros(DIMENSIONS)


def grid(points: np.ndarray) -> np.ndarray:
    """Cells of 2**BITS per axis; coordinates are about normal, so they are spread by a logistic curve."""
    share = 1 / (1 + np.exp(-1.702 * points))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(cells_: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (any number of axes).

    Per level, from the top bit: an axis whose bit is set mirrors the lower bits of the first
    axis, one whose bit is clear swaps them with the first axis's; the bits, Gray-decoded over the
    axes, are the level's digit.
    """
    x = np.array(cells_, np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(axes):
            is_set = (x[axis] & bit) != 0
            change = np.where(is_set, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ change)
            x[axis] ^= change if axis else 0
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    keys = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            keys = keys << 1 | (x[axis] >> level & 1)
    return keys


def _keyed(batches):
    matrix = _projection()
    for batch in batches:
        points = [document_point(text, matrix) for text in cells(batch, "_text")]
        keys = hilbert_keys(grid(np.stack(points))) if points else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "_key"])


def cut(documents: Iterator[tuple[int, bytes]], size: int) -> Iterator[tuple]:
    """(doc, start, ids, doc_tokens, sequence, offset) of every piece, in order.

    `documents` gives (doc, ids as bytes). The stream is cut at every `size` tokens; what is left
    at the end makes sequences whose lengths are powers of two, the longest first.
    """
    sequence, room, held = 0, size, []
    for doc, ids in documents:
        total, at = len(ids) // 4, 0
        while at < total:
            length = min(room, total - at)
            held.append((doc, at, ids[4 * at : 4 * (at + length)], total))
            at, room = at + length, room - length
            if not room:
                yield from _placed(held, sequence)
                sequence, room, held = sequence + 1, size, []
    left = size - room
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            doc, start, ids, total = held.pop(0)
            if len(ids) > 4 * room:
                held.insert(0, (doc, start + room, ids[4 * room :], total))
                ids = ids[: 4 * room]
            part.append((doc, start, ids, total))
            room -= len(ids) // 4
        yield from _placed(part, sequence)
        sequence += 1


def _placed(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in pieces:
        yield doc, start, ids, total, sequence, offset
        offset += len(ids) // 4


def _packed(path: str, cut_at: str, end_id: int, size: int):
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        stream = ((row["_id"], ids + end) for row, ids in encoded(batches, path, cut_at))
        rows = []
        for doc, start, ids, total, sequence, offset in cut(stream, size):
            rows.append((doc, start, ids, total, first + sequence, offset))
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE_TOKENS, cut_at: str = "led", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: one row
    per piece of a document in a sequence of at most `size` tokens.

    Documents get a key on a Hilbert curve through a projection of their hashed byte grams and are
    range-sorted by (key, id), so that equal keys spread over partitions; each partition is cut
    along the curve as a stream. All sequences are full but the last ones of a partition, whose
    lengths are powers of two, so that nothing is padded. A document's tokens are those of
    `tokenizer` (a file every executor has) and `end_id`. One shuffle, of the texts; a task holds
    one batch of documents and one sequence.

    Null text is empty: its document is its end token. Null ids and repeated rows are packed like
    any other. An empty table gives no rows.
    """
    source = documents.select(F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text"))
    keyed = source.mapInArrow(_keyed, "_id bigint, _text string, _key bigint")
    order = keyed.repartitionByRange("_key", "_id").sortWithinPartitions("_key", "_id", F.xxhash64("_text"))
    return order.select("_id", "_text").mapInArrow(
        _packed(tokenizer, cut_at, end_id, size),
        "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
