"""Benchmark passages in documents by Wu-Manber search over word numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cells, stored

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Digits, lower-cased letters and all bytes beyond ASCII belong to words; every other byte parts them.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class WuManber:
    """Patterns of one length, as tuples of word numbers.

    `shift` holds, for each block of two neighbouring words (one, for patterns of one word), how
    far it is from its last place in any pattern to the patterns' end; a block that none holds
    moves the search on by the most. Blocks with shift 0 lead to a bucket of the patterns that end
    so, of which one with an equal first word is compared whole.
    """

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[int, list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern[0], []).append((pattern, items))

    def search(self, text: list[int]) -> Iterator[tuple[int, set]]:
        """(place of the first word, items) of every occurrence."""
        length, most, shift = self.length, self.most, self.shift.get
        at, last = length - 1, len(text)
        while at < last:
            key = (text[at - 1], text[at]) if self.block == 2 else (text[at],)
            move = shift(key, most)
            if move:
                at += move
                continue
            start = at - length + 1
            for pattern, items in self.buckets[key].get(text[start], ()):
                if pattern == tuple(text[start : at + 1]):
                    yield start, items
            at += 1


class Matcher:
    """All windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if ids else 0):
                by_length.setdefault(size, {}).setdefault(ids[start : start + size], set()).add(item)
        self.searches = [WuManber(size, patterns) for size, patterns in sorted(by_length.items())]

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [start, end) that occurrences cover, merged, and the items that occur."""
        number = self.numbers.get
        ids = [number(w, 0) for w in found]
        spans, items = [], set()
        for search in self.searches:
            for start, owners in search.search(ids):
                spans.append((start, start + search.length))
                items |= owners
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most `size` bytes of text (or one item), read piece by piece."""
    block, held = [], 0
    for item, text in benchmark.orderBy("item_id").toLocalIterator():
        text = (text or "").encode()
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    if block:
        yield block


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document row with `n_words`, `spans` (merged word ranges that benchmark windows cover)
    and `item_ids` (items with a window in it, ascending).

    A window is `window` consecutive words of an item, or all words of a shorter one. `documents`
    keeps all its columns but any with those three names; it needs `text`. The benchmark goes to
    the executors in blocks of bounded size, one pass over the documents for each; passes after
    the first start from a checkpoint. No shuffle. Null and empty texts and items have no words;
    null item ids take no part; repeated rows are searched one by one; without items nothing is hit.
    """
    kept = [c for c in documents.columns if c not in ("n_words", "spans", "item_ids")]
    frame = documents.select(*kept).withColumns(
        {
            "n_words": F.lit(None).cast("bigint"),
            "spans": F.array().cast("array<struct<start:bigint,end:bigint>>"),
            "item_ids": F.array().cast("array<bigint>"),
        }
    )
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    searched = False
    for block in _item_blocks(items, block_bytes):
        if searched:
            frame = stored(frame, "decontaminated")
        frame = frame.mapInArrow(_searcher(block, window), frame.schema)
        searched = True
    return frame if searched else frame.mapInArrow(_searcher([], window), frame.schema)


def _searcher(items: list[tuple[int, bytes]], window: int):
    def run(batches):
        matcher = Matcher(items, window)
        for batch in batches:
            counts, spans, owners = [], [], []
            for text, old_spans, old_items in zip(cells(batch, "text"), batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()):
                found = words(text)
                covered, who = matcher.hits(found)
                counts.append(len(found))
                spans.append([{"start": a, "end": b} for a, b in merged(covered + [(s["start"], s["end"]) for s in old_spans])])
                owners.append(sorted(who.union(old_items)))
            new = {"n_words": counts, "spans": spans, "item_ids": owners}
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def hit_words(spans: str) -> Column:
    """Number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
