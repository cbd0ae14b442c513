"""Scores of texts by a context tree learned from the corpus, beside a unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import Shared, cells, fold, stored
from emberlog.llm.ctw import TRUNK, ContextTree, counted, decisions, find, gram_codes, prepared

#: Grams (a byte and the context before it) whose branches one task weighs.
PART_GRAMS = 100_000
#: The grams seen most often, at most so many, have their probabilities broadcast (16 bytes each); all
#: others are joined.
FREQUENT_GRAMS = 2_000_000
#: The words seen most often, at most so many, have their counts broadcast; all others are joined.
FREQUENT_WORDS = 400_000
WORDS_KEPT = 200_000
GROUP_BYTES = 1 << 20
HELD_ENTRIES = 600_000
SMOOTHING = 0.1


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class _Keys(dict):
    """Keys of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = key = word_key(word)
        return key


END_KEY = word_key(b"\n")  # no word holds the end mark


def _groups(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in slices of about GROUP_BYTES of text, a longer text in a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy()
        first = size = 0
        for k, length in enumerate(sizes.tolist()):
            if size and size + length > GROUP_BYTES:
                part = batch.slice(first, k - first)
                yield part, cells(part, column)
                first, size = k, 0
            size += length
        if len(sizes) > first:
            part = batch.slice(first)
            yield part, cells(part, column)


class _Tally:
    """Counts by 64-bit key, handed on when they are many."""

    def __init__(self):
        self.parts, self.size, self.distinct = [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.distinct + HELD_ENTRIES:
            self.parts = [self._joined()]
            self.size = self.distinct = len(self.parts[0][0])

    def _joined(self):
        return counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def batches(self, kind: int, always: bool) -> Iterator[pa.RecordBatch]:
        if self.parts and (always or self.distinct > HELD_ENTRIES):
            keys, counts = self._joined()
            self.parts, self.size, self.distinct = [], 0, 0
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(counts[k : k + 100_000].astype(np.int64))],
                    ["kind", "key", "n"],
                )


def _count(batches):
    """Counts of byte grams (kind 0) and words (kind 1) of a partition's texts."""
    grams, words = _Tally(), _Tally()
    for _, texts in _groups(batches, "_text"):
        made = [prepared(text) for text in texts]
        grams.add(*(x.astype(t) for x, t in zip(counted(gram_codes([b for _, b in made])), (np.uint64, np.int64))))
        seen = Counter()
        for found, _ in made:
            seen.update(found)
        keys = np.fromiter(map(word_key, seen), np.int64, len(seen))
        keys, counts = np.r_[keys, END_KEY].view(np.uint64), np.r_[np.fromiter(seen.values(), np.int64, len(seen)), len(made)]
        words.add(keys, counts)
        yield from grams.batches(0, False)
        yield from words.batches(1, False)
    yield from grams.batches(0, True)
    yield from words.batches(1, True)


def count_corpus(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram: key, n) and (word: key, n) over all rows of `texts` (_text): each task adds up its own
    before the shuffle."""
    both = stored(texts.mapInArrow(_count, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    return tuple(both.where(F.col("kind") == kind).select("key", "n") for kind in (0, 1))


def _branches(rows: DataFrame, grams: int) -> DataFrame:
    """Rows with a gram as `key`, whole branches of the tree in each partition. A branch holds at most
    256^3 grams; text of words has a few hundred."""
    parts = max(1, -(-grams // PART_GRAMS))
    return rows.repartition(parts, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (TRUNK + 1)) - 1)))


def _columns(batches, *names: str) -> list[np.ndarray]:
    table = [[batch.column(name).to_numpy(zero_copy_only=False) for name in names] for batch in batches]
    return [np.concatenate(column) for column in zip(*table)] if table else [np.empty(0, np.int64) for _ in names]


def _branch_tree(keys: np.ndarray, counts: np.ndarray) -> ContextTree:
    """The branches of some grams, given in any order."""
    order = np.argsort(keys)
    return ContextTree(*decisions(keys[order].astype(np.uint64), counts[order]), first=TRUNK + 1)


def _weigh(batches):
    """What branches hand up: for each last decision of the trunk its counts and the logarithm of the
    product of P_w over its branches here."""
    tree = _branch_tree(*_columns(batches, "key", "n"))
    own = tree.levels[0][0]
    if len(own):
        keys, up = np.unique(own & np.uint64((1 << 8 * (TRUNK + 1)) - 1), return_inverse=True)
        sums = [np.bincount(up, x, len(keys)) for x in (*tree.counts, tree.log_weighted)]
        for k in range(0, len(keys), 100_000):
            at = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int64)), *(pa.array(x[at]) for x in sums)], ["key", "zeros", "ones", "below"])


def fit_trunk(grams: DataFrame, size: int) -> ContextTree:
    """The contexts of up to TRUNK bytes, weighed with all that is below them. Branches are weighed
    where they lie; of them only sums per decision of the trunk (65,536 contexts of 255) come here."""
    handed = _branches(grams, size).mapInArrow(_weigh, "key bigint, zeros double, ones double, below double")
    sums = handed.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    keys, zeros, ones, below = (sums.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
    order = np.argsort(keys)
    return ContextTree(keys[order].astype(np.uint64), zeros[order], ones[order], last=TRUNK, below=below[order]).mix()


def _evaluate(trunk: Shared):
    def run(batches):
        keys, counts, wanted = _columns(batches, "key", "n", "wanted")
        seen, wanted = counts > 0, np.unique(keys[wanted.astype(bool)]).astype(np.uint64)
        top = trunk.load()
        tree = _branch_tree(keys[seen], counts[seen]).mix(top)
        for k in range(0, len(wanted), 100_000):
            part = wanted[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(tree.log10(part, top))], ["key", "log"])

    return run


def gram_logs(grams: DataFrame, wanted: DataFrame, trunk: Shared, size: int) -> DataFrame:
    """(key, log): log10 of the probability that the tree of `grams` (key, n) gives to each distinct
    gram of `wanted` (key), met in training or not."""
    asked = wanted.select("key", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("wanted"))
    both = grams.select("key", "n", F.lit(False).alias("wanted")).unionAll(asked)
    return _branches(both, size).mapInArrow(_evaluate(trunk), "key bigint, log double")


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows whose count `n` is at least the least power of two that leaves at most `most` of them."""
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = {r["power"]: r["rows"] for r in counts.groupBy(power).agg(F.count("*").alias("rows")).collect()}
    return counts.where(F.col("n") >= (1 << _least_power(sizes, most)))


def _arrays(table: pa.Table, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns, by ascending key."""
    keys, values = (table.column(c).to_numpy() for c in (key, value))
    order = np.argsort(keys)
    return keys[order], values[order]


def _least_power(sizes: dict[int, int], most: int) -> int:
    """The least power of two from which on at most `most` are left."""
    least, left = 0, sum(sizes.values())
    while left > most:
        left -= sizes.get(least, 0)
        least += 1
    return least


GRAMS = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))


def _rare_grams(codes: np.ndarray, rows: np.ndarray, size: int) -> pa.Array:
    """For each of `size` rows its distinct codes and how often it holds each."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])]) if len(codes) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(codes)])
    starts = np.searchsorted(rows[first], np.arange(size + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(codes[first].astype(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])
    return pa.ListArray.from_arrays(pa.array(starts), pairs)


def _scores(grams: Shared, frequent: Shared):
    """Texts with the sums over their frequent grams and words, and all others they hold."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("base", pa.float64()), ("known", pa.int64()), ("rare", pa.list_(pa.int64())), ("grams", GRAMS)]
    )

    def run(batches):
        gram_keys, gram_values = grams.load()
        keys, logs = frequent.load()
        known = _Keys()
        for batch, texts in _groups(batches, "_text"):
            made = [prepared(text) for text in texts]
            codes = gram_codes([b for _, b in made])
            distinct, where = np.unique(codes, return_inverse=True)
            at = find(gram_keys, distinct.astype(np.int64))
            each = np.where(at >= 0, gram_values[at], 0.0)[where] if len(gram_keys) else np.zeros(len(codes))
            lengths = [len(b) for _, b in made]
            scores = np.add.reduceat(each, np.r_[0, np.cumsum(lengths)[:-1]])
            left = (at < 0)[where]
            others = _rare_grams(codes[left], np.repeat(np.arange(len(made)), lengths)[left], len(made))
            base, frequent_words, rare = [], [], []
            for found, _ in made:
                own = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                held = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                base.append(float(logs[at[held]].sum()))
                frequent_words.append(int(held.sum()))
                rare.append(own[~held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([len(f) + 1 for f, _ in made], pa.int64()), pa.array(scores), pa.array(base, pa.float64()), pa.array(frequent_words, pa.int64()), pa.array(rare, pa.list_(pa.int64())), others],
                schema=schema,
            )

    return run


def score_texts(documents: DataFrame, held_out_folds: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `documents`.

    Learns from rows whose crc32(id as text) modulo `held_out_folds` is not 0 (null ids are scored,
    not learned from, and not held out) and scores all. `score` is log10 of the probability of the
    text under the context tree: words with A-Z lower-cased and parted by ASCII white space, a
    space between, an end mark behind; its code length per byte is -score * log2(10) / bytes.
    `base_score` is that of the same tokens under smoothed word counts. All counts cover all
    training text and are added up per task before they are shuffled. The tree has every context
    met, so it grows with the corpus; its branches are weighed apart, in as many tasks as it takes.
    Probabilities of the most frequent grams and counts of the most frequent words are broadcast,
    those of all others joined to the documents that hold them. Null text is empty: one end token.
    Repeated rows count and are scored one by one. An empty table gives no rows; without training
    rows every byte costs eight bits.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text"))
    grams, words = count_corpus(texts.where(fold("_id", held_out_folds) != 0).select("_text"))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    total, norm = size["total"], size["total"] + SMOOTHING * (size["kinds"] + 1)
    distinct = grams.count()
    trunk = Shared(spark.sparkContext, fit_trunk(grams, distinct))
    known = _arrays(gram_logs(grams, _frequent(grams, FREQUENT_GRAMS), trunk, distinct).toArrow(), "key", "log")
    keys, counts = _arrays(_frequent(words, FREQUENT_WORDS).toArrow(), "key", "n")
    run = _scores(*(Shared(spark.sparkContext, pair) for pair in (known, (keys, np.log10((counts + SMOOTHING) / norm)))))
    columns = "doc_id bigint, n_tokens bigint, score double, base double, known bigint, rare array<bigint>, grams array<struct<key: bigint, n: bigint>>"
    scored = stored(texts.mapInArrow(run, columns).withColumn("row", F.monotonically_increasing_id()), "scored")
    # Of grams no key is hot but one that many rows hold and none of those learned from; adaptive
    # joins split it.
    rare = scored.select("row", F.inline("grams"))
    asked = stored(rare.select("key").distinct(), "asked")
    logs = gram_logs(grams, asked, trunk, distinct + asked.count())
    rest = rare.join(logs, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("rest"))

    def log(n):
        return F.log10((n + SMOOTHING) / F.lit(float(norm)))

    row = words.where(F.col("key") == END_KEY).first()
    end = row["n"] if row else 0
    # No key here is hot: the words seen most often are not among them.
    others = scored.select("row", F.explode("rare").alias("key")).join(words, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    others = others.groupBy("row").agg(F.sum(log(F.col("n"))).alias("rare_score"), F.count_if(F.col("n") > 0).alias("rare_known"))
    joined = scored.drop("rare", "grams").join(others, "row", "left").join(rest, "row", "left")
    return joined.select(
        "doc_id",
        F.coalesce(fold("doc_id", held_out_folds) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + (1 if end else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_score", F.lit(0.0)) + F.lit(math.log10((end + SMOOTHING) / norm))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
