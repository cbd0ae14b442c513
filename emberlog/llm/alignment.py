"""Alignment of two tokenizers' tokens over the same text, by their byte ranges."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import Shared, stored
from emberlog.llm.tokens import Encoder, byte_characters, per_worker

#: Pairs whose counts every executor holds, the most frequent ones; the others are joined.
CACHED_PAIRS = 2_000_000
#: Bytes of the texts aligned together (a longer text is a group of its own), and about the tokens
#: of a lane: a text's lanes advance side by side.
GROUP_BYTES, LANE_TOKENS = 2 << 20, 64
_ID_BITS = 20  # of an id within a pair
_PIECES_KEPT, _PIECE_CHARS = 300_000, 40
_LED = re.compile(r" (?<=\S )(?=\S)")
_SPACE_MARK = "▁"


def merge_lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lockstep merge of many token sequences at once.

    `ends_*` are the byte ends of all tokens, rising; lane k starts at tokens first_a[k], first_b[k]
    and stops where lane k + 1 starts; both its sides cover the same bytes. One state vector holds
    the pointers of all lanes: every step links each lane's two tokens, cuts where both end, and
    moves on the side (or both) that ends first; finished lanes are compacted away.
    Returns the linked (a, b) token indices and the (a, b) token indices that end a group.
    """
    at_a, at_b = first_a.copy(), first_b.copy()
    stop_a = np.r_[first_a[1:], len(ends_a)]
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    live = at_a < stop_a
    at_a, at_b, stop_a = at_a[live], at_b[live], stop_a[live]
    while len(at_a):
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        links_a.append(at_a)
        links_b.append(at_b)
        both = end_a == end_b
        cuts_a.append(at_a[both])
        cuts_b.append(at_b[both])
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        live = at_a < stop_a
        if not live.all():
            at_a, at_b, stop_a = at_a[live], at_b[live], stop_a[live]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(links_a), join(links_b), join(cuts_a), join(cuts_b)


class Aligner:
    """Token ids of texts by a byte-level tokenizer file (A, read " " + text) and a sentencepiece model
    (B, which adds that space itself), and their alignment.

    Both tokenizers cut before a single space between other characters (checked for B: no piece of its
    vocabulary has a space mark after another character), so distinct words are encoded once.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a, "led", special=False), SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_characters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(_SPACE_MARK, " ").encode() for k, p in enumerate(pieces)
        ]
        self.by_words = not any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) for p in pieces)
        self.sizes_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.shown = {
            end: np.array([f"{k}{end}" for k in range(max(len(self.bytes_a), len(self.bytes_b)))], object) for end in ",|;"
        }
        self.known: dict[str, tuple[np.ndarray, np.ndarray, bool]] = {}

    def _encoded(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """A's ids, B's ids, and whether both spell each piece, which starts with a space."""
        found = list(map(self.known.get, pieces))
        missing = [k for k, one in enumerate(found) if one is None]
        if missing:
            new = [pieces[k] for k in missing]
            ids_a = [np.frombuffer(ids, "<u4").astype(np.int64) for ids in self.a.lookup(new)]
            ids_b = self.b.encode([piece[1:] for piece in new], num_threads=1)
            if len(self.known) > _PIECES_KEPT:
                self.known.clear()
            for k, piece, a, b in zip(missing, new, ids_a, ids_b):
                text = piece.encode()
                same = b"".join([self.bytes_a[i] for i in a]) == text == b"".join([self.bytes_b[i] for i in b])
                found[k] = (a, np.array(b, np.int64), same)
                if len(piece) <= _PIECE_CHARS:
                    self.known[piece] = found[k]
        return found

    def _pieces(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the piece at each place of all texts in a row, and the texts' bounds in them."""
        if not self.by_words:
            whole = [" " + text for text in texts.to_pylist()]
            distinct = {piece: k for k, piece in enumerate(dict.fromkeys(whole))}
            return list(distinct), np.array([distinct[p] for p in whole], np.int64), np.arange(len(whole) + 1)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        at, bounds = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        words = coded.dictionary.to_pylist()
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        pieces = [" " + w for w in words]
        if odd[at].any():  # other white space beside a space: these texts are cut one by one
            places = {piece: k for k, piece in enumerate(pieces)}
            parts = []
            for k in range(len(bounds) - 1):
                part = at[bounds[k] : bounds[k + 1]]
                if odd[part].any():
                    first, *rest = _LED.split(" " + texts[k].as_py())
                    part = np.array([places.setdefault(p, len(places)) for p in [first, *(" " + r for r in rest)]], np.int64)
                parts.append(part)
            pieces, at = list(places), np.concatenate(parts)
            bounds = np.r_[0, np.cumsum([len(part) for part in parts])]
        used, at = np.unique(at, return_inverse=True)
        return [pieces[k] for k in used], at, bounds

    def align(self, texts: pa.Array, keep_groups: bool) -> Iterator[dict]:
        """One dict per text of a large_string array without nulls."""
        pieces, at, bounds = self._pieces(texts)
        encoded = self._encoded(pieces)
        count_a, count_b = (np.array([len(one[side]) for one in encoded], np.int64) for side in (0, 1))
        spelt = np.array([one[2] for one in encoded], bool)
        n_texts = len(texts)
        good = np.zeros(n_texts, bool)
        filled = pc.binary_length(texts).to_numpy() > 0
        for k in np.flatnonzero(filled):
            good[k] = spelt[at[bounds[k] : bounds[k + 1]]].all()
        owner = np.repeat(np.arange(n_texts), np.diff(bounds))
        kept = good[owner]
        at, owner = at[kept], owner[kept]  # places of texts that both spell

        def laid(side, counts):
            flat = np.concatenate([one[side] for one in encoded]) if encoded else np.zeros(0, np.int64)
            first = np.cumsum(counts) - counts
            each = counts[at]
            stop = np.cumsum(each)
            return flat[np.repeat(first[at] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)], stop - each

        ids_a, from_a = laid(0, count_a)
        ids_b, from_b = laid(1, count_b)
        text_a, text_b = np.repeat(owner, count_a[at]), np.repeat(owner, count_b[at])
        # Lanes start with a text and every some tokens, always where a piece starts: both sides cut there.
        lane = np.ones(len(at), bool)
        lane[1:] = (owner[1:] != owner[:-1]) | (from_a[1:] // LANE_TOKENS != from_a[:-1] // LANE_TOKENS)
        link_a, link_b, cut_a, cut_b = merge_lanes(
            np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]), from_a[lane], from_b[lane]
        )
        n_a, n_b = (np.bincount(t, minlength=n_texts) for t in (text_a, text_b))
        n_groups, n_links = (np.bincount(text_a[i], minlength=n_texts) for i in (cut_a, link_a))
        keys = text_a[link_a] << 2 * _ID_BITS | ids_a[link_a] << _ID_BITS | ids_b[link_b]
        keys, times = np.unique(keys, return_counts=True)
        pair_ends = np.searchsorted(keys, np.arange(1, n_texts + 1) << 2 * _ID_BITS)
        pairs = keys & ((1 << 2 * _ID_BITS) - 1)
        shown = self._shown(ids_a, ids_b, cut_a, cut_b)
        first, pair_first = 0, 0
        for k in range(n_texts):
            last, groups = first + n_a[k] + n_b[k], ""
            if good[k]:
                groups = "".join(shown[first:last].tolist())[:-1]
            found = {
                "n_a": int(n_a[k]), "n_b": int(n_b[k]), "n_groups": int(n_groups[k]), "n_links": int(n_links[k]),
                "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if good[k] else "",
                "pairs": pairs[pair_first : pair_ends[k]], "times": times[pair_first : pair_ends[k]],
            }
            if keep_groups:
                found["groups"] = groups
            yield found
            first, pair_first = last, pair_ends[k]

    def _shown(self, ids_a, ids_b, cut_a, cut_b) -> np.ndarray:
        """Every token's decimal id and the mark behind it, in the order of groups, A before B."""
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[cut_a], last_b[cut_b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        end_a, end_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        out = np.empty(len(ids_a) + len(ids_b), object)
        out[np.arange(len(ids_a)) + np.r_[0, end_b][group_a]] = np.where(last_a, self.shown["|"][ids_a], self.shown[","][ids_a])
        out[np.arange(len(ids_b)) + end_a[group_b] if len(ids_b) else []] = np.where(last_b, self.shown[";"][ids_b], self.shown[","][ids_b])
        return out


def _aligned(batches, path_a: str, path_b: str, keep_groups: bool):
    aligner = per_worker("aligner", (path_a, path_b), lambda: Aligner(path_a, path_b))
    for batch in batches:
        texts = batch.column("_text").cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GROUP_BYTES, "right")))
            rows = list(aligner.align(pa.concat_arrays([texts.slice(first, last - first)]), keep_groups))
            columns = {"_id": batch.column("_id").slice(first, last - first)}
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                columns[name] = pa.array([row[name] for row in rows], pa.int64())
            for name in ("groups_sha256", "groups") if keep_groups else ("groups_sha256",):
                columns[name] = pa.array([row[name] for row in rows], pa.string())
            offsets = pa.array(np.r_[0, np.cumsum([len(row["pairs"]) for row in rows])], pa.int32())
            for name, kind in (("pairs", np.int64), ("times", np.int32)):
                columns[name] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([row[name] for row in rows]).astype(kind)))
            yield pa.RecordBatch.from_pydict(columns)
            first = last


def _looked_up(batches, shared: Shared):
    """Sums over each document's pairs by the shared counts; pairs that are not among them are left."""
    pairs, counts, best = shared.load()
    for batch in batches:
        lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        wanted = lists.flatten().to_numpy()
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        found = np.minimum(np.searchsorted(pairs, wanted), max(len(pairs) - 1, 0))
        known = pairs[found] == wanted if len(pairs) else np.zeros(len(wanted), bool)
        sums = np.zeros((3, len(wanted) + 1), np.int64)
        if len(pairs):
            sums[0, 1:] = np.cumsum(np.where(known, times * counts[found], 0))
            sums[1, 1:] = np.cumsum(np.where(known & best[found], times, 0))
        sums[2, 1:] = np.cumsum(~known)
        score, n_best, ends = (row[bounds[1:]] - row[bounds[:-1]] for row in sums[:2]), None, sums[2][bounds]
        score, n_best = score
        rest = pa.array(ends, pa.int32())
        kept = [batch.column(n) for n in batch.schema.names if n not in ("pairs", "times")]
        names = [n for n in batch.schema.names if n not in ("pairs", "times")]
        kept += [pa.array(n_best), pa.array(score)]
        kept += [pa.ListArray.from_arrays(rest, pa.array(wanted[~known])), pa.ListArray.from_arrays(rest, pa.array(times[~known], pa.int32()))]
        yield pa.RecordBatch.from_arrays(kept, names=[*names, "n_best", "count_sum", "pairs", "times"])


def align_tokens(
    documents: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text",
    keep_groups: bool = False, cached_pairs: int = CACHED_PAIRS,
) -> DataFrame:
    """One row per row of `documents`: the id column, n_a and n_b (tokens), n_groups (stretches between
    bytes where both tokenizers end a token), n_links (pairs of tokens whose bytes overlap), n_best
    (links whose id pair no other pair of the same A id exceeds in count), count_sum (of the links'
    pair counts), groups_sha256 and, if kept, groups: `a1,a2|b1;a3|b2,b3`. A pair's count is the number
    of rows that hold it linked.

    Texts that are null or empty, or that one tokenizer does not spell byte for byte, have no tokens:
    zeros and ''. Strings of special tokens in a text are plain text. Repeated rows and ids are rows of
    their own; other columns are not read; an empty table gives an empty result.

    Each text is aligned once; its distinct pairs are kept in the scratch folder. Counts form map-side
    before their shuffle. The `cached_pairs` most frequent pairs at most go to every executor, the
    documents' other pairs are joined with theirs.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    numbers = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string" + (", groups string" if keep_groups else "")
    pairs = "pairs array<bigint>, times array<int>"
    aligned = source.mapInArrow(lambda batches: _aligned(batches, path_a, path_b, keep_groups), f"_id {kind}, {numbers}, {pairs}")
    aligned = stored(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")), "pairs")
    side = F.shiftright("pair", _ID_BITS)
    highest = counts.groupBy(side.alias("a")).agg(F.max("held").alias("highest"))
    counts = counts.withColumn("a", side).join(highest, "a").select("pair", "held", (F.col("held") == F.col("highest")).alias("best"))
    counts = stored(counts, "pair-counts")
    # The power of two from which on the pairs fit: at most 64 rows reach the driver.
    sizes = counts.groupBy(F.floor(F.log2("held")).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
    fits, total = 64, 0
    for row in sizes:
        total += row["count"]
        if total > cached_pairs:
            break
        fits = row["size"]
    frequent = counts.where(F.col("held") >= float(2**fits)).toArrow()
    order = np.argsort(frequent.column("pair").to_numpy())
    shared = Shared(spark.sparkContext, tuple(frequent.column(n).to_numpy()[order] for n in ("pair", "held", "best")))
    head = f"_id {kind}, {numbers}, _row bigint"
    scored = aligned.select("_id", *[f.split()[0] for f in numbers.split(", ")], "_row", "pairs", "times").mapInArrow(
        lambda batches: _looked_up(batches, shared), f"{head}, n_best bigint, count_sum bigint, {pairs}"
    )
    if total > cached_pairs:
        scored = stored(scored, "looked-up")
        rest = scored.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", "p.pairs", "p.times")
        rare = counts.where(F.col("held") < float(2**fits)).select(F.col("pair").alias("pairs"), "held", "best")
        rest = rest.join(rare, "pairs").groupBy("_row").agg(
            F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("held")).alias("more_sum")
        )
        scored = scored.join(rest, "_row", "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
            }
        )
    kept = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    return scored.select(F.col("_id").alias(id_column), *kept)
