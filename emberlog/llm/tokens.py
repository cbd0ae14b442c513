"""Token ids of whole texts by a file of the tokenizers library."""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text pieces whose ids a worker keeps (twice as many for a while), and the longest piece it keeps.
PIECES_KEPT, PIECE_CHARS = 300_000, 40
#: Bytes of the texts encoded together; a longer one is a group of its own.
GROUP_BYTES = 14 << 20
_LED = re.compile(r" (?<=\S )(?=\S)")
_HEAD = "\x02"
#: Pieces of these characters alone are split here; the tokenizer's own patterns see any other.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed values of both tokenizers' patterns
_SPLIT = {
    "led": re.compile(f"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+"),
    "dropped": re.compile(f"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^ {_LETTERS}0-9]+"),
}
_PROBES = ("The", " the", " it's,", "(x1)", "\u00c9t\u00e9 ", "a-b", " don't!!", "2024,", "\u00fcber.")


def byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: printable ones themselves, the
    others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def per_worker(kind: str, key, make: Callable):
    """One object of a kind per Python worker, which Spark reuses from task to task; another key
    takes its place."""
    kept = sys.modules.setdefault("_emberlog_worker", types.ModuleType("_emberlog_worker")).__dict__
    if kept.get(kind, (None,))[0] != key:
        kept.pop(kind, None)
        kept[kind] = key, make()
    return kept[kind][1]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, the same as encoding each text in one piece.

    Texts are cut where the tokenizer cuts in any case, and the ids of the pieces are kept, as most
    words come again and again. `cut` says where that is:

    - "led": a space belongs to the word after it. Cut before a single space and around a single
      line end, where the characters on both sides are no white space. Texts with other white
      space are cut at such spaces only.
    - "dropped": white space is dropped. Cut at spaces and line ends.
    - "whole": any other tokenizer; texts are not cut.

    Strings of the file's special tokens within a text become those tokens, as the library has it,
    or are plain text with `special=False`.
    """

    def __init__(self, path: str, cut: str, special: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added and special else None
        if any(set(content) & set(" \n") for content in added):
            cut = "whole"
        self.cut = cut
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        alphabet = byte_characters()
        self.written = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0x20, 0x100)}
        self.split = _SPLIT.get(cut)
        probes = [p for p in _PROBES if _PLAIN.fullmatch(p)]
        if self.split and [self._plain(p) for p in probes] != self._whole(probes):
            self.split = None  # another tokenizer than thought: use its own patterns throughout

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, piece: str) -> bytes:
        """A piece of plain characters: its words go to the tokenizer's model one by one."""
        found = []
        for word in self.split.findall(piece if self.cut == "led" else piece.lower()):
            ids = self.words.get(word)
            if ids is None:
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(word.translate(self.written))]).tobytes()
                if len(word) <= PIECE_CHARS:
                    self.words[word] = ids
            found.append(ids)
        if len(self.words) > PIECES_KEPT:
            self.words.clear()
        return b"".join(found)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Of new distinct pieces."""
        plain = [
            self.split is not None and _PLAIN.fullmatch(piece) is not None and not (self.added and self.added.search(piece))
            for piece in pieces
        ]
        rest = iter(self._whole([piece for piece, p in zip(pieces, plain) if not p]))
        return [self._plain(piece) if p else next(rest) for piece, p in zip(pieces, plain)]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, known or new."""
        found = list(map(self.known.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            names = [pieces[k] for k in missing]
            ids = list(map(self.older.get, names))
            new = iter(self._ids([name for name, known in zip(names, ids) if known is None]))
            ids = [next(new) if known is None else known for known in ids]
            for k, one in zip(missing, ids):
                found[k] = one
            self.known.update((name, one) for name, one in zip(names, ids) if len(name) <= PIECE_CHARS)
            if len(self.known) > PIECES_KEPT:
                self.known, self.older = {}, self.known
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Of a large_string array without nulls."""
        if self.cut == "whole":
            return self._whole(texts.to_pylist())
        joined = texts
        if self.cut == "led":
            head = pa.scalar(_HEAD, pa.large_string())
            joined = pc.binary_join_element_wise(head, pc.replace_substring(joined, "\n", f" \n {_HEAD}"), pa.scalar("", pa.large_string()))
        else:
            joined = pc.replace_substring(joined, "\n", " ")
        lists = pc.split_pattern(joined, " ")
        coded = lists.flatten().dictionary_encode()
        at, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        pieces = coded.dictionary.to_pylist()
        odd = np.zeros(len(pieces), bool)
        if self.cut == "led":
            for k, piece in enumerate(pieces):
                bare = piece[1:] if piece[:1] == _HEAD else piece
                odd[k] = piece != "\n" and (not bare or bare[0].isspace() or bare[-1].isspace() or _HEAD in bare)
                pieces[k] = piece if piece == "\n" else bare if bare is not piece else " " + piece
            pieces = [_HEAD if o else piece for o, piece in zip(odd, pieces)]
        ids = self.lookup(pieces)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        values = np.frombuffer(b"".join(ids), "<u4")
        firsts = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[at]
        stops = np.cumsum(each, dtype=np.int32)
        where = np.repeat(firsts[at] - (stops - each), each)
        where += np.arange(len(where), dtype=np.int32)
        tokens = values[where]
        bounds = np.r_[0, stops][ends]
        found = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        if self.cut == "led":
            # Texts that hold the head mark themselves, and those with odd white space.
            apart = pc.match_substring(texts, _HEAD).to_numpy(zero_copy_only=False).astype(np.int64)
            apart += np.add.reduceat(np.r_[odd[at], False].astype(np.int64), ends[:-1]) * (np.diff(ends) > 0)
            for k in np.flatnonzero(apart):
                found[k] = self._spaced(texts[int(k)].as_py())
        return found

    def _spaced(self, text: str) -> bytes:
        """A text with several kinds of white space together, or with the head mark in it."""
        first, *rest = _LED.split(text)
        pieces = [first, *[" " + piece for piece in rest]]
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.lookup(distinct)))
        return b"".join(map(ids.__getitem__, pieces))


def encoded(batches, path: str, cut: str, text_column: str = "_text") -> Iterator[tuple[dict, bytes]]:
    """Each row of Arrow batches as a dict without its text, and the text's ids; null text is empty."""
    encoder = per_worker("encoder", (path, cut), lambda: Encoder(path, cut))
    for batch in batches:
        names = [n for n in batch.schema.names if n != text_column]
        rows = batch.select(names).to_pylist()
        texts = batch.column(text_column).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(rows):
            start = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + GROUP_BYTES)))
            yield from zip(rows[first:last], encoder.encode(texts.slice(first, last - first)))
            first = last
