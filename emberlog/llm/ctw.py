"""Context-tree weighting over bytes, each split into binary decisions.

A context node is the last d bytes, d = 0 to DEPTH; in each, a binary tree over the eight bits of the
next byte holds counts of zeros and ones. Every decision node weighs its Krichevsky-Trofimov
estimate against those of the contexts one byte longer:

    P_w(s) = 1/2 P_kt(s) + 1/2 prod P_w(children of s)

P_w of the training text fixes the weight of stopping at each node, and with it one probability for
each decision in each context. No context is left out. The tree comes apart below TRUNK bytes: the
branch of one context of TRUNK + 1 bytes needs of all others only what the trunk hands down, so
branches are weighed apart and a tree may be larger than any one task.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
TRUNK = 2  # contexts of so many bytes: at most 65,793, whatever the corpus
START = 0x0A  # the end mark of a text, also what comes before its first byte


def prepared(text: bytes) -> tuple[list[bytes], bytes]:
    """Words (A-Z lower-cased, parted by ASCII white space) and the bytes the model codes: the words
    with a space between and an end mark after them."""
    words = text.lower().split()
    return words, b" ".join(words) + b"\n"


def gram_codes(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each byte of each text: itself in the low byte, then the bytes before it, nearest first."""
    pad = bytes([START]) * depth
    joined = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    codes = joined[depth:].copy()
    for back in range(1, depth + 1):
        codes |= joined[depth - back : len(joined) - back] << np.uint64(8 * back)
    keep = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) + depth for t in texts])[:-1] - depth
    for k in range(depth):
        keep[ends + k] = False
    return codes[keep]


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their (summed) counts."""
    if weights is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(weights, first) if len(codes) else weights


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


SMALL = 64
_SMALL_KT = _log_kt(*np.indices((SMALL, SMALL)).astype(float))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.empty(len(zeros))
    small = (zeros < SMALL) & (ones < SMALL)
    out[small] = _SMALL_KT[zeros[small].astype(np.int64), ones[small].astype(np.int64)]
    out[~small] = _log_kt(zeros[~small], ones[~small])
    return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def decisions(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context and bits so far behind a leading one), zeros and ones of each decision that the
    last bytes of ascending distinct codes take."""
    keys, zeros, ones = [], [], []
    context, byte = codes >> np.uint64(8) << np.uint64(8), codes & np.uint64(255)
    for bit in range(8):
        key = context | (np.uint64(1 << bit) | byte >> np.uint64(8 - bit))
        found, total = counted(key, counts)
        positive = counted(key, counts * (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(float))[1]
        keys.append(found)
        zeros.append(total - positive)
        ones.append(positive)
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate(zeros)[order].astype(float), np.concatenate(ones)[order].astype(float)


class ContextTree:
    """The decisions in contexts of `first` to `last` bytes, from those of `last` (see `decisions`).

    A trunk ends before the longest contexts; `below` is then, for each of its last decisions, the
    logarithm of the product of P_w over the contexts one byte longer. Branches start behind the
    trunk: their `log_weighted` goes up to it, and `mix` takes what it hands down.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, first: int = 0, last: int = DEPTH, below: np.ndarray | None = None):
        self.first, self.last = first, last
        self.levels, split = [], below
        for d in range(last, first - 1, -1):
            kt = log_kt(zeros, ones)
            if split is None:
                weighted, stop, go = kt, np.ones(len(keys)), np.zeros(len(keys))
            else:
                weighted = np.logaddexp(kt, split) - np.log(2)
                # From the difference, so that they add up to one however large the logarithms are.
                stop, go = (1 / (1 + np.exp(np.clip(x, -700, 700))) for x in (split - kt, kt - split))
            up = None
            chances = (zeros + 0.5) / (zeros + ones + 1), (ones + 0.5) / (zeros + ones + 1)
            if d > first:
                shorter, up = np.unique(keys & _mask(d), return_inverse=True)
            self.levels.append((keys, up, stop, go, chances))
            if d > first:
                size = len(shorter)
                keys, zeros, ones, split = shorter, *(np.bincount(up, x, size) for x in (zeros, ones, weighted))
        self.levels.reverse()
        self.counts, self.log_weighted = (zeros, ones), weighted  # of contexts of `first` bytes
        self.mixed: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def mix(self, trunk: ContextTree | None = None) -> ContextTree:
        """From the root down, for both outcomes apart, so that neither is a difference of large
        numbers: what contexts up to this one give to a zero and to a one, and the weight left for
        longer ones, of which an unseen one gives each outcome one half."""
        for keys, up, stop, go, chances in self.levels:
            if up is not None:
                zero, one, left = (x[up] for x in (zero, one, left))
            elif trunk is not None:
                held, *values = trunk.mixed[-1]
                at = find(held, keys & _mask(self.first))
                zero, one, left = (x[at] for x in values)
            else:
                zero, one, left = np.zeros(len(keys)), np.zeros(len(keys)), np.ones(len(keys))
            zero, one, left = zero + left * stop * chances[0], one + left * stop * chances[1], left * go
            self.mixed.append((keys, zero, one, left))
        self.levels = []  # not looked up again
        return self

    def log10(self, codes: np.ndarray, trunk: ContextTree | None = None) -> np.ndarray:
        """log10 of the probability of the low byte of each code after the context in the others."""
        known = [(d, held) for tree in (trunk, self) if tree for d, held in enumerate(tree.mixed, tree.first)]
        total, byte = np.zeros(len(codes)), codes & np.uint64(255)
        for bit in range(8):
            prefix = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
            one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            chance = np.full(len(codes), 0.5)  # a decision no context has seen
            todo = np.arange(len(codes))
            for d, (keys, zeros, ones, left) in reversed(known):
                at = find(keys, (codes[todo] >> np.uint64(8) & _mask(d)) << np.uint64(8) | prefix[todo])
                hit, at, todo = todo[at >= 0], at[at >= 0], todo[at < 0]
                chance[hit] = np.where(one[hit], ones[at], zeros[at]) + left[at] / 2
                if not len(todo):
                    break
            total += np.log10(chance)
        return total
