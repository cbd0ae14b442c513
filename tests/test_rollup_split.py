"""Ranges cut into whole buckets of several widths."""

import random
from datetime import datetime, timedelta, timezone

from emberlog.operators.rollup import aligned, split_range


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def test_pieces_cover_the_range_once():
    rng = random.Random(2)
    for _ in range(500):
        since = utc(2026, 1, 1) + timedelta(microseconds=rng.randrange(10**11) * rng.choice([1, 10**3]))
        until = since + timedelta(microseconds=rng.choice([0, 1, 10**5, 10**6, 10**8, 10**10, 10**12]) * rng.randrange(3))
        widths = [1, 60, 3600][: rng.randrange(1, 4)]
        found = split_range(since, until, widths)
        assert len(found) == len(widths) + 1
        pieces = sorted(piece for ranges in found for piece in ranges)
        assert all(start < end for start, end in pieces)
        assert not pieces or (pieces[0][0], pieces[-1][1]) == (since, until)
        assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and (pieces or since >= until)
        for width, ranges in zip(widths, found[1:]):
            assert all(aligned(t, width) == t for piece in ranges for t in piece)


def test_the_ends_of_time():
    last = datetime.max.replace(tzinfo=timezone.utc)
    assert aligned(last, 3600, up=True) is None and aligned(last, 3600) == utc(9999, 12, 31, 23)
    assert split_range(last - timedelta(milliseconds=1), last, [1, 60]) == [[(last - timedelta(milliseconds=1), last)], [], []]
    assert aligned(utc(1, 1, 1), 86400) == utc(1, 1, 1) and aligned(utc(1969, 12, 31, 23, 59, 59), 60) == utc(1969, 12, 31, 23, 59)
