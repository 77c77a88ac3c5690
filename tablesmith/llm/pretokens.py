"""Splitting texts as the byte-level BPE pattern does, in numpy, and encoding each distinct piece once per task."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pandas as pd

# Unicode's White_Space code points, which the pattern's \s stands for.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
ODD = 0x9E3779B97F4A7C15


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    major = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    out[major == "L"], out[major == "N"] = LETTER, NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in ``points``; bounds: the len + 1 places where the texts begin."""
    kind = kinds()[points]
    first = bounds[:-1][np.diff(bounds) > 0]
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    before[first] = EDGE
    after[np.append(first[1:], len(points)) - 1] = EDGE
    begins = kind != before
    # Of white space before something else, the last one stands alone; a blank there joins what follows.
    last = (kind == SPACE) & (after != SPACE) & (after != EDGE)
    begins |= last
    begins[np.flatnonzero(last & (points == 0x20)) + 1] = False
    # 's 't 'm 'd 're 've 'll after anything but a blank
    quote = np.flatnonzero((points == 0x27) & begins & (after == LETTER))
    if len(quote):
        one, more = points[quote + 1], after[quote + 1] != EDGE
        two = np.where(more, points[np.minimum(quote + 2, len(points) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        quote, short = quote[short | long], short[short | long]
        begins[quote + 1] = False
        end = quote + np.where(short, 2, 3)
        begins[end[end < len(points)]] = True
    return np.flatnonzero(begins)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, mod 2**64, of an odd number and of its inverse."""
    up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[begin:end] for each range."""
    size = 1 << max(16, int(len(values)).bit_length())
    up, down = powers(size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ranges(blank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the runs that are not blank; starts: the len + 1 places where the texts begin."""
    if not len(blank):
        return (np.zeros(0, np.int64),) * 3
    new = np.zeros(len(blank) + 1, bool)
    new[starts] = True
    solid = ~blank
    begin = np.flatnonzero(solid & (new[:-1] | np.concatenate([[True], blank[:-1]])))
    end = np.flatnonzero(solid & (new[1:] | np.concatenate([blank[1:], [True]]))) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


class Encoder:
    """Encodes texts through ``encode``, which gets the distinct pieces not met before and returns their ids.

    What has been met is kept in flat arrays: sorted hashes, and for each the place and number of its ids. Beyond
    ``most`` pieces it starts afresh, so a task's memory stays bounded. ``added``: literals with an id of their own, the
    longest first where several begin; texts are cut at them before the pattern.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 600_000, added: dict[str, int] | None = None):
        self.encode, self.most, self.added = encode, most, added or {}
        self.literal = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.place, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = self.encode(pieces)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = self.used + np.cumsum(count) - count
        self.used += len(flat)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.place, self.count = (np.insert(a, at, b[order]) for a, b in ((self.hashes, hashes), (self.place, place), (self.count, count)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the len + 1 places where they begin."""
        if self.literal is None or not any(map(self.literal.search, texts)):
            return self._between(texts)
        parts = [self.literal.split(t) for t in texts]
        ids, at = self._between([s for p in parts for s in p[::2]])
        literals = np.fromiter((len(p) // 2 for p in parts), np.int64, len(parts))
        ends = np.cumsum(literals + 1)
        followed = np.ones(len(at) - 1, bool)
        followed[ends - 1] = False
        ids = np.insert(ids, at[1:][followed], [self.added[s] for p in parts for s in p[1::2]])
        return ids, at[np.append(0, ends)] + np.append(0, np.cumsum(literals))

    def _between(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts in which no added literal counts."""
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=bounds[1:])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = piece_starts(points, bounds)
        end = np.append(begin[1:], len(points))
        code, distinct = pd.factorize(range_hashes(points, begin, end))
        if len(self.hashes) > self.most:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            example = np.zeros(len(distinct), np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]
            example = example[new]
            self._learn(distinct[new], [joined[b:e] for b, e in zip(begin[example].tolist(), end[example].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        count, place = self.count[at][code], self.place[at][code]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(place - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, bounds)]
