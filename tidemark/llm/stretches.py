"""Encoding texts by stretches between white space, with a bounded memory of stretches already met."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Unicode's white space (fixed values).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CHARS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
#: White space with what follows it up to the next white space.
STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
# where a token surely ends: before white space, and between ASCII letters and digits
_EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def portions(text: str, size: int = 1 << 17) -> Iterator[str]:
    """``text`` in parts of about ``size`` code points that end where a token surely ends."""
    at = 0
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]

_ASCII_WHITE = np.isin(np.arange(256), [*range(9, 14), 32])
_WIDE_WHITE = np.array([int.from_bytes(c.encode(), "big") for c in WHITE_CHARS if ord(c) > 127])


def stretch_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where stretches begin in the UTF-8 ``data`` of rows that begin at ``rows``: with each row, and at ASCII white
    space after what is none. Other white space stays within a stretch."""
    white = _ASCII_WHITE[data]
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    wide = at[data[at - 1] > 127]
    before = [data[wide - k].astype(np.int64) for k in (1, 2, 3)]  # for the first bytes, of the end: no cut is lost but safe ones
    two = before[0] + (before[1] << 8)
    cut = np.zeros(len(data), bool)
    cut[at] = True
    cut[wide[np.isin(two, _WIDE_WHITE) | np.isin(two + (before[2] << 16), _WIDE_WHITE)]] = False
    cut[rows[rows < len(data)]] = True
    return np.flatnonzero(cut)


class Memory(dict):
    """The bytes that ``compute`` gives for each stretch, a string or bytes. Long stretches are not kept. Once the kept
    ones have ``limit`` code points or bytes, or are so many that they fill as much memory, they become the old ones,
    and what was old is forgotten unless it was met since: a worker's memory does not follow its input, and frequent
    stretches stay."""

    LONG = 64
    #: What a stretch counts for at least: its place takes memory, however short it is.
    LEAST = 8
    #: Stretches that are computed together: their encodings are large.
    AT_ONCE = 1 << 12

    def __init__(self, compute: Callable[[list], list[bytes]], limit: int = 1 << 21):
        super().__init__()
        self.compute, self.limit, self.held, self.new, self.old = compute, limit, 0, [], {}

    def __missing__(self, stretch: str | bytes) -> bytes | bytearray:
        """An old stretch is taken over; a new one has an empty place, which is filled before it is read."""
        place = self.old.get(stretch)
        if place is None:
            self.new.append(stretch)
            place = bytearray()
        else:
            self.held += len(stretch)
        self[stretch] = place
        return place

    def each(self, rows: list[list]) -> list[list]:
        """The bytes of the stretches of each row; those not known are computed, many together."""
        if max(self.held, self.LEAST * len(self)) > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        values = [list(map(self.__getitem__, row)) for row in rows]
        new, self.new = self.new, []
        computed = (x for at in range(0, len(new), self.AT_ONCE) for x in self.compute(new[at : at + self.AT_ONCE]))
        for stretch, found in zip(new, computed):
            self[stretch].extend(found)  # where it was already taken
            self[stretch] = found
            if len(stretch) > self.LONG:
                del self[stretch]
            else:
                self.held += len(stretch)
        return values

    def recall(self, rows: list[list]) -> list[bytes]:
        """The bytes of the stretches of each row, in turn."""
        return [b"".join(row) for row in self.each(rows)]
