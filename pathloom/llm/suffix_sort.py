"""Suffixes in order by hash-compared mergesort, on numpy arrays.

The text's bytes have prefix polynomial hashes modulo 2^64, so the hash of any stretch takes two lookups. The common
extension of two suffixes is found by binary search over its length, comparing hashes; that makes one comparison of two
suffixes logarithmic in their length. A bottom-up mergesort uses it: every suffix of a run looks its place up in the
neighbouring run by binary search, all suffixes of all segments at once. What the hashes decided is then verified
byte by byte between neighbours in the order; a segment with a collision is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: A fixed odd 64-bit value for each byte.
_VALUES = np.array([(0xD6E8FEB86659FD93 * (b + 1) ** 3 + 0x2545F4914F6CDD1D * b) % 2**64 | 1 for b in range(256)], np.uint64)
_COMPARED = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            both = []
            for factor in (_BASE, pow(_BASE, -1, 2**64)):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                both.append(np.cumprod(powers))
            cls.up, cls.down = both
        return cls.up[:n], cls.down[:n]


class HashedText:
    """Bytes with the hashes of all their prefixes."""

    def __init__(self, data: bytes) -> None:
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        up, self.down = _Powers.upto(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.bytes] * up[:n], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of stretches, alike wherever they stand."""
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        """The hash of every stretch of a size."""
        return (self.prefix[size:] - self.prefix[:-size]) * self.down[: len(self.prefix) - size]

    def extensions(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """How far the stretches from a and from b agree, up to a limit, by their hashes."""
        out = np.full(len(a), limit, np.int64)
        todo = np.flatnonzero(self.hashes(a, limit) != self.hashes(b, limit))
        a, b = a[todo], b[todo]
        pa, pb, da, db = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit - 1, np.int64)
        for _ in range((limit - 1).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa) * da == (self.prefix[b + mid] - pb) * db
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[todo] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, limit: int, ties: np.ndarray) -> np.ndarray:
        """Whether the stretch from a is less than the one from b, or alike where ties says so."""
        reach = self.extensions(a, b, limit)
        alike = reach == limit
        inside = np.where(alike, 0, reach)
        return np.where(alike, ties, self.bytes[a + inside] < self.bytes[b + inside])


def _sorted(text: HashedText, starts: np.ndarray, first: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """Places in `starts` in the order of their stretches within each segment (first and size hold for each element)."""
    order = np.arange(len(starts))
    rank = order - first
    width = 1
    while True:
        live = np.flatnonzero(size > width)
        if not len(live):
            return order
        base, n, r = first[live], size[live], rank[live]
        run = r // width
        right = (run & 1).astype(bool)
        other = np.where(right, run - 1, run + 1) * width
        low, high = np.minimum(other, n), np.minimum(other + width, n)
        begin = low.copy()
        own = starts[order[live]]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            there = starts[order[base[open_] + mid]]
            # equal stretches keep their order: those of the left run come first
            lower = text.before(there, own[open_], limit, right[open_])
            low[open_] = np.where(lower, mid + 1, low[open_])
            high[open_] = np.where(lower, high[open_], mid)
        new = base + (run - right) * width + (r - run * width) + (low - begin)
        moved = order[live]
        order[new] = moved
        width *= 2


def suffix_classes(text: HashedText, starts: np.ndarray, segment: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): places in `starts` sorted by segment and by the `limit` bytes from each start, and a number for
    each place of that order that is the same for equal bytes of one segment."""
    by_segment = np.argsort(segment, kind="stable")
    starts, segment = starts[by_segment], segment[by_segment]
    new = np.ones(len(starts), bool)
    new[1:] = segment[1:] != segment[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(starts)))
    first, many = np.repeat(head, size), np.repeat(size, size)
    order = _sorted(text, starts, first, many, limit)
    equal = np.zeros(len(starts), bool)
    wrong: set[int] = set()
    inner = np.flatnonzero(~new)
    for part in range(0, len(inner), _COMPARED):
        at = inner[part : part + _COMPARED]
        a, b = starts[order[at - 1]], starts[order[at]]
        equal[at] = text.extensions(a, b, limit) == limit
        differ = text.bytes[a[:, None] + np.arange(limit)] != text.bytes[b[:, None] + np.arange(limit)]
        where = differ.argmax(axis=1)
        truly = ~differ[np.arange(len(at)), where]
        rising = truly | (text.bytes[a + where] < text.bytes[b + where])
        wrong.update(first[at[(truly != equal[at]) | ~rising]].tolist())
    for begin in wrong:  # hashes collided: sorted by the bytes themselves
        end = begin + int(many[begin])
        held = {int(i): text.bytes[starts[i] : starts[i] + limit].tobytes() for i in order[begin:end]}
        order[begin:end] = sorted(held, key=held.__getitem__)
        equal[begin:end] = [False] + [held[int(x)] == held[int(y)] for x, y in zip(order[begin : end - 1], order[begin + 1 : end], strict=True)]
    return by_segment[order], np.cumsum(~equal)
