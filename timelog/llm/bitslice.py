"""Bit-sliced Hamming distances.

Values stand in lanes of 64: bit plane k of a lane word holds bit k of 64
values. The distances of a query to all 64 are counted at once by carry-save
counters, and a lane word is abandoned once every lane is past the radius.
"""

from __future__ import annotations

import numpy as np

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(values: np.ndarray) -> np.ndarray:
    """[64 * lane words] or [64 * lane words, w] values of w words -> [lane words, 64 * w] planes: bit i of plane k is bit k of lane i."""
    wide = values.reshape(len(values), -1)
    wide = np.ascontiguousarray(wide).view(np.uint8).reshape(-1, 64, 8 * wide.shape[1])
    planes = np.zeros((len(wide), 8 * wide.shape[2]), np.uint64)
    # In pieces: a bit takes a byte meanwhile.
    each = max(1, (1 << 23) // (512 * wide.shape[2]))
    for at in range(0, len(wide), each):
        bits = np.unpackbits(wide[at : at + each], axis=2, bitorder="little")
        packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
        planes[at : at + each] = np.ascontiguousarray(packed).view(np.uint64).reshape(len(bits), -1)
    return planes


def near_lanes(queries: np.ndarray, planes: np.ndarray, words: np.ndarray, valid: np.ndarray, radius: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries[i] to the 64 lanes of planes[words[i]]: (i, lane) within radius (one for all, or one for each i)."""
    wide = queries.reshape(len(queries), -1)
    radius = np.broadcast_to(np.asarray(radius, np.int64), len(wide))
    alive = np.flatnonzero(radius >= 0)
    if not len(alive):
        return alive, alive
    over = ~valid[alive]
    # Counters of just enough bits for the largest radius, each started so that it overflows one past its own.
    bits = max(1, int(radius.max()).bit_length())
    start = (1 << bits) - 1 - radius[alive]
    counter = [np.where(start >> k & 1 == 1, _ALL, np.uint64(0)) for k in range(bits)]
    for k in range(planes.shape[1]):
        carry = planes[words[alive], k] ^ (_ALL * (wide[alive, k >> 6] >> np.uint64(k & 63) & _ONE))
        for c in counter:
            c ^= carry
            carry &= ~c
        over |= carry
        if k % 4 == 3:
            stay = over != _ALL
            if not stay.all():
                alive, over, counter = alive[stay], over[stay], [c[stay] for c in counter]
            if not len(alive):
                break
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return alive[row], lane


class Lanes:
    """Groups of values laid out in lanes, each group in lane words of its own; `group` is sorted."""

    def __init__(self, group: np.ndarray, values: np.ndarray):
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(self.first, len(group)))
        self.group = np.repeat(np.arange(len(self.first)), size)
        self.word_of_group = np.concatenate([[0], np.cumsum(-(-size // 64))])
        within = np.arange(len(group)) - self.first[self.group]
        slot = self.word_of_group[self.group] * 64 + within
        held = np.zeros((self.word_of_group[-1] * 64, *values.shape[1:]), np.uint64)
        held[slot] = values
        self.index = np.full(len(held), -1, np.int64)
        self.index[slot] = np.arange(len(group))
        self.planes = planes_of(held)
        self.valid = np.packbits(self.index.reshape(-1, 64) >= 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)
        #: The word that a value stands in, and the first word after its group.
        self.word, self.end = self.word_of_group[self.group] + within // 64, self.word_of_group[self.group + 1]

    def stretches(self, last: np.ndarray, most: int):
        """(value, word) for the words from each value's own up to `last`, at most about `most` at a time."""
        count = np.maximum(last - self.word, 0)
        ends, at = np.cumsum(count), 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            q = np.repeat(np.arange(at, to), count[at:to])
            offset = np.arange(len(q)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to])
            yield q, np.repeat(self.word[at:to], count[at:to]) + offset
            at = to
