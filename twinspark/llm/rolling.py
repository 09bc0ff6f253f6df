"""Hashes of words, and names of byte strings at any place, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Keeps the first k of 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def lanes(data: bytes) -> np.ndarray:
    """The 8 bytes from every byte on as a number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(16), strides=(1,))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every word."""
    blank = np.concatenate(([True], _BLANK[np.frombuffer(data, np.uint8)], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def word_hashes(data: bytes, places: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash of every word; 8 bytes at a time are mixed into it."""
    start, size = places or word_places(data)
    long = np.flatnonzero(size > LONG)
    out, lane = mixed(size.astype(np.uint64)), lanes(data)
    at = np.flatnonzero(size <= LONG) if len(long) else np.arange(len(size))
    for k in range(0, LONG, 8):
        left = size[at] - k
        out[at] = mixed(out[at] ^ (lane[start[at] + k] & _FIRST[np.minimum(left, 8)]))
        at = at[left > 8]
        if not len(at):
            break
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]], int(size[i]))
    return out


class Lookup:
    """The places of hashes in an array without repeats, as an open hash table."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            self.keys[slot[free]] = keys[todo[free]]
            # Of several that asked for a slot one has it; equal keys can't be there.
            left = self.at[slot] != todo
            self.keys[slot[~left]] = keys[todo[~left]]
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out, todo, slot = np.full(len(hashes), -1, np.int32), None, (hashes & self.mask).astype(np.int64)
        while todo is None or len(todo):
            own = hashes if todo is None else hashes[todo]
            at = self.at[slot]
            hit = (self.keys[slot] == own) & (at >= 0)
            out[np.flatnonzero(hit) if todo is None else todo[hit]] = at[hit]
            on = np.flatnonzero(~hit & (at >= 0))
            todo, slot = on if todo is None else todo[on], (slot[on] + 1) & (len(self.at) - 1)
        return out


def rank_at(lane: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The names of the ``length`` bytes (a power of two) from each place on: up to 8 bytes these themselves, else of the pair of halves."""
    if length <= 8:
        return lane[at] & _FIRST[length]
    return mixed(mixed(rank_at(lane, at, length // 2) + np.uint64(length)) ^ rank_at(lane, at + length // 2, length // 2))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
