"""Words of many texts at once, as positions and 64-bit keys in one byte array (numpy, inside a task)."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial key and of its final mixing.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes whose keys are worked out together.
PIECE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: digits, letters and everything beyond ASCII (after lower-casing).
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: Bytes that are not ASCII white space (tab to carriage return, space).
VISIBLE = np.ones(256, bool)
VISIBLE[[*range(9, 14), 32]] = False

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys ^ (keys >> np.uint64(32))
    keys = keys * MIX
    return keys ^ (keys >> np.uint64(29))


class Packed:
    """Texts one after another in ``data``; text k lies at ``start[k]:end[k]``."""

    def __init__(self, texts: list, lower: bool = False):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.bytes = b"\n".join(parts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        if lower:
            self.data = LOWER[self.data]
            self.bytes = None

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of bytes marked in ``table``; no run crosses texts."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = table[self.data]
        inside[self.end[:-1] + 1] = False
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[0::2], edges[1::2]

    def keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit key of the bytes of each span (ascending, apart); 0 never occurs. Worked out piece by piece, so
        that what is held beside the texts does not grow with them."""
        keys = np.empty(len(start), np.uint64)
        low = 0
        while low < len(start):
            base = int(start[low])
            high = max(low + 1, int(np.searchsorted(end, base + PIECE, side="right")))
            stop = int(end[high - 1])
            if stop - base > PIECE:  # one span alone
                keys[low] = self._long(base, stop)
            else:
                up, down = powers(stop - base + 1)
                total = np.zeros(stop - base + 1, np.uint64)
                values = self.data[base:stop].astype(np.uint64)
                values += np.uint64(1)
                values *= up[: len(values)]
                np.cumsum(values, out=total[1:])
                first = start[low:high] - base
                keys[low:high] = (total[end[low:high] - base] - total[first]) * down[first]
            low = high
        keys = mixed(keys)
        keys[keys == 0] = 1
        return keys

    def _long(self, start: int, end: int) -> int:
        total = 0
        for at in range(start, end, PIECE):
            part = self.data[at : min(end, at + PIECE)].astype(np.uint64) + np.uint64(1)
            own = int((part * powers(len(part))[0][: len(part)]).sum(dtype=np.uint64))
            total = (total + own * pow(int(BASE), at - start, 1 << 64)) % (1 << 64)
        return total

    def counts(self, start: np.ndarray) -> np.ndarray:
        """How many spans begin in each text; spans are in ascending order."""
        return np.searchsorted(start, self.end + 1) - np.searchsorted(start, self.start)


class Table:
    """Open-addressed table from 64-bit keys (not 0) to slots 0, 1, 2, ... in the order of their arrival."""

    def __init__(self, room: int = 1 << 12):
        self.bits = max(12, int(room - 1).bit_length() + 1)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at = self._home(keys)
        there = self.key[at]
        out = np.where(there == keys, self.slot[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        mask, at = (1 << self.bits) - 1, at[left]
        while len(left):
            at = (at + 1) & mask
            there, want = self.key[at], keys[left]
            hit = there == want
            out[left[hit]] = self.slot[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], at[go]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Take in distinct keys that are not in the table yet."""
        if 2 * (self.size + len(keys)) > len(self.key):
            old = Table(2 * (self.size + len(keys)))
            used = np.flatnonzero(self.key)
            order = used[np.argsort(self.slot[used])]
            old._put(self.key[order], self.slot[order])
            self.bits, self.key, self.slot = old.bits, old.key, old.slot
        self._put(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = self._home(keys)
        while len(keys):
            free = self.key[at] == 0
            self.key[at[free]] = keys[free]
            won = free & (self.key[at] == keys)
            self.slot[at[won]] = slots[won]
            keys, slots, at = keys[~won], slots[~won], (at[~won] + 1) & mask
