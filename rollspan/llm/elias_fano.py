"""Elias-Fano coded monotone sequences over numpy arrays, read in whole batches.

The upper parts of the values are unary coded in a bit vector, the lower parts packed.
Two directories of running counts (one per 64-bit word) make `select` a binary search.
All readers take and give arrays, and work on memory-mapped words.
"""

import numpy as np

U1 = np.uint64(1)
U63 = np.uint64(63)


def _pack(bits):
    """Bits (one a byte) as little-endian 64-bit words."""
    data = np.packbits(bits, bitorder="little")
    return np.concatenate([data, np.zeros(-len(data) % 8 + 8, np.uint8)]).view(np.uint64)


def encode(values):
    """(header, words): header = count, low width, high words, low words."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    bits = np.zeros(n + (top >> width) + 2, np.uint8)
    bits[high + np.arange(n)] = 1
    words = _pack(bits)
    low = np.zeros(1, np.uint64)
    if width and n:
        part = values & np.uint64((1 << width) - 1)
        shifts = np.arange(width, dtype=np.uint64)
        low = np.concatenate(
            [((part[i : i + 65_536, None] >> shifts) & U1).astype(np.uint8).ravel() for i in range(0, n, 65_536)]
        )
        low = _pack(low)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
    directory = ones.astype(np.uint32)
    pad = np.concatenate([directory, np.zeros(len(directory) % 2, np.uint32)]).view(np.uint64)
    header = np.array([n, width, len(words), len(low)], np.uint64)
    return np.concatenate([header, words, low, pad])


def _select_in_word(words, rank):
    """Position of the rank-th (from 0) one in each word."""
    at, rest = np.zeros(len(words), np.uint64), rank.astype(np.uint8)
    for bit in (5, 4, 3, 2, 1, 0):
        ones = np.bitwise_count((words >> at) & np.uint64((1 << (1 << bit)) - 1))
        up = rest >= ones
        rest -= ones * up
        at |= up.astype(np.uint64) << np.uint64(bit)
    return at.astype(np.int64)


class Sequence:
    """Reader of an encoded sequence."""

    def __init__(self, words):
        n, width, high, low = (int(x) for x in words[:4])
        self.n, self.width = n, width
        self.high = words[4 : 4 + high]
        self.low = words[4 + high : 4 + high + low]
        self.ones = words[4 + high + low :].view(np.uint32)[:high]
        self._zeros = None

    @property
    def zeros(self):
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        return self._zeros

    def lows(self, i):
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & U63
        left = self.low[word] >> off
        right = (self.low[word + 1] << U1) << (U63 - off)
        return (left | right) & np.uint64((1 << self.width) - 1)

    def access(self, i):
        """The values at positions i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def below(self, h):
        """How many values have an upper part smaller than h."""
        word = np.searchsorted(self.zeros, h - 1, "right") - 1
        word = np.maximum(word, 0)
        inside = _select_in_word(~self.high[word], np.maximum(h - 1 - self.zeros[word], 0))
        return np.where(h <= 0, 0, np.minimum(word * 64 + inside - (h - 1), self.n))

    def successor(self, target, begin, end):
        """First position in [begin, end) whose value is target or more (else end)."""
        h = (target >> np.uint64(self.width)).astype(np.int64)
        last = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1:])[0])
        far = h >= last
        h = np.where(far, 0, h)
        lo = np.maximum(np.where(far, end, self.below(h)), begin)
        hi = np.minimum(np.where(far, end, self.below(h + 1)), end)
        lo = np.minimum(lo, end)
        hi = np.maximum(hi, lo)
        part = target & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            small = self.lows(mid) < part[open_]
            lo[open_] = np.where(small, mid + 1, lo[open_])
            hi[open_] = np.where(small, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo
