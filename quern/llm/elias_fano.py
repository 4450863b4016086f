"""Elias-Fano sequences in numpy: monotone integers in about 2 + log2(universe / n) bits each, queried many at a time."""

from __future__ import annotations

from functools import cached_property

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)  # the place of the k-th set bit of a byte
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i


#: Elements whose bits are written at a time, a multiple of 8.
STEP = 1 << 18
#: Zeros are counted before each SKIP-th word of high bits only, a power of 2; these counts are all a view holds in memory.
SKIP = 32


def encode(x: np.ndarray) -> list[np.ndarray]:
    """Parts of the encoded sequence: sizes, low bits, high bits, ones before each 64 high bits."""
    x = x.astype(np.uint64, copy=False)
    n = len(x)
    top = int(x[-1]) if n else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    bits = np.zeros((n * low + 7) // 8 + 8, np.uint8)
    for a in range(0, n if low else 0, STEP):  # a slice begins with a byte
        v = x[a : a + STEP] & np.uint64((1 << low) - 1)
        at, own = np.arange(len(v), dtype=np.int64) * low, bits[a * low // 8 :]
        for k in range(low):  # bit by bit over all elements
            q = (at + k)[((v >> np.uint64(k)) & np.uint64(1)).astype(bool)]
            np.bitwise_or.at(own, q >> 3, (1 << (q & 7)).astype(np.uint8)) if low < 8 else _or_apart(own, q, low)
    length = (top >> low) + max(0, n - 1) + 2
    unary = np.zeros((length + 63) // 64 * 64, np.uint8)
    for a in range(0, n, STEP):
        v = (x[a : a + STEP] >> np.uint64(low)).astype(np.int64)
        unary[v + np.arange(a, a + len(v))] = 1
    packed = np.packbits(unary, bitorder="little")
    del unary
    ones = np.concatenate([[0], np.cumsum(_POP[packed].reshape(-1, 8).sum(1, dtype=np.int64))[:-1]]).astype(np.uint32)
    return [np.array([n, low], np.int64), bits, packed, ones]


def _or_apart(bits: np.ndarray, at: np.ndarray, low: int) -> None:
    """Sets bits at `at`, no two of which share a byte (elements are at least 8 bits apart)."""
    bits[at >> 3] |= (1 << (at & 7)).astype(np.uint8)


class EliasFano:
    """A view of encoded parts, which may be memory-mapped."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low = int(sizes[0]), int(sizes[1])
        self.bits, self.bytes, self.ones = bits, high.reshape(-1, 8), ones
        self.wide = np.ndarray((max(1, len(bits) - 7),), "<u8", np.ascontiguousarray(bits) if not bits.flags.c_contiguous else bits, strides=(1,))
        self.words = high.view("<u8")

    @cached_property
    def zeros(self) -> np.ndarray:
        return np.arange(0, len(self.ones), SKIP, dtype=np.int64) * 64 - self.ones[::SKIP]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        return (self.wide[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def _select(self, i: np.ndarray, flip: bool) -> np.ndarray:
        if flip:
            word, step = (np.searchsorted(self.zeros, i, "right") - 1) * SKIP, SKIP // 2
            while step:
                then = np.minimum(word + step, len(self.ones) - 1)
                word, step = np.where(then * 64 - self.ones[then] <= i, then, word), step // 2
            rest, x = i - (word * 64 - self.ones[word]), ~self.words[word]
        else:
            word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1  # of one type, so that the array isn't converted
            rest, x = i - self.ones[word], self.words[word]
        # ones up to each byte's end, all eight in one integer
        s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
        s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * np.uint64(0x0101010101010101)
        # bytes whose count is at most rest
        full = ((np.uint64(0x8080808080808080) | (rest.astype(np.uint64) * np.uint64(0x0101010101010101))) - s) & np.uint64(0x8080808080808080)
        byte = np.minimum(np.bitwise_count(full), 7).astype(np.uint64)
        rest = rest - (((s << np.uint64(8)) >> (byte * np.uint64(8))) & np.uint64(0xFF)).astype(np.int64)
        own = ((x >> (byte * np.uint64(8))) & np.uint64(0xFF)).astype(np.int64)
        return word * 64 + byte.astype(np.int64) * 8 + _SELECT[own, np.clip(rest, 0, 7)]

    def select1(self, i: np.ndarray) -> np.ndarray:
        return self._select(i, False)

    def select0(self, i: np.ndarray) -> np.ndarray:
        return self._select(i, True)

    def _next(self, at: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
        """Where the i-th one (or zero) is, which is the first from `at` on."""
        x = self.words[at >> 6]
        x = (~x if flip else x) >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(x == 0)  # in none of the word's bits that are left
        if len(far):
            out[far] = self._select(i[far], flip)
        return out

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements i and i + 1."""
        at = self.select1(i)
        then = self._next(at + 1, i + 1, False)
        low = np.uint64(self.low)
        return ((at - i).astype(np.uint64) << low) | self.lows(i), ((then - i - 1).astype(np.uint64) << low) | self.lows(i + 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.low)) | self.lows(i)

    def successor(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of elements first .. end - 1, where the first one of at least `value` is (or end)."""
        return np.minimum(self._search(value, first, end)[0], end)

    def find(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same places, and whether the element there is the value."""
        at, stop = self._search(value, first, end)
        hit = at < stop
        hit[hit] = self.lows(at[hit]) == (value[hit] & np.uint64((1 << self.low) - 1))
        return at, hit

    def _search(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and the ends of the runs of elements that share the value's high bits."""
        high = (value >> np.uint64(self.low)).astype(np.int64)
        last = self.bytes.size * 8 - self.n - 1  # zeros there are, less one
        some = np.minimum(high, last)
        at = np.where(some > 0, self.select0(np.maximum(some - 1, 0)) + 1, 0)  # behind the zero before
        lo = np.where(high > last, self.n, np.maximum(at - some, first))
        hi = np.minimum(self._next(at, some, True) - some, end)
        want = value & np.uint64((1 << self.low) - 1)
        hi = np.maximum(hi, lo)
        stop = hi.copy()
        while len(go := np.flatnonzero(lo < hi)):
            mid = (lo[go] + hi[go]) >> 1
            less = self.lows(mid) < want[go]
            lo[go], hi[go] = np.where(less, mid + 1, lo[go]), np.where(less, hi[go], mid)
        return lo, stop
