"""Elias-Fano coding of ascending integers, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def low_bits(n: int, universe_bits: int) -> int:
    """Bits kept as they are: log2 of universe / n."""
    return min(64, max(0, universe_bits - (int(n).bit_length() - 1))) if n else 0


def encode(x: np.ndarray, universe_bits: int) -> bytes:
    """Ascending unsigned integers below 2**universe_bits: a head of two integers, the low bits of all,
    one after the other, and the high parts in unary."""
    n = len(x)
    low = low_bits(n, universe_bits)
    head = np.array([n, low], dtype=np.uint64).tobytes()
    if not n:
        return head
    high = (x.astype(U64) >> U64(low)).astype(np.int64) if low < 64 else np.zeros(n, dtype=np.int64)
    high += np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, dtype=np.uint8)
    unary[high] = 1
    return head + _narrow(x, low) + np.packbits(unary, bitorder="little").tobytes()


def _narrow(x: np.ndarray, low: int) -> bytes:
    """The ``low`` low bits of each, packed, and eight bytes behind them so that any of them can be read as two words."""
    out = []
    for a in range(0, len(x), 1 << 16):  # a multiple of 8: every part ends on a whole byte
        bits = np.unpackbits(np.ascontiguousarray(x[a : a + (1 << 16)].astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out) + bytes(9)


def _parts(buffer: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number, low bits, bytes of the low bits and high parts."""
    n, low = (int(v) for v in np.frombuffer(buffer[:16].tobytes(), dtype=np.uint64))
    size = -(-n * low // 8) + 9 if n else 0
    high = np.flatnonzero(np.unpackbits(np.asarray(buffer[16 + size :]), bitorder="little"))[:n] - np.arange(n)
    return n, low, buffer[16 : 16 + size], high


def _lows(packed: np.ndarray, i: np.ndarray, low: int) -> np.ndarray:
    """Low bits of entries ``i``: the nine bytes that hold them, shifted and cut."""
    if not low or not len(i):
        return np.zeros(len(i), dtype=U64)
    bit = i.astype(np.int64) * low
    at, shift = bit >> 3, (bit & 7).astype(U64)
    out = np.zeros(len(i), dtype=U64)
    for j in range(8):
        out |= packed[at + j].astype(U64) << U64(8 * j)
    out >>= shift
    # the ninth byte adds the bits that the shift took from the top
    last = packed[at + 8].astype(U64)
    out |= np.where(shift > 0, last << ((U64(64) - shift) & U64(63)), U64(0))
    return out & U64((1 << low) - 1) if low < 64 else out


def decode(blob) -> np.ndarray:
    n, low, packed, high = _parts(np.frombuffer(blob, dtype=np.uint8))
    if not n:
        return np.zeros(0, dtype=U64)
    return _lows(packed, np.arange(n), low) | (high.astype(U64) << U64(low) if low < 64 else U64(0))


class Sequence:
    """An encoded sequence in a byte buffer (a memory map as a rule), searched without decoding it
    whole: the high parts give the stretch of entries that share them, and low bits are read
    for the entries that a search meets."""

    def __init__(self, buffer: np.ndarray):
        self.n, self.low, self.packed, self.high = _parts(buffer)

    def get(self, i: np.ndarray) -> np.ndarray:
        out = _lows(self.packed, i, self.low)
        return out | (self.high[i].astype(U64) << U64(self.low)) if self.low < 64 else out

    def search(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Place of the first entry >= x within start..stop (the successor), by bisection."""
        lo = np.zeros(len(x), dtype=np.int64) if start is None else start.astype(np.int64).copy()
        hi = np.full(len(x), self.n, dtype=np.int64) if stop is None else stop.astype(np.int64).copy()
        if not self.n:
            return lo
        h = (x >> U64(self.low)).astype(np.int64) if self.low < 64 else np.zeros(len(x), dtype=np.int64)
        lo = np.maximum(lo, np.searchsorted(self.high, h, "left"))
        hi = np.maximum(lo, np.minimum(hi, np.searchsorted(self.high, h, "right")))
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.get(mid) < x[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
