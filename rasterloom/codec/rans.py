"""Range-ANS coding with frequencies that add up to 4096."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np

from . import CodecError

BITS = 12
SCALE = 1 << BITS
LOW = 1 << 23  # a state is at least this between symbols


def normalize(counts: Sequence[int]) -> list[int]:
    return shares(counts).tolist()


def shares(counts: Sequence[int]) -> np.ndarray:
    """Frequencies that add up to SCALE, 1 at least for what occurs; all alike if nothing does."""
    c = np.asarray(counts, np.int64)
    n, total = len(c), int(c.sum())
    if not total:
        base, more = divmod(SCALE, n)
        return base + (np.arange(n) < more).astype(np.int64)
    used = np.flatnonzero(c)
    exact = c[used] * SCALE / total
    f = np.maximum(1, exact.astype(np.int64))
    for _ in range(int(f.sum()) - SCALE):  # one at a time, where there is most above the exact share
        f[np.argmin(np.where(f > 1, exact - f, np.inf))] -= 1
    if (short := SCALE - int(f.sum())) > 0:
        f[np.argsort(f - exact, kind="stable")[:short]] += 1
    out = np.zeros(n, np.int64)
    out[used] = f
    return out


class Table:
    def __init__(self, freqs: Sequence[int]):
        f = np.asarray(freqs, np.int64)
        if (total := int(f.sum())) != SCALE:
            raise CodecError("RansError", f"frequencies add up to {total}")
        self.array = f

    @cached_property
    def freq(self) -> list[int]:
        return self.array.tolist()

    @cached_property
    def cum(self) -> list[int]:
        return (np.cumsum(self.array) - self.array).tolist()

    @classmethod
    def of_counts(cls, counts: Sequence[int]) -> Table:
        return cls(shares(counts))

    @cached_property
    def slots(self) -> list[int]:
        return np.repeat(np.arange(len(self.array)), self.array).tolist()


def encode(symbols: Sequence[int], table: Table) -> bytes:
    """The state, low byte first, then the bytes in the order in which decode takes them."""
    x, out, freq, cum = LOW, bytearray(), table.freq, table.cum
    top = LOW >> BITS << 8
    for s in reversed(symbols):
        f = freq[s]
        if not f:
            raise CodecError("RansError", f"symbol {s} has no frequency")
        while x >= top * f:
            out.append(x & 255)
            x >>= 8
        x = (x // f << BITS) + x % f + cum[s]
    return x.to_bytes(4, "little") + bytes(reversed(out))


def decode(data: bytes, n: int, table: Table, strict: bool = False) -> list[int]:
    """n symbols. strict: the stream must end just where the first symbol was encoded."""
    if len(data) < 4:
        raise CodecError("RansError", "stream has no state")
    x, at, end = int.from_bytes(data[:4], "little"), 4, len(data)
    if not LOW <= x < 1 << 31:
        raise CodecError("RansError", "state out of range")
    slots, freq, cum, out = table.slots, table.freq, table.cum, []
    mask = SCALE - 1
    for _ in range(n):
        slot = x & mask
        s = slots[slot]
        out.append(s)
        x = freq[s] * (x >> BITS) + slot - cum[s]
        while x < LOW:
            if at >= end:
                raise CodecError("RansError", "stream is cut")
            x = x << 8 | data[at]
            at += 1
    if strict and (x != LOW or at != end):
        raise CodecError("RansError", "stream doesn't end as it began")
    return out


# --- tables of few symbols among many: only what occurs is held ---------------------------------------------------------

#: The symbols that occur, in order, and their frequencies.
Freqs = tuple[tuple[int, ...], tuple[int, ...]]
FEW, SHORT = 64, 16  # so many symbols, or so long a stream, that results are worth remembering


def sparse(freq: Sequence[int]) -> Freqs:
    f = np.asarray(freq, np.int64)
    used = np.flatnonzero(f)
    return tuple(used.tolist()), tuple(f[used].tolist())


def dense(f: Freqs, n: int) -> list[int]:
    out = [0] * n
    for s, x in zip(*f, strict=True):
        out[s] = x
    return out


def shares_of(counts: tuple[int, ...]) -> tuple[int, ...]:
    """shares() of symbols that all occur."""
    return _few_shares(counts) if len(counts) <= FEW else tuple(shares(counts).tolist())


@lru_cache(1 << 13)
def _few_shares(counts: tuple[int, ...]) -> tuple[int, ...]:
    total = sum(counts)
    exact = [c * SCALE / total for c in counts]
    f = [max(1, int(x)) for x in exact]
    for _ in range(sum(f) - SCALE):
        f[min((i for i in range(len(f)) if f[i] > 1), key=lambda i: exact[i] - f[i])] -= 1
    if (short := SCALE - sum(f)) > 0:
        for i in sorted(range(len(f)), key=lambda i: f[i] - exact[i])[:short]:
            f[i] += 1
    return tuple(f)


@lru_cache(1 << 10)
def _starts(f: Freqs) -> dict[int, tuple[int, int, int]]:
    """symbol -> frequency, sum of those before, and the state from which on bytes go out first."""
    top = LOW >> BITS << 8
    return {s: (x, c - x, top * x) for s, x, c in zip(*f, accumulate(f[1]), strict=True)}


def encode_few(symbols: Sequence[int], f: Freqs) -> bytes:
    """encode() by such a table."""
    return _encoded(tuple(symbols), f) if len(symbols) <= SHORT and len(f[0]) <= FEW else _encode(symbols, f)


def _encode(symbols: Sequence[int], table: Freqs) -> bytes:
    x, out, starts = LOW, bytearray(), _starts(table)
    try:
        if len(starts) == 1:  # its only symbol doesn't change the state
            if symbols.count(table[0][0]) != len(symbols):
                raise KeyError(next(s for s in symbols if s != table[0][0]))
            return x.to_bytes(4, "little")
        for s in reversed(symbols):
            f, before, most = starts[s]
            while x >= most:
                out.append(x & 255)
                x >>= 8
            n, rest = divmod(x, f)
            x = (n << BITS) + rest + before
    except KeyError as e:
        raise CodecError("RansError", f"symbol {e.args[0]} has no frequency") from e
    return x.to_bytes(4, "little") + bytes(reversed(out))


_encoded = lru_cache(1 << 13)(_encode)


def decode_few(data: bytes, n: int, f: Freqs) -> list[int]:
    """decode() by such a table."""
    return list(_decoded(data, n, f)) if n <= SHORT and len(f[0]) <= FEW and len(data) <= 4 * SHORT else _decode(data, n, f)


@lru_cache(16)
def _slots(f: Freqs) -> list[int]:
    return np.repeat(np.arange(len(f[1])), f[1]).tolist()


def _decode(data: bytes, n: int, table: Freqs) -> list[int]:
    if len(data) < 4:
        raise CodecError("RansError", "stream has no state")
    x, at, end = int.from_bytes(data[:4], "little"), 4, len(data)
    if not LOW <= x < 1 << 31:
        raise CodecError("RansError", "state out of range")
    symbols, freqs = table
    if len(symbols) == 1:
        return [symbols[0]] * n
    ends = list(accumulate(freqs))
    slots, out, mask = _slots(table) if n > 4 * FEW else None, [], SCALE - 1
    for _ in range(n):
        slot = x & mask
        i = slots[slot] if slots is not None else bisect_right(ends, slot)
        out.append(symbols[i])
        x = freqs[i] * (x >> BITS) + slot - ends[i] + freqs[i]
        while x < LOW:
            if at >= end:
                raise CodecError("RansError", "stream is cut")
            x = x << 8 | data[at]
            at += 1
    return out


_decoded = lru_cache(1 << 13)(_decode)
