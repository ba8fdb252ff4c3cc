"""Byte streams of a lossy tile: modes, spans, presence, signs, frequency tables, coefficients."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from math import inf
from operator import itemgetter

import numpy as np

from . import CodecError, Reader
from .rans import FEW, SCALE, SHORT, Freqs, decode_few, dense, encode_few, shares, shares_of, sparse

# Numbers of the table encodings and of the bank's modes, by name.
SINGLE, DENSE16, SPARSE16, DENSE8, SPARSE8, REUSE, DELTA8 = range(7)
INLINE, ONE, NIBBLE, BYTE, BIT, TWO_BIT = range(6)
WIDTH = {BIT: (1, 2), TWO_BIT: (2, 4), NIBBLE: (4, 16)}  # bits, and the most tables
RAW, POSITIVE, NEGATIVE = range(3)  # sign modes
NONE, ALL, SOME = range(3)  # presence
OFFSET, SIGNED, MAGNITUDES = 1024, 2049, 1025


@dataclass(frozen=True)
class Syntax:
    """How coefficients are written."""

    extents: bool = False
    adaptive_tables: bool = True
    split_signs: bool = False
    bank: bool = False
    elide: bool = False
    significance: bool = False
    sign_modes: bool = False
    cluster: bool = True  # the writer's choice alone: ranks of a bank may share a table that is near to their own

    @property
    def symbols(self) -> int:
        return MAGNITUDES if self.split_signs else SIGNED

    @property
    def zero(self) -> Freqs:
        """The table of a rank without values."""
        return (0 if self.split_signs else OFFSET,), (SCALE,)

    def coded(self, q: Sequence[int]) -> list[int]:
        """Values -> symbols."""
        if self.split_signs:
            return [min(abs(v), OFFSET) for v in q]
        return [min(max(v + OFFSET, 0), 2 * OFFSET) for v in q]


# --- bits -------------------------------------------------------------------------------------------------------------


def pack_bits(values, width: int) -> bytes:
    """The first value in the lowest bits."""
    v = np.asarray(values, np.uint8)
    bits = (v[:, None] >> np.arange(width, dtype=np.uint8)) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    if len(bits) < n * width or len(data) != -(-n * width // 8):
        raise CodecError("DecodeFailed", f"{len(data)} bytes for {n} values of {width} bits")
    if bits[n * width :].any():
        raise CodecError("DecodeFailed", "padding isn't zero")
    return (bits[: n * width].reshape(n, width) << np.arange(width, dtype=np.uint8)).sum(axis=1).astype(np.int64)


def write_modes(modes: list[int]) -> bytes:
    data = pack_bits(modes, 4)
    return struct.pack("<H", len(data)) + data


def read_modes(r: Reader, n: int) -> list[int]:
    if r.number(2) != (n + 1) // 2:
        raise CodecError("PredictionError", "mode stream has a wrong length")
    try:
        modes = unpack_bits(r.take((n + 1) // 2), n, 4)
    except CodecError as e:
        raise CodecError("PredictionError" if e.code == "DecodeFailed" else e.code, str(e)) from e
    if (modes > 12).any():
        raise CodecError("PredictionError", "mode out of range")
    return modes.tolist()


def write_spans(spans: np.ndarray, adaptive: bool) -> bytes:
    raw = pack_bits(spans, 7)
    if not adaptive:
        return struct.pack("<H", len(raw)) + raw
    if len(spans) and (spans == spans[0]).all():
        return struct.pack("<H", 0x4000 | int(spans[0]))
    starts = np.flatnonzero(np.diff(spans, prepend=-1))
    lengths = np.diff([*starts, len(spans)])
    runs = b"".join(struct.pack("<HB", min(n - k, 65535), int(spans[at])) for at, n in zip(starts, lengths, strict=True) for k in range(0, n, 65535))
    if len(runs) < len(raw):
        return struct.pack("<H", 0x8000 | len(runs)) + runs
    return struct.pack("<H", len(raw)) + raw


def read_spans(r: Reader, n: int, adaptive: bool) -> np.ndarray:
    head = r.number(2)
    how, size = (head & 0xC000, head & 0x3FFF) if adaptive else (0, head)
    if how == 0x4000:
        spans = np.full(n, size)
    elif how == 0x8000:
        if not size or size % 3:
            raise CodecError("DecodeFailed", "runs have a wrong length")
        pairs = list(struct.iter_unpack("<HB", r.take(size)))
        if any(not k for k, _ in pairs) or sum(k for k, _ in pairs) != n:
            raise CodecError("DecodeFailed", "runs don't add up")
        spans = np.repeat([v for _, v in pairs], [k for k, _ in pairs])
    elif how == 0 and size == -(-7 * n // 8):
        spans = unpack_bits(r.take(size), n, 7)
    else:
        raise CodecError("DecodeFailed", "span stream has a wrong head")
    if (spans > 64).any():
        raise CodecError("DecodeFailed", "span out of range")
    return spans


def _flags(values: Sequence[bool]) -> bytes:
    """pack_bits of width 1, of a few values or of many."""
    n = len(values)
    if n > FEW:
        return pack_bits(values, 1)
    return sum(1 << i for i, v in enumerate(values) if v).to_bytes(-(-n // 8), "little")


def _unflags(data: bytes, n: int) -> list[int]:
    if n > FEW:
        return unpack_bits(data, n, 1).tolist()
    bits = int.from_bytes(data, "little")
    if bits >> n:
        raise CodecError("DecodeFailed", "padding isn't zero")
    return [bits >> i & 1 for i in range(n)]


def write_presence(p: Sequence[bool]) -> bytes:
    return bytes([NONE]) if not any(p) else bytes([ALL]) if all(p) else bytes([SOME]) + _flags(p)


def read_presence(r: Reader, n: int) -> list[int]:
    how = r.number(1)
    if how > SOME:
        raise CodecError("DecodeFailed", "presence encoding")
    return [int(how == ALL)] * n if how != SOME else _unflags(r.take(-(-n // 8)), n)


# --- tables -----------------------------------------------------------------------------------------------------------
# A rank of a small tile has few of the 2,049 symbols, so tables hold what occurs alone, and are sized before they are
# written: of the ways to write one, only that which is taken makes bytes.


Frequencies = Sequence[int] | np.ndarray


def write_table(freq: Frequencies, before: Frequencies | None = None) -> bytes:
    return _write(sparse(freq), None if before is None else sparse(before))


def read_table(r: Reader, n: int, before: list[int] | None = None) -> list[int]:
    return dense(_read(r, n, None if before is None else sparse(before)), n)


def write_bank(tables: list[Frequencies]) -> bytes:
    return _write_bank([sparse(t) for t in tables])


def read_bank(r: Reader, count: int, n: int) -> list[list[int]]:
    return [dense(t, n) for t in _read_bank(r, count, n)]


def _changes(f: Freqs, before: Freqs) -> list[tuple[int, int]]:
    """(symbol, difference) where there is one, in order."""
    d = dict(zip(*f, strict=True))
    for s, x in zip(*before, strict=True):
        d[s] = d.get(s, 0) - x
    return sorted((s, x) for s, x in d.items() if x)


def _way(f: Freqs, before: Freqs | None) -> tuple[int, int]:
    """Bytes of a table, and the way to write it."""
    if f == before:
        return 1, REUSE
    used, freqs = f
    if len(used) == 1:
        return 3, SINGLE
    n, wide = len(used), used[-1] - used[0] + 1
    ways = [(5 + 2 * wide, DENSE16), (3 + 4 * n, SPARSE16)]
    if max(freqs) <= 255:
        ways += [(5 + wide, DENSE8), (3 + 3 * n, SPARSE8)]
    if before is not None:
        d = _changes(f, before)
        if all(-128 <= x <= 127 for _, x in d):
            ways.append((3 + 3 * len(d), DELTA8))
    return min(ways, key=itemgetter(0))


_few_ways = lru_cache(1 << 13)(_way)


def _sized(f: Freqs, before: Freqs | None = None) -> int:
    return (_few_ways if len(f[0]) + (len(before[0]) if before else 0) <= FEW else _way)(f, before)[0]


def _write(f: Freqs, before: Freqs | None = None) -> bytes:
    _, how = _way(f, before)
    if how == REUSE:
        return bytes([REUSE])
    used, freqs = f
    if how == SINGLE:
        return struct.pack("<BH", SINGLE, used[0])
    if how in (DENSE16, DENSE8):
        all_ = np.zeros(used[-1] - used[0] + 1, "<u2" if how == DENSE16 else "u1")
        all_[np.array(used) - used[0]] = freqs
        return struct.pack("<BHH", how, used[0], used[-1]) + all_.tobytes()
    pairs = _changes(f, before) if how == DELTA8 else list(zip(used, freqs, strict=True))
    one = struct.Struct({SPARSE16: "<HH", SPARSE8: "<HB", DELTA8: "<Hb"}[how])
    return struct.pack("<BH", how, len(pairs)) + b"".join(one.pack(*p) for p in pairs)


def _read(r: Reader, n: int, before: Freqs | None = None) -> Freqs:
    how = r.number(1)
    if how in (REUSE, DELTA8) and before is None:
        raise CodecError("RansError", "table refers to none before it")
    if how == REUSE:
        return before

    def checked(s: int) -> int:
        if s >= n:
            raise CodecError("RansError", "symbol out of range")
        return s

    if how == SINGLE:
        return (checked(r.number(2)),), (SCALE,)
    if how in (DENSE16, DENSE8):
        a, b = r.number(2), checked(r.number(2))
        if a > b:
            raise CodecError("RansError", "table range")
        found = np.frombuffer(r.take((b - a + 1) * (2 if how == DENSE16 else 1)), "<u2" if how == DENSE16 else "u1").tolist()
        f = {s: x for s, x in enumerate(found, a) if x}
    elif how in (SPARSE16, SPARSE8, DELTA8):
        kind = {SPARSE16: "<HH", SPARSE8: "<HB", DELTA8: "<Hb"}[how]
        pairs = list(struct.iter_unpack(kind, r.take(r.number(2) * (4 if how == SPARSE16 else 3))))
        f = dict(pairs)
        if not pairs or max(f) >= n or len(f) < len(pairs) or (how != DELTA8 and not all(f.values())):
            raise CodecError("RansError", "table pairs")
        if how == DELTA8:
            for s, x in zip(*before, strict=True):
                f[s] = f.get(s, 0) + x
    else:
        raise CodecError("RansError", f"table encoding {how}")
    if sum(f.values()) != SCALE or min(f.values()) < 0:
        raise CodecError("RansError", "frequencies don't add up")
    used = sorted(s for s, x in f.items() if x)
    return tuple(used), tuple(f[s] for s in used)


def _index_size(distinct: int, count: int) -> float:
    """Least bytes of a bank beside its tables: their number, and which each rank has."""
    bits = min((bits for bits, most in WIDTH.values() if distinct <= most), default=8 if distinct < 256 else inf)
    return inf if bits == inf else 1 + -(-count * bits // 8)


def _bank_way(inline: int, distinct: int, alone: int, first: int, count: int) -> tuple[int, int]:
    """Bytes of a bank, and the way to write it. inline: bytes of all tables, each told by the one before; alone: of the
    distinct ones by themselves; first: of the first one."""
    ways = [(inline, INLINE)]
    if distinct == 1:
        ways.append((first, ONE))
    ways += [(1 + alone + -(-count * bits // 8), how) for how, (bits, most) in WIDTH.items() if distinct <= most]
    if distinct < 256:
        ways.append((1 + alone + count, BYTE))
    size, how = min(ways, key=itemgetter(0))
    return 1 + size, how


def _bank_sized(tables: list[Freqs]) -> tuple[int, int]:
    if not tables:
        return 0, INLINE
    inline = sum(_sized(t, tables[i - 1] if i else None) for i, t in enumerate(tables))
    distinct = dict.fromkeys(tables)
    return _bank_way(inline, len(distinct), sum(map(_sized, distinct)), _sized(tables[0]), len(tables))


def _write_bank(tables: list[Freqs]) -> bytes:
    if not tables:
        return b""
    _, how = _bank_sized(tables)
    if how == INLINE:
        data = b"".join(_write(t, tables[i - 1] if i else None) for i, t in enumerate(tables))
    else:
        known: dict[Freqs, int] = {}
        index = [known.setdefault(t, len(known)) for t in tables]
        data = b"".join(map(_write, known))
        if how != ONE:
            data = bytes([len(known)]) + data + (bytes(index) if how == BYTE else pack_bits(index, WIDTH[how][0]))
    return bytes([how]) + data


def _read_bank(r: Reader, count: int, n: int) -> list[Freqs]:
    if not count:
        return []
    how = r.number(1)
    if how == INLINE:
        out: list[Freqs] = []
        for _ in range(count):
            out.append(_read(r, n, out[-1] if out else None))
        return out
    if how == ONE:
        return [_read(r, n)] * count
    if how != BYTE and how not in WIDTH:
        raise CodecError("RansError", f"bank mode {how}")
    size = r.number(1)
    if how in WIDTH and size > WIDTH[how][1]:
        raise CodecError("RansError", "bank has too many tables")
    bank = [_read(r, n) for _ in range(size)]
    bits = WIDTH[how][0] if how in WIDTH else 8
    index = unpack_bits(r.take(-(-count * bits // 8)), count, bits)
    if (index >= size).any():
        raise CodecError("RansError", "index behind the bank")
    return [bank[i] for i in index.tolist()]


NEAREST, PASSES = 8, 2


#: The symbols of a rank, in order, and how often each comes.
Counts = tuple[tuple[int, ...], tuple[int, ...]]


class Sharing:
    """Which of a bank's tables each rank uses. A rank may take one of the tables nearest to its own that has a frequency
    for all of its symbols, where the bank shrinks by more than its symbols grow. Symbols are priced by the bits they
    take under a table, so no trial encodes anything, and a change moves the bank's size by its neighbours' alone."""

    def __init__(self, tables: list[Freqs], counts: list[Counts]):
        self.counts = counts
        self.chosen: dict[bool, list[Freqs]] = {}
        self.known: dict[Counts, dict[int, float]] = {c: {} for c in counts}  # prices that were asked for
        known: dict[Freqs, int] = {}
        self.at = [known.setdefault(t, len(known)) for t in tables]
        self.bank = list(known)
        self.held = [frozenset(t[0]) for t in self.bank]
        self.alone = [_sized(t) for t in self.bank]
        self.after: dict[tuple[int, int], int] = {}

    @cached_property
    def nearest(self) -> list[list[int]]:
        """For each table all of them by how far they are from it."""
        symbols = sorted(set().union(*self.held))
        flat = np.zeros((len(self.bank), len(symbols)), np.int64)
        for row, (used, freqs) in zip(flat, self.bank, strict=True):
            row[np.searchsorted(symbols, used)] = freqs
        return [np.argsort(np.abs(flat - row).sum(axis=1), kind="stable").tolist() for row in flat]

    def price(self, counts: Counts, table: int) -> float:
        """Bytes of a rank's symbols; infinite if one has no frequency."""
        known = self.known[counts]
        if table not in known:
            if not counts[0]:
                known[table] = 0.0
            elif not self.held[table].issuperset(counts[0]):
                known[table] = inf
            else:
                known[table] = _price(counts, self.bank[table])
        return known[table]

    def step(self, table: int, before: int) -> int:
        """Bytes of a table that is told by the one before it."""
        if (size := self.after.get((table, before))) is None:
            size = self.after[table, before] = _sized(self.bank[table], self.bank[before])
        return size

    def choose(self, elide: bool) -> list[Freqs]:
        """elide: the symbols of a table with one take no bytes."""
        if elide not in self.chosen:
            self.chosen[elide] = self._choose([len(h) == 1 and elide for h in self.held])
        return self.chosen[elide]

    def _choose(self, free: list[bool]) -> list[Freqs]:
        at, bank, count, step, alone = list(self.at), self.bank, len(self.at), self.step, self.alone
        priced = lambda c, t: 0.0 if free[t] and self.price(c, t) != inf else self.price(c, t)
        use = [at.count(t) for t in range(len(bank))]
        inline = alone[at[0]] + sum(step(t, u) for t, u in zip(at[1:], at))
        body, distinct = sum(alone), len(bank)
        size = _bank_way(inline, distinct, body, alone[at[0]], count)[0]
        prices = [priced(c, t) for c, t in zip(self.counts, at, strict=True)]
        index = [_index_size(n, count) for n in range(len(bank) + 1)]
        for _ in range(PASSES):
            changed = False
            for rank, counts in enumerate(self.counts):
                if not counts[0]:
                    continue
                own, in_use = at[rank], 0
                before, after = at[rank - 1] if rank else None, at[rank + 1] if rank + 1 < count else None
                for t in self.nearest[own]:
                    if t == own or not use[t]:
                        continue
                    if in_use == NEAREST:
                        break
                    in_use += 1
                    if (price := priced(counts, t)) == inf:
                        continue
                    old = at[rank]
                    line = inline + (step(t, before) - step(old, before) if rank else alone[t] - alone[old])
                    if after is not None:
                        line += step(after, t) - step(after, old)
                    gone = use[old] == 1
                    n, apart = distinct - gone, body - gone * alone[old]
                    if n > 1:
                        other = 1 + min(line, apart + index[n])
                    else:
                        other = _bank_way(line, n, apart, alone[at[0] if rank else t], count)[0]
                    if other + price < size + prices[rank]:
                        use[old] -= 1
                        use[t] += 1
                        at[rank], inline, body, distinct, size, prices[rank], changed = t, line, apart, n, other, price, True
            if not changed:
                break
        return [bank[t] for t in at]


def _price(counts: Counts, table: Freqs) -> float:
    f = dict(zip(*table, strict=True))
    bits = np.array(counts[1], np.int64) * np.log2(SCALE / np.array([f[s] for s in counts[0]], np.int64))
    return 8 + float(bits.sum()) / 8


def _legacy(freq: Frequencies) -> bytes:
    return _write_legacy(sparse(freq))


def _write_legacy(f: Freqs) -> bytes:
    used, freqs = f
    all_ = np.zeros(used[-1] - used[0] + 1, "<u2")
    all_[np.array(used) - used[0]] = freqs
    return struct.pack("<HH", used[0], used[-1]) + all_.tobytes()


def _legacy_size(f: Freqs) -> int:
    return 4 + 2 * (f[0][-1] - f[0][0] + 1)


def _read_legacy(r: Reader, n: int) -> list[int]:
    return dense(_read_dense(r, n), n)


def _read_dense(r: Reader, n: int) -> Freqs:
    a, b = r.number(2), r.number(2)
    if a > b or b >= n:
        raise CodecError("RansError", "table range")
    counts = np.frombuffer(r.take(2 * (b - a + 1)), "<u2").tolist()
    used = [s for s, x in enumerate(counts, a) if x]
    if not used:
        return sparse(shares([0] * n))
    return tuple(used), shares_of(tuple(counts[s - a] for s in used))


# --- coefficients -----------------------------------------------------------------------------------------------------


def _counted(symbols: list[int]) -> Counts:
    if len(symbols) > FEW:
        used, n = np.unique(symbols, return_counts=True)
        return tuple(used.tolist()), tuple(n.tolist())
    used = sorted(set(symbols))
    return tuple(used), tuple(map(symbols.count, used))


def _make_stream(q: Sequence[int], freq: Freqs, s: Syntax, sparse_: bool) -> tuple[bytes, int]:
    """One rank's values of the blocks that reach it -> bytes, sign mode."""
    out, mode = b"", RAW
    some = [v for v in q if v]
    coded = some if sparse_ else q
    if sparse_ and len(q):
        out = write_presence([v != 0 for v in q])
    if not len(coded):
        return (out if sparse_ else struct.pack("<I", 0)), mode
    if not (s.elide and len(freq[0]) == 1):
        data = encode_few(s.coded(coded), freq)
        out += struct.pack("<I", len(data)) + data
    if s.split_signs:
        negative = [v < 0 for v in some]
        if s.sign_modes and negative and (all(negative) or not any(negative)):
            mode = NEGATIVE if negative[0] else POSITIVE
        else:
            out += _flags(negative)
    return out, mode


@lru_cache(1 << 13)
def _few_stream(q: tuple[int, ...], freq: Freqs, split: bool, elide: bool, modes: bool, sparse_: bool) -> tuple[bytes, int]:
    return _make_stream(q, freq, Syntax(split_signs=split, elide=elide, sign_modes=modes), sparse_)


def _stream(q: Sequence[int], freq: Freqs, s: Syntax, sparse_: bool) -> tuple[bytes, int]:
    if len(q) <= SHORT:
        return _few_stream(tuple(q), freq, s.split_signs, s.elide, s.sign_modes, sparse_)
    return _make_stream(q, freq, s, sparse_)


def _unstream(r: Reader, n: int, freq: Freqs, s: Syntax, sparse_: bool, mode: int) -> list[int]:
    if not n:
        if not sparse_ and r.number(4):
            raise CodecError("RansError", "data for no coefficients")
        return []
    present = read_presence(r, n) if sparse_ else None
    count = n if present is None else sum(present)
    if not count:
        return [0] * n
    only = freq[0][0] if s.elide and len(freq[0]) == 1 else None
    v = [only] * count if only is not None else decode_few(r.take(r.number(4)), count, freq)
    if not s.split_signs:
        v = [x - OFFSET for x in v]
    elif mode == RAW:
        some = sum(x != 0 for x in v)
        sign = iter(_unflags(r.take(-(-some // 8)), some))
        v = [(-x if next(sign) else x) if x else 0 for x in v]
    elif mode == NEGATIVE:
        v = [-x for x in v]
    if present is None or count == n:
        return v
    each = iter(v)
    return [next(each) if p else 0 for p in present]


Ranks = dict[tuple, object]


def _ranks(planes: list[np.ndarray], spans: np.ndarray, memo: Ranks) -> list[list[list[int]]]:
    """For each rank the values of each plane's blocks that reach it."""
    if "ranks" not in memo:
        few, whole = len(spans) <= FEW, int(min(spans, default=64))  # up to there all blocks reach a rank
        reach = spans.tolist() if few else spans
        columns = [np.ascontiguousarray(p.T) for p in planes]
        columns = [c.tolist() if few else c for c in columns]
        if few:
            cut = lambda c, k: c if k < whole else [v for v, n in zip(c, reach, strict=True) if n > k]
        else:
            cut = lambda c, k: (c if k < whole else c[reach > k]).tolist()
        memo["ranks"] = [[cut(c[k], k) for c in columns] for k in range(64)]
    return memo["ranks"]


def _told(here: list[list[int]], k: int, s: Syntax, sparse_: bool, memo: Ranks) -> tuple[Counts, Freqs]:
    """Of a rank's values that are coded, how often each symbol comes, and their table."""
    if (found := memo.get((k, s.split_signs, sparse_))) is None:
        counts = _counted([x for h in here for x in s.coded([v for v in h if v] if sparse_ else h)])
        found = memo[k, s.split_signs, sparse_] = counts, (counts[0], shares_of(counts[1])) if counts[0] else s.zero
    return found


#: A rank as it is written: its table, each plane's bytes and sign mode, and whether only values that aren't 0 are.
Rank = tuple[Freqs, list[bytes], list[int], bool]


def _rank(here: list[list[int]], k: int, before: Freqs | None, s: Syntax, memo: Ranks) -> Rank:
    if not here[0]:
        return s.zero, [struct.pack("<I", 0)] * len(here), [RAW] * len(here), False
    options = []
    for sparse_ in (False, True) if s.significance else (False,):
        _, freq = _told(here, k, s, sparse_, memo)
        made = [_stream(h, freq, s, sparse_) for h in here]
        options.append((freq, [m[0] for m in made], [m[1] for m in made], sparse_))
    if len(options) == 1:
        return options[0]
    table = lambda f: _sized(f, before) if s.adaptive_tables else _legacy_size(f)
    return min(options, key=lambda o: table(o[0]) + sum(map(len, o[1])))


@dataclass
class Plan:
    """Planes before they are written, and the bytes that they will take."""

    tables: list[Freqs]
    streams: list[list[bytes]]
    modes: list[list[int]]
    sparse: list[bool]
    size: int

    def bytes(self, s: Syntax) -> bytes:
        out = [_flags(self.sparse)] if s.significance else []
        if s.split_signs and s.sign_modes:
            out += [pack_bits(m, 2) for m in self.modes]
        if s.bank:
            out.append(_write_bank(self.tables))
        for k, (table, streams) in enumerate(zip(self.tables, self.streams, strict=True)):
            if not s.bank:
                out.append(_write(table, self.tables[k - 1] if k else None) if s.adaptive_tables else _write_legacy(table))
            out += streams
        return b"".join(out)


def plan_planes(planes: list[np.ndarray], spans: np.ndarray, extent: int, s: Syntax, memo: Ranks | None = None) -> Plan:
    """planes: one, or the two chroma planes, which share tables and spans; each blocks x 64 in zigzag order. memo: what
    several syntaxes of the same planes have in common, kept from call to call."""
    memo = {} if memo is None else memo
    limit = extent if s.extents else 64
    if (s, limit) in memo:
        return memo[s, limit]
    ranks = _ranks(planes, spans, memo)
    # a rank is written alike, whatever the others are, but for a choice by the size of its table behind the one before
    linked = s.significance and not s.bank
    known = [] if linked else memo.setdefault(("written", s.split_signs, s.elide, s.significance, s.sign_modes, s.adaptive_tables), [])
    for k in range(len(known), limit):
        known.append(_rank(ranks[k], k, known[-1][0] if linked and k else None, s, memo))
    tables, streams, each, sparse_ = ([r[i] for r in known[:limit]] for i in range(4))
    modes = [[m[i] for m in each] for i in range(len(planes))]
    coded = sum(len(x) for xs in streams for x in xs)
    if s.bank:
        told = _bank_sized(tables)[0]
        if s.cluster and limit > 1:
            tables, streams, modes, told, coded = _clustered(ranks, tables, streams, modes, sparse_, s, memo, told, coded)
    elif s.adaptive_tables:
        told = sum(_sized(t, tables[k - 1] if k else None) for k, t in enumerate(tables))
    else:
        told = sum(map(_legacy_size, tables))
    size = told + coded + (-(-limit // 8) if s.significance else 0) + (len(planes) * -(-limit // 4) if s.split_signs and s.sign_modes else 0)
    memo[s, limit] = Plan(tables, streams, modes, sparse_, size)
    return memo[s, limit]


def write_planes(planes: list[np.ndarray], spans: np.ndarray, extent: int, s: Syntax) -> bytes:
    return plan_planes(planes, spans, extent, s).bytes(s)


def _clustered(ranks: list, tables: list[Freqs], streams: list, modes: list, sparse_: list[bool], s: Syntax, memo: Ranks, told: int, coded: int) -> tuple[list, list, list, int, int]:
    """Tables, streams and sign modes with tables shared, where that is smaller, and the bytes of tables and of streams."""
    none: Counts = ((), ())
    counts = [_told(ranks[k], k, s, sparse_[k], memo)[0] if ranks[k][0] else none for k in range(len(tables))]
    key = "sharing", tuple(tables), tuple(counts)
    if key not in memo:
        memo[key] = Sharing(tables, counts)
    shared = memo[key].choose(s.elide)
    again, signs, more = list(streams), [list(m) for m in modes], 0
    for k, (old, new) in enumerate(zip(tables, shared, strict=True)):
        if counts[k][0] and old != new:
            made = [_stream(h, new, s, sparse_[k]) for h in ranks[k]]
            again[k] = [m[0] for m in made]
            more += sum(map(len, again[k])) - sum(map(len, streams[k]))
            for m, x in zip(signs, made, strict=True):
                m[k] = x[1]
    less = _bank_sized(shared)[0]
    return (shared, again, signs, less, coded + more) if less + more < told else (tables, streams, modes, told, coded)


def read_planes(r: Reader, n: int, spans: np.ndarray, extent: int, s: Syntax) -> list[np.ndarray]:
    if s.bank and not s.adaptive_tables:
        raise CodecError("DecodeFailed", "a bank needs adaptive tables")
    limit = extent if s.extents else 64
    sparse_ = _unflags(r.take(-(-limit // 8)), limit) if s.significance else [0] * limit
    modes = [[0] * limit for _ in range(n)]
    if s.split_signs and s.sign_modes:
        modes = [unpack_bits(r.take(-(-limit // 4)), limit, 2).tolist() for _ in range(n)]
        if any(x > NEGATIVE for m in modes for x in m):
            raise CodecError("DecodeFailed", "sign mode")
    tables = _read_bank(r, limit, s.symbols) if s.bank else None
    freq = None
    columns = [np.zeros((64, len(spans)), np.int64) for _ in range(n)]
    few, all_ = len(spans) <= FEW, np.asarray(spans)
    reach = all_.tolist()
    ends, live, count = set(reach), None, len(reach)
    got: list[list[list[int]]] = [[] for _ in range(n)]
    for k in range(limit):
        freq = tables[k] if tables is not None else _read(r, s.symbols, freq) if s.adaptive_tables else _read_dense(r, s.symbols)
        if k in ends:  # fewer blocks reach this rank than the one before
            live = [x > k for x in reach] if few else all_ > k
            count = sum(live) if few else int(live.sum())
        for c, g, m in zip(columns, got, modes, strict=True):
            v = _unstream(r, count, freq, s, bool(sparse_[k]), m[k])
            if not few:
                c[k, slice(None) if live is None else live] = v
            elif count == len(reach):
                g.append(v)
            else:
                each = iter(v)
                g.append([next(each) if x else 0 for x in live])
    if few and limit:
        for c, g in zip(columns, got, strict=True):
            c[:limit] = g
    return [np.ascontiguousarray(c.T) for c in columns]


def with_flags(flags: int) -> Syntax:
    """The syntax of a tile's flags; bits 0 and 3 concern spans and the sharing of chroma tables."""
    on = lambda bit: bool(flags >> bit & 1)
    return replace(Syntax(), extents=on(1), split_signs=on(2), bank=on(4), elide=on(5), significance=on(6), sign_modes=on(7))
