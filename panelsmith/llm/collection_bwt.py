"""Column-wise Burrows-Wheeler transform of a string collection, with common prefixes.

The strings are read from right to left. Round j inserts, for every string of at least j symbols, its
suffix of j symbols into the sorted list of all shorter suffixes: the transform (the symbol before each
suffix) and the common prefix of each suffix with the one before it are the only state besides one
position per string. Both live in two sequential files, read once and written once per round:

* a suffix cS belongs at (suffixes that begin with less than c) + (symbols c in the transform before S);
* its common prefix with the suffix before it is 1 + the least common prefix between S and the last place
  before it whose symbol is c, and 0 where there is none; the suffix after it is treated likewise.

Common prefixes are kept up to ``limit``, which is all that matching strings of that length need.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Entries of the files that are in memory at once, at most.
BLOCK = 1 << 18
#: A sequential file up to this size stays in memory; a larger one is private scratch of the task.
_SPOOL = 64 << 20


class _File:
    """Two parallel columns (symbols, common prefixes), appended in blocks and read in blocks."""

    def __init__(self, symbols: type) -> None:
        self._types = (np.dtype(symbols), np.dtype(np.uint8))
        self._columns = [tempfile.SpooledTemporaryFile(max_size=_SPOOL) for _ in self._types]

    def append(self, *columns: np.ndarray) -> None:
        for file, column, kind in zip(self._columns, columns, self._types):
            file.write(column.astype(kind, copy=False).tobytes())

    def rewind(self) -> None:
        for file in self._columns:
            file.seek(0)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(f.read(n * k.itemsize), k) for f, k in zip(self._columns, self._types))

    def close(self) -> None:
        for file in self._columns:
            file.close()


@lru_cache(maxsize=2)
def _logarithms(bits: int) -> np.ndarray:
    """Floor of the binary logarithm of 1 .. 2**bits (0 for 0)."""
    return np.log2(np.maximum(np.arange((1 << bits) + 1), 1)).astype(np.uint8)


class _Least:
    """Least value in closed ranges of a block: row k holds the least of the 2**k values from each place on."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._rows = np.full((n.bit_length(), n), 255, np.uint8)
        self._rows[0] = values
        for k in range(1, n.bit_length()):
            half, some = 1 << (k - 1), n - (1 << k) + 1
            np.minimum(self._rows[k - 1, :some], self._rows[k - 1, half : half + some], out=self._rows[k, :some])
        self._log = _logarithms(n.bit_length())

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """255 for an empty range."""
        n = self._rows.shape[1]
        length = last - first
        length += 1
        level = self._log.take(np.maximum(length, 0)).astype(np.int64)
        row = level * n
        rows = self._rows.ravel()
        least = rows.take(row + np.minimum(first, n - 1))
        row += np.maximum(last - (1 << level) + 1, 0)
        np.minimum(least, rows.take(row), out=least)
        least[length <= 0] = 255
        return least


class Collection:
    """The transform of strings over the symbols 1 .. 2**32 - 1 (back to back; ``ends``: where each stops)."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, limit: int, block: int = BLOCK):
        self.ends, self.limit = ends.astype(np.int64), limit
        self.lengths = np.diff(np.r_[0, self.ends])
        self.m = len(ends)
        self.size = self.m
        self.n_symbols = int(text.max(initial=0)) + 1
        self.kind = np.uint16 if self.n_symbols <= 1 << 16 else np.uint32
        self.text = text.astype(self.kind)
        # a place in the block, a flag and a symbol share a word; what does not fit of the symbol is sorted by afterwards
        self.place_bits = max(min(block, 1 << 20) - 1, 1).bit_length()
        self.block = min(block, 1 << self.place_bits)
        self.low_bits = 31 - self.place_bits
        if self.n_symbols.bit_length() > self.low_bits + 32 - self.place_bits:
            raise ValueError(f"{self.n_symbols} symbols in blocks of {self.block}")
        self.file = _File(self.kind)
        self.at = np.arange(self.m)  # place of each string's newest suffix, ascending
        self.string = np.arange(self.m)
        symbols = self._before(self.string, 0)
        for a in range(0, self.m, self.block):
            part = symbols[a : a + self.block]
            self.file.append(part, np.zeros(len(part), np.uint8))
        self.counts = self._count(symbols)

    def _count(self, symbols: np.ndarray) -> np.ndarray:
        return np.bincount(symbols, minlength=self.n_symbols)

    def _by_symbol(self, block: np.ndarray, flags: np.ndarray | np.unsignedinteger) -> tuple[np.ndarray, np.ndarray]:
        """The block's places (times two, plus the flag) ordered by symbol then place; and the symbols' counts."""
        places = np.uint32((1 << self.place_bits) - 1)
        packed = block.astype(np.uint32)
        packed &= np.uint32((1 << self.low_bits) - 1)
        packed <<= np.uint32(self.place_bits + 1)
        packed |= np.arange(0, 2 * len(block), 2, dtype=np.uint32)
        packed |= flags
        packed.sort()
        if self.n_symbols > 1 << self.low_bits:
            high = (block >> self.kind(self.low_bits)).take(packed >> np.uint32(1) & places).astype(np.uint32)
            high <<= np.uint32(self.place_bits)
            high |= np.arange(len(block), dtype=np.uint32)
            high.sort()
            packed = packed.take(high & places)
        packed &= np.uint32((2 << self.place_bits) - 1)
        return packed, self._count(block)

    def _before(self, strings: np.ndarray, length: int) -> np.ndarray:
        """The symbol before each string's suffix of ``length`` symbols; 0 before the whole string."""
        open_ = self.lengths[strings] > length
        at = np.where(open_, self.ends[strings] - length - 1, 0)
        return np.where(open_, self.text[at], self.kind(0))

    def build(self) -> Collection:
        for length in range(1, int(self.lengths.max(initial=0)) + 1):
            self._insert(length)
        return self

    def _blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        self.file.rewind()
        for a in range(0, self.size, self.block):
            bwt, lcp = self.file.take(min(self.block, self.size - a))
            yield a, bwt, lcp

    def _starts(self) -> np.ndarray:
        """Where the suffixes that begin with each symbol start; the empty suffixes come first."""
        below = self.counts.copy()
        below[0] = 0
        return self.m + np.r_[0, np.cumsum(below)[:-1]]

    def _insert(self, length: int) -> None:
        base = self._starts()
        seen = np.zeros(self.n_symbols, np.int64)  # occurrences of each symbol so far
        since = np.full(self.n_symbols, 255, np.uint8)  # least common prefix since the last one
        last_new = np.zeros(self.n_symbols, bool)
        found = []
        for a, bwt, lcp in self._blocks():
            low, high = np.searchsorted(self.at, [a, a + len(bwt)])
            new = np.zeros(len(bwt), np.uint32)
            new[self.at[low:high] - a] = 1
            number = np.zeros(len(bwt), np.int32)
            number[self.at[low:high] - a] = np.arange(low, high)
            order, count = self._by_symbol(bwt, new)
            stop = np.cumsum(count)
            start = stop - count
            present = np.flatnonzero(count)
            least = _Least(lcp)
            is_new = (order & np.uint32(1)).astype(bool)
            order >>= np.uint32(1)
            marked = is_new.copy()
            marked[1:] |= is_new[:-1]
            marked[start[present]] = is_new[start[present]] | last_new[present]
            hit = np.flatnonzero(marked[count[0] :])  # strings that are wholly in have nothing to insert
            hit += count[0]
            here = order.take(hit).astype(np.int64)
            s = bwt.take(here)
            before = order.take(np.maximum(hit - 1, 0)).astype(np.int64)
            first = np.flatnonzero(hit == start.take(s))  # of their symbol in this block
            before[first] = -1
            value = least(before + 1, here)
            value[first] = np.minimum(value[first], since[s[first]])
            prefix = np.minimum(value, np.uint8(self.limit - 1))
            prefix += np.uint8(1)
            prefix[first[seen[s[first]] == 0]] = 0
            new_hit = is_new.take(hit)
            found.append((hit + (base + seen - start).take(s), prefix, new_hit, number.take(here)))
            tail = order[stop[present] - 1].astype(np.int64)
            since = np.minimum(since, lcp.min(initial=255))
            since[present] = least(tail + 1, np.full(len(tail), len(bwt) - 1))
            last_new[present] = is_new[stop[present] - 1]
            seen += count
        place, prefix, is_new, origin = (np.concatenate(c) for c in zip(*found))
        if len(found) > 1:
            order = np.argsort(place, kind="stable")  # one ascending run per block
            place, prefix, is_new, origin = place[order], prefix[order], is_new[order], origin[order]
        strings = self.string[origin[is_new]]
        at = place[is_new]
        self._merge(at, self._before(strings, length), prefix[is_new], place[~is_new], prefix[~is_new])
        self.at, self.string = at, strings

    def _merge(self, at: np.ndarray, symbols: np.ndarray, prefixes: np.ndarray, changed: np.ndarray, to: np.ndarray) -> None:
        """Write the next file: old entries in order, the new ones at ``at``, common prefixes changed."""
        old, self.file = self.file, _File(self.kind)
        old.rewind()
        self.size += len(at)
        self.counts += self._count(symbols)
        for a in range(0, self.size, self.block):
            b = min(a + self.block, self.size)
            low, high = np.searchsorted(at, [a, b])
            places = at[low:high] - a
            kept = np.ones(b - a, bool)
            kept[places] = False
            bwt, lcp = np.empty(b - a, self.kind), np.empty(b - a, np.uint8)
            bwt[kept], lcp[kept] = old.take(b - a - len(places))
            bwt[places], lcp[places] = symbols[low:high], prefixes[low:high]
            low, high = np.searchsorted(changed, [a, b])
            lcp[changed[low:high] - a] = to[low:high]
            self.file.append(bwt, lcp)
        old.close()

    def classes(self) -> tuple[np.ndarray, int]:
        """Per place, the number of its run of suffixes that share ``limit`` symbols; and how many runs."""
        out, runs = np.empty(self.size, np.int32), 0
        for a, _, lcp in self._blocks():
            part = np.cumsum(lcp < self.limit) + (runs - 1)
            out[a : a + len(lcp)] = part
            runs = int(part[-1]) + 1
        return out, runs

    def suffix_places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the strings that have a suffix of it, and the suffixes' places."""
        base, step = self._starts(), np.empty(self.size, np.int32)
        seen = np.zeros(self.n_symbols, np.int64)
        for a, bwt, _ in self._blocks():
            order, count = self._by_symbol(bwt, np.uint32(0))
            place = (order >> 1).astype(np.int64)
            symbol = bwt[place]
            step[a + place] = (base + seen - np.cumsum(count) + count)[symbol] + np.arange(len(bwt))
            seen += count
        strings, at = np.arange(self.m), np.arange(self.m)
        for length in range(1, int(self.lengths.max(initial=0)) + 1):
            more = self.lengths[strings] >= length
            strings, at = strings[more], step[at[more]]
            yield length, strings, at

    def close(self) -> None:
        self.file.close()
