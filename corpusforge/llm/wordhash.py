"""Vectorised word and word-window hashing over Arrow string columns.

All functions work on the UTF-8 bytes of many texts at once, so that no Python
statement runs per word.  A sequence x[0..n) hashes to sum(x[i] * B**i) modulo 2**64
with an odd B; prefix sums then give the hash of any range by one subtraction and one
multiplication with a power of B's inverse.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
#: Odd multipliers; any odd numbers without short periods modulo 2**64 would do.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: Values hashed at a time; working arrays and the table of powers cover as many.
BLOCK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first BLOCK + 1 powers of base and of its inverse modulo 2**64."""
    if base not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(BLOCK + 1, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, plus: int = 0) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] + plus for each i; equal content gives equal hashes.

    Starts and ends must not decrease.  Ranges are hashed in runs that cover BLOCK values; a
    range that is longer is hashed in pieces."""
    up, down = powers(base)
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[b - 1])
        if high - low > BLOCK:
            out[a] = _long_hash(values[low:high], base, plus)
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((values[low:high].astype(np.uint64) + np.uint64(plus)) * up[: high - low], out=sums[1:])
            out[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * down[starts[a:b] - low]
        a = b
    return out


def _long_hash(values: np.ndarray, base: int, plus: int) -> int:
    up, _ = powers(base)
    total = 0
    for at in range(0, len(values), BLOCK):
        part = values[at : at + BLOCK].astype(np.uint64) + np.uint64(plus)
        total += int((part * up[: len(part)]).sum()) * pow(base, at, 1 << 64)
    return total & _MASK


def byte_table(separators: str | bytes) -> np.ndarray:
    """True where a byte separates words."""
    table = np.zeros(256, bool)
    table[list(separators if isinstance(separators, bytes) else separators.encode())] = True
    return table


#: The complement of the word class [^\\x20\\x09-\\x0D].
SPACES = byte_table(b" \t\n\x0b\x0c\r")
FOLD_ASCII = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """The words of every text of a batch.

    start, end: byte ranges in ``data``; hash: 64 bits a word; first: index of each
    text's first word, with one more entry at the end, so text i has the words
    first[i] to first[i + 1].
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray | None = None):
        self.data, bounds = utf8(column)
        data = self.data if fold is None else fold[self.data]
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(separators[data], out=inside[1:-1])
        edge = inside[1:] != inside[:-1]
        # A text's end is a word's end, even where two texts meet without a separator.
        cuts = bounds[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        at = np.flatnonzero(edge)
        if len(joined):
            at = np.sort(np.concatenate([at, joined, joined]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, bounds)
        self.hash = mix(range_hashes(data, self.start, self.end, BYTE_BASE, 1))
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.count)

    def windows(self, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        begin = np.arange(max(0, len(self.hash) - size + 1))
        owner = self.owner()
        begin = begin[owner[begin] == owner[begin + size - 1]] if len(begin) else begin
        return begin, mix(range_hashes(self.hash, begin, begin + size, base))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18):
    """The batch in runs of rows of about ``limit`` bytes of text, so that working
    arrays stay bounded whatever the batch size; a longer text is a run of its own, and
    takes about ten bytes of arrays for each of its bytes."""
    if not batch.num_rows:
        return
    _, bounds = utf8(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    trim()


def trim() -> None:
    """Give freed memory back: a worker process outlives its task, and its heap counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)
