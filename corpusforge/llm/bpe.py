"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Where tokens may start is found for all texts of a batch at once: every code point gets
a symbol, every symbol is a function on the states of a small automaton, and an
associative scan composes these functions.  The functions reachable by composition form
a small monoid, so the scan works on element numbers and one multiplication table.
Slices between the starts go through a bounded cache to a pair merge.

Behaviour at the edges: a null text encodes as an empty one; an empty text has no
tokens; special tokens are never produced; a single run of any length is merged in
O(n log n); the working arrays of a batch cover about ``SLICE_BYTES`` of text: a longer text
is encoded in parts cut at lone spaces, where a token starts whatever comes before (only a run
without such a space isn't cut).  Repeated rows are encoded each by itself.  Within a slice equal
pieces are recognised by a 64-bit hash; a slice holds under a million different pieces, so
that a false match has odds of under 1 in 10**7 for one slice of that kind.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.scratch import lean
from corpusforge.llm.wordhash import BYTE_BASE, mix, range_hashes, slices

SLICE_BYTES = 1 << 18
CACHE_PIECES = 1 << 16
#: Bytes up to which pieces are merged side by side.
SHORT = 64
TABLE_BITS = 19

# Code point classes.
OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
#: The code points that \\s matches besides U+0020.
WHITES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe to make a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Automaton states: what the token that holds the last code point may go on with.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
# Scan symbols: classes, seen with what follows the code point.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE_MORE, S_SPACE_LAST, S_WHITE_LAST, S_QUOTE_ONE, S_QUOTE_TWO, S_RESET = range(9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if symbol == S_RESET:
        return FRESH, True
    if symbol == S_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (S_OTHER, S_QUOTE_ONE, S_QUOTE_TWO):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_QUOTE_ONE: ONE_MORE, S_QUOTE_TWO: TWO_MORE}[symbol], True
    if symbol == S_WHITE_MORE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == S_SPACE_LAST else FRESH), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, table[first, then] of elements, state after each element from FRESH)."""
    generators = [tuple(_step(s, symbol)[0] for s in range(8)) for symbol in range(9)]
    elements = {f: i for i, f in enumerate(dict.fromkeys(generators))}
    queue = list(elements)
    while queue:
        f = queue.pop()
        for g in generators:
            if (h := tuple(g[x] for x in f)) not in elements:
                elements[h] = len(elements)
                queue.append(h)
    all_of = list(elements)
    table = np.array([[elements[tuple(g[x] for x in f)] for g in all_of] for f in all_of], np.uint8)
    return np.array([elements[g] for g in generators], np.uint8), table, np.array([f[FRESH] for f in all_of], np.uint8)


_ELEMENT, _TABLE, _STATE = _monoid()
_STARTS = np.array([[_step(s, symbol)[1] for symbol in range(9)] for s in range(8)])


def scan(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """All prefix products, by the associative law: rows of ``width`` are scanned side by
    side, their totals are scanned in turn, and each row is multiplied by what precedes it."""
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = _TABLE[out[i - 1], out[i]]
        return out
    whole = np.full(-(-n // width) * width, _ELEMENT[S_RESET], np.uint8)
    whole[:n] = elements
    grid = np.ascontiguousarray(whole.reshape(-1, width).T)
    size = len(_TABLE)
    flat = _TABLE.ravel()
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.intp) * size + grid[i]]
    before = scan(grid[-1], width)[:-1].astype(np.intp) * size
    grid[:, 1:] = flat[before[None, :] + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        first = {"L": LETTER, "N": NUMBER}
        table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITES] = WHITE
        table[0x20] = SPACE
        _classes = table
    return _classes


def token_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts with one separator before each, their code points, the sorted starts of all pieces
    in them (separators included), and the place of each text's separator."""
    joined = "".join(["\0" + t for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    resets = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    kind = classes()[points]
    white = kind >= SPACE
    reset = np.zeros(len(points) + 3, bool)
    reset[resets] = True
    reset[len(points) :] = True
    white[resets] = False
    follows = np.zeros(len(points), bool)  # a code point of the same text that isn't white follows
    follows[:-1] = ~(white[1:] | reset[1 : len(points)])
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE_MORE, S_WHITE_MORE], np.uint8)[kind]
    symbol[(kind == SPACE) & follows] = S_SPACE_LAST
    symbol[(kind == WHITE) & follows] = S_WHITE_LAST
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        after = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = after[quotes + 1], after[quotes + 2]
        ok_one, ok_two = ~reset[quotes + 1], ~reset[quotes + 1] & ~reset[quotes + 2]
        for c in CONTRACTIONS:
            hit = ok_one & (one == ord(c[0])) if len(c) == 1 else ok_two & (one == ord(c[0])) & (two == ord(c[1]))
            symbol[quotes[hit]] = S_QUOTE_ONE if len(c) == 1 else S_QUOTE_TWO
    symbol[resets] = S_RESET
    state = _STATE[scan(_ELEMENT[symbol])]
    before = np.concatenate([np.array([FRESH], np.uint8), state[:-1]])
    starts = _STARTS[before, symbol]
    # What follows a separator starts a token; FRESH sees to that.
    return joined, points, np.flatnonzero(starts), resets


_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, limit: int) -> Iterator[str]:
    """The text in parts of about ``limit`` code points that each begin at a lone space."""
    begin = 0
    while len(text) - begin > limit and (cut := _CUT.search(text, begin + limit)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def _slots(keys: np.ndarray, factor: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)


def _tables(keys: np.ndarray, ranks: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Hash tables with one key a slot; a key whose slot is taken goes to the next table."""
    out, factor = [], 0x9E3779B97F4A7C15
    while len(keys):
        slot = _slots(keys, factor)
        table, value = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
        table[slot], value[slot] = keys, ranks
        out.append((factor, table, value))
        lost = table[slot] != keys
        keys, ranks, factor = keys[lost], ranks[lost], (factor * 0xD6E8FEB86659FD93) % (1 << 64) | 1
    return out


class Encoder:
    """Ranks, and a bounded cache from a piece of text to its tokens."""

    def __init__(self, rank_lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line.strip())}
        self.token = {i: t for t, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, str]] = {}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(self.token) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (x := self.ranks.get(token[:cut])) is not None and (y := self.ranks.get(token[cut:])) is not None:
                    pairs[x * self.size + y] = rank
        self.tables = _tables(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        self.names = [str(i) for i in range(self.size)]
        self.token_size = np.array([len(self.token.get(i, b"")) for i in range(self.size)], np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, or the vocabulary's size where the pair doesn't merge."""
        key = left.astype(np.int64) * self.size + right
        out = np.full(len(key), self.size, np.int32)
        rest = None
        for factor, keys, ranks in self.tables:
            own = key if rest is None else key[rest]
            slot = _slots(own, factor)
            there = keys[slot]
            hit = there == own
            if rest is None:
                out[hit] = ranks[slot[hit]]
                rest = np.flatnonzero(~hit & (there >= 0))
            else:
                out[rest[hit]] = ranks[slot[hit]]
                rest = rest[~hit & (there >= 0)]
            if not len(rest):
                break
        return out

    def merge_short(self, pieces: list[bytes]) -> tuple[list[int], list[int], list[int]]:
        """(tokens, start, end) of many pieces, all merged side by side: in each round every
        piece merges its lowest-ranked pair, the leftmost if there are several."""
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        length = np.array([len(p) for p in pieces])
        name = np.arange(len(pieces))
        first = np.cumsum(length) - length
        ranks = np.full(len(tokens), self.size, np.int32)
        ranks[:-1] = self._pair_ranks(tokens[:-1], tokens[1:])
        ranks[first + length - 1] = self.size  # a piece's last token has no right neighbour
        out, starts, ends, so_far = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        while len(name):
            best = np.minimum.reduceat(ranks, first)
            done = best == self.size
            if done.any():
                keep = np.repeat(~done, length)
                out.append(tokens[~keep])
                stop = so_far + np.cumsum(length[done])
                starts[name[done]], ends[name[done]] = stop - length[done], stop
                so_far += len(out[-1])
                tokens, ranks = tokens[keep], ranks[keep]
                name, length, best = name[~done], length[~done], best[~done]
                first = np.cumsum(length) - length
                if not len(name):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, length))
            owner = np.searchsorted(first, hits, "right") - 1 if len(hits) != len(first) else None
            at = hits if owner is None else hits[np.concatenate([[True], owner[1:] != owner[:-1]])]
            tokens[at] = best
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            ranks[at] = ranks[at + 1]
            tokens, ranks = tokens[keep], ranks[keep]
            at = at - np.arange(len(at))
            length = length - 1
            first = np.cumsum(length) - length
            right = at[at < first + length - 1]
            left = at[at > first] - 1
            ranks[at] = self.size
            both = np.concatenate([right, left])
            ranks[both] = self._pair_ranks(tokens[both], tokens[both + 1])
        return np.concatenate(out).tolist(), starts.tolist(), ends.tolist()

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one long piece, with a heap of pairs."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # a live part runs from its index to end[index]
        left = list(range(-1, n - 1))
        live = bytearray([1]) * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not live[i] or end[i] >= n or end[end[i]] != stop or not live[end[i]]:
                continue
            live[end[i]] = 0
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := left[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def learn(self, pieces: list[str]) -> list[tuple[int, str]]:
        """The pieces' entries (number of ids, ids as text), from the cache or new; beyond the
        cache's bound all but these go."""
        get = self.cache.get
        out = [get(p) for p in pieces]
        new = [i for i, e in enumerate(out) if e is None]
        raw = [pieces[i].encode("utf-8", "surrogatepass") for i in new]
        short = [r for r in raw if len(r) <= SHORT]
        tokens, starts, ends = self.merge_short(short) if short else ([], [], [])
        where = iter(zip(starts, ends))
        names = self.names
        for i, r in zip(new, raw):
            if len(r) <= SHORT:
                a, b = next(where)
                ids = tokens[a:b]
            else:
                ids = self.merge_long(r)
            out[i] = (len(ids), " ".join([names[x] for x in ids]))
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = dict(zip(pieces, out))
        else:
            self.cache.update([(pieces[i], out[i]) for i in new])
        return out

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])

    def decode_all(self, lists: list[np.ndarray]) -> list[memoryview]:
        """The bytes of several lists of ids, decoded in one go and cut by the ids' lengths."""
        ids = np.concatenate([*lists, np.zeros(0, np.int32)])
        ends = np.concatenate([[0], np.cumsum(self.token_size[ids])])
        data = memoryview(self.decode(ids.tolist()))
        cut = ends[np.cumsum([0, *map(len, lists)])].tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]

    def entries(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list]]:
        """For each text: where its pieces start, in code points, and their cache entries."""
        held: list[str] = []
        for text in texts:
            if len(text) <= SLICE_BYTES:
                held.append(text)
                continue
            yield from self._entries(held)
            held = []
            starts, found, at = [], [], 0
            for part in parts(text, SLICE_BYTES):
                own, entries = next(self._entries([part]))
                starts.append(own + at)
                found += entries
                at += len(part)
            yield np.concatenate(starts), found
        yield from self._entries(held)

    def _entries(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list]]:
        if not texts:
            return
        joined, points, starts, resets = token_starts(texts)
        bounds = np.append(starts, len(joined))
        # Equal pieces are found by a 64-bit hash of their code points; see the module's text.
        code = mix(range_hashes(points, starts, bounds[1:], BYTE_BASE)) ^ (bounds[1:] - starts).astype(np.uint64)
        _, sample, kind = np.unique(code, return_index=True, return_inverse=True)
        found = self.learn([joined[a:b] for a, b in zip(bounds[sample].tolist(), bounds[sample + 1].tolist())])
        at = np.append(np.searchsorted(starts, resets), len(starts)).tolist()
        kind = kind.tolist()
        for k in range(len(texts)):
            yield starts[at[k] + 1 : at[k + 1]] - (resets[k] + 1), [found[i] for i in kind[at[k] + 1 : at[k + 1]]]

    @staticmethod
    def ids(found: list) -> np.ndarray:
        """The ids of a text's entries."""
        return np.fromstring(" ".join([e[1] for e in found]), np.int32, sep=" ")

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """(ids, start of each id's piece in code points) of each text."""
        for starts, found in self.entries(texts):
            yield self.ids(found).tolist(), [int(s) for s, e in zip(starts, found) for _ in range(e[0])]


_encoders: dict[bytes, Encoder] = {}


def encoder(rank_lines: bytes) -> Encoder:
    key = hashlib.sha256(rank_lines).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(rank_lines)
    return _encoders[key]


def rank_file(path: str) -> bytes:
    """A rank file's bytes; its size is that of a vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def encode_documents(docs: DataFrame, rank_lines: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, offsets array<int>): offsets say in which code point each id's piece starts."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank_lines)

    def run(batches):
        enc = encoder(ranks.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = [], []
                for starts, found in enc.entries(_texts(part, "text")):
                    ids.append(enc.ids(found))
                    offsets.append(np.repeat(starts, [e[0] for e in found]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], [key, "ids", "offsets"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema['key'].dataType.simpleString()}, ids array<int>, offsets array<int>")


def decode_ids(encoded: DataFrame, rank_lines: bytes, key: str = "doc_id") -> DataFrame:
    """(key, data binary) from (key, ids)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(rank_lines)

    def run(batches):
        enc = encoder(ranks.value)
        for batch in batches:
            data = [enc.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(data, pa.binary())], [key, "data"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, data binary")


def encoding_digests(docs: DataFrame, rank_lines: bytes, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids array<int> if asked for: each
    whole text encoded, its ids decoded again, and both hashed in the same pass."""
    lean(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(rank_lines)

    def run(batches):
        enc = encoder(ranks.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sums, lists = [], []
                for _, found in enc.entries(_texts(part, "text")):
                    line = " ".join([e[1] for e in found])
                    sums.append(hashlib.sha256(line.encode()).hexdigest())
                    lists.append(np.fromstring(line, np.int32, sep=" "))
                data = [hashlib.sha256(d).hexdigest() for d in enc.decode_all(lists)]
                columns = [part.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), pa.array(sums, pa.string()), pa.array(data, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
