"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters, marks and digits (Unicode L, M and N), in lower case.  An item and a window of as many words
are compared by their word shingles, each weighted by how often it occurs: the similarity is
the sum of the lesser weights over the sum of the greater ones.

1. Windows start at every word.  A window can only reach the threshold if enough of its
   shingles occur in some item of its length; prefix sums give that count for all windows at
   once, and the others, nearly all, need no fingerprint.  Nothing that could match is lost.
2. The rest get 64-bit SimHash fingerprints from prefix sums over their shingles' bits.
3. A multi-index finds all items of the same length within ``RADIUS``: fingerprints are cut
   into ``BLOCKS`` blocks, and one of them must differ in at most RADIUS / BLOCKS bits.  At a
   similarity of 0.8 a distance has mean 9.7 and deviation 2.9, so that 23 is 4.6 deviations up.
   At so wide a radius a block admits about a tenth of the items of a length: the index is there
   for the guarantee, and step 1 for the speed.
4. The exact weighted similarity of window and item decides.

Items go to the workers in blocks of about ``BLOCK_BYTES`` of text, one pass each; with more than
one block each pass is written and its items are released before the next one starts.

Edges: a null or empty text matches nothing, and neither does an item without words; an item
of fewer words than a shingle is one shingle; a text shorter than an item is one window;
rows that repeat are judged each by itself; keys may be null; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.scratch import lean, numbered, written
from corpusforge.llm.wordhash import Words, slices

SHINGLE, PERCENT, RADIUS, BLOCKS = 5, 80, 23, 4
BLOCK_BYTES = 16 << 20
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _blocks(prints: np.ndarray) -> np.ndarray:
    """The 16-bit blocks of fingerprints, one row for each block."""
    return np.stack([(prints >> np.uint64(16 * b)).astype(np.uint16) for b in range(BLOCKS)])


class HammingIndex:
    """Finds every stored fingerprint within RADIUS of a query."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for block in _blocks(prints):
            order = np.argsort(block, kind="stable")
            keys, first = np.unique(block[order], return_index=True)
            self.tables.append((keys, np.split(order, first[1:])))

    def search(self, queries: np.ndarray) -> list[tuple[int, int]]:
        """(query, stored) index pairs."""
        found = set()
        for (keys, lists), block in zip(self.tables, _blocks(queries)):
            for q, value in enumerate(block):
                for k in np.flatnonzero(_BITS[keys ^ value] <= RADIUS // BLOCKS):
                    found.update((q, int(i)) for i in lists[k])
        return sorted(p for p in found if int(queries[p[0]] ^ self.prints[p[1]]).bit_count() <= RADIUS)


def fingerprints(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of codes[s : s + size] for each start: a bit is set where the weights for it prevail."""
    low = int(starts.min())
    span = codes[low : int(starts.max()) + size]
    bits = np.unpackbits(span.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    at = starts - low
    return np.packbits(sums[at + size] - sums[at] > 0, axis=1).copy().view(np.uint64).ravel()


class Items:
    """The items of one block, by length in words."""

    def __init__(self, ids: list, texts: list[str], size: int, percent: int):
        self.size, self.percent = size, percent
        words = Words(pa.array(texts, pa.string()))
        self.by_length: dict[int, list[tuple[object, np.ndarray]]] = {}
        for i, n in enumerate(words.count.tolist()):
            if n:
                own = Words(pa.array([texts[i]], pa.string()))
                self.by_length.setdefault(n, []).append((ids[i], own.windows(min(size, n))[1]))
        self.index = {n: HammingIndex(np.concatenate([fingerprints(c, np.zeros(1, np.int64), len(c)) for _, c in own])) for n, own in self.by_length.items()}
        self.counts = {n: [Counter(c.tolist()) for _, c in own] for n, own in self.by_length.items()}
        self.known = {n: np.unique(np.concatenate([c for _, c in own])) for n, own in self.by_length.items()}
        # By shingle size (the full one, or an item's whole length): all shingles, and the lengths they belong to.
        self.sizes: dict[int, list[int]] = {}
        for n in self.by_length:
            self.sizes.setdefault(min(size, n), []).append(n)
        self.all = {k: np.unique(np.concatenate([self.known[n] for n in lengths])) for k, lengths in self.sizes.items()}

    def _in_text(self, codes: np.ndarray, n: int):
        """(item, similarity, start) of the best window for each item of n words that matches in one text."""
        size = min(n - min(self.size, n) + 1, len(codes))
        whole = n - min(self.size, n) + 1
        hits = np.concatenate([[0], np.cumsum(np.isin(codes, self.known[n]))])
        # With common weight c, the similarity is c / (size + whole - c).
        need = -(-self.percent * (size + whole) // (100 + self.percent))
        starts = np.flatnonzero(hits[size:] - hits[:-size] >= need)
        if not len(starts):
            return
        best: dict[int, tuple[float, int]] = {}
        for q, item in self.index[n].search(fingerprints(codes, starts, size)):
            start = int(starts[q])
            common = (Counter(codes[start : start + size].tolist()) & self.counts[n][item]).total()
            if 100 * common >= self.percent * (size + whole - common):
                best[item] = max(best.get(item, (0.0, 0)), (common / (size + whole - common), -start))
        for item, (similarity, start) in best.items():
            yield self.by_length[n][item][0], similarity, -start

    def matches(self, column: pa.Array):
        """(text, item, similarity, first word) for each matching pair."""
        words = Words(column)
        owner = words.owner()
        for k, lengths in self.sizes.items():
            begin, codes = words.windows(k)
            whose = owner[begin]
            hit = np.isin(codes, self.all[k])
            for i in np.unique(whose[hit]).tolist():
                a, b = np.searchsorted(whose, [i, i + 1])
                own = np.unique(codes[a:b][hit[a:b]])
                for n in lengths:
                    if np.isin(own, self.known[n]).any():
                        for item, similarity, start in self._in_text(codes[a:b], n):
                            yield i, item, similarity, start


def plain(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{M}\p{N}]+", " ")


def _passes(docs: DataFrame, benchmark: DataFrame, item: str, text: str, limit: int, size: int, percent: int, one_pass) -> list[DataFrame]:
    """one_pass(items, what came before) for each block of items; all but a lone one written."""
    rows = benchmark.select(F.col(item).alias("id"), plain(F.col(text)).alias("text")).where("text is not null")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // limit))
    out: list[DataFrame] = []
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(([r.id for r in got], [r.text for r in got])))
        made: list[Items] = []

        def items(held=held, made=made) -> Items:
            if not made:
                made.append(Items(*pickle.loads(held.value), size, percent))
            return made[0]

        out.append(one_pass(items, out))
        if blocks > 1:
            out[-1] = written(out[-1])
            held.destroy()
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id", item: str = "item_id", limit: int = BLOCK_BYTES) -> DataFrame:
    """(key, item, similarity, first_word): a row for each document and item that match, at the best window."""
    lean(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), plain(F.col(text)).alias("text"))
    schema = f"{key} {rows.schema['key'].dataType.simpleString()}, {item} {benchmark.schema[item].dataType.simpleString()}, similarity double, first_word long"

    def one_pass(items, _):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(zip(*items().matches(part.column("text")))) or [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(found[0], pa.int64())), pa.array(found[1]) if found[0] else pa.array([], pa.int64()), pa.array(found[2], pa.float64()), pa.array(found[3], pa.int64())],
                        [key, item, "similarity", "first_word"],
                    )

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.union, _passes(docs, benchmark, item, text, limit, size, percent, one_pass))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", item: str = "item_id", limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    lean(docs.sparkSession)
    rows, own = numbered(docs, text)
    mark = "plain"
    marked = rows.withColumn(mark, plain(F.col(own)))

    def one_pass(items, before):
        def run(batches):
            for batch in batches:
                for part in slices(batch, mark):
                    clean = np.ones(part.num_rows, bool)
                    clean[[m[0] for m in items().matches(part.column(mark))]] = False
                    yield part.filter(pa.array(clean))

        return (before[-1] if before else marked).mapInArrow(run, marked.schema)

    return _passes(docs, benchmark, item, text, limit, size, percent, one_pass)[-1].drop(mark).toDF(*docs.columns)
