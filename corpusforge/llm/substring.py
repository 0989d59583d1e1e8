"""Substring dedup with difference-cover anchors.

A window is ``length`` consecutive words of one text.  Every word of a window whose word
sequence also starts anywhere else (in the same text, too) is removed.

1. Equal texts are folded into one row with their number, before and after one shuffle.
2. Windows of ``length - period + 1`` words are hashed, but only at word positions whose
   remainder modulo ``period`` lies in a difference cover.  For any two positions there is
   a shift below ``period`` that brings both into the cover, so two equal windows of
   ``length`` words always contain an equal anchor.  Anchors that occur once go.
3. Only starts from which a repeated anchor can be reached are extended: the whole window
   is hashed there (95 bits), and windows that occur once go.
4. The texts meet their repeated windows again and are cut.

Nothing is listed in pairs: the work is one row for each anchor and each extended window,
and what a batch of texts holds twice is settled in it, so that a passage in a third of
all texts is one row for each batch.  The three passes over the texts read one exchange.

Edges: a null text has no words; texts with fewer than ``length`` words lose nothing; rows
with equal texts get equal results, each row its own; keys may be null or repeated; other
columns are ignored.  Texts are told apart by 128 bits of hashes: those few whose first 64 bits
clash get a number of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.scratch import lean, written
from corpusforge.llm.wordhash import WORD_BASE, WORD_BASE_2, Words, mix, range_hashes, slices

#: Difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least a third of the length."""
    period = max(p for p in COVERS if p == 1 or 3 * (length - p + 1) >= length)
    return period, COVERS[period]


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each run's first entry, run length) where one owner's positions follow each other."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _settled(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each code weighs two or more in this batch, index of one row for each such code)."""
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(code) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], first) if len(code) else np.zeros(0, np.int64)
    many = np.zeros(len(code), bool)
    many[order] = np.repeat(total >= 2, np.diff(np.append(first, len(code))))
    return many, order[first[total >= 2]]


#: Texts are hashed in slices of SLICE bytes; what occurs twice is looked for in GATHER bytes at a time.
SLICE, GATHER = 1 << 18, 1 << 24


def _gathered(batch: pa.RecordBatch, hashed):
    """hashed(slice) for the slices of a part of the batch, joined column by column, part after part."""
    held, size = [], 0
    for part in slices(batch, "text", SLICE):
        held.append(hashed(part))
        size += part.column("text").nbytes
        if size >= GATHER:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _anchors(length: int):
    period, cover = cover_for(length)
    size = length - period + 1

    def hashed(part):
        words = Words(part.column("text"))
        begin, code = words.windows(size)
        owner = words.owner()[begin]
        place = begin - words.first[owner]
        keep = np.isin(place % period, cover) & (words.count[owner] >= length)
        owner = owner[keep]
        return code[keep], place[keep], np.asarray(part.column("t"))[owner], np.minimum(np.asarray(part.column("n")), 2)[owner]

    def run(batches):
        for batch in batches:
            for code, place, text, weight in _gathered(batch, hashed):
                many, sample = _settled(code, weight)
                code = code.view(np.int64)
                # What is settled here travels by its text; one row for each code tells other batches.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.where(many, text, code), code[sample]])),
                        pa.array(np.concatenate([place * 2 + many, np.full(len(sample), -1)])),
                        pa.array(np.concatenate([text, np.zeros(len(sample), np.int64)])),
                    ],
                    ["k", "mark", "t"],
                )

    return run


def _extensions(length: int):
    period, _ = cover_for(length)

    def hashed(part):
        words = Words(part.column("text"))
        marks = part.column("marks")
        owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(marks.offsets)))
        spot = words.first[owner] + np.asarray(marks.flatten())
        # A start is wanted if an anchor lies at most period - 1 words on.
        delta = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(delta, np.maximum(spot - period + 1, words.first[owner]), 1)
        np.add.at(delta, spot + 1, -1)
        whose = words.owner()
        begin = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
        begin = begin[begin + length <= words.first[whose[begin] + 1]]
        code = mix(range_hashes(words.hash, begin, begin + length, WORD_BASE))
        check = mix(range_hashes(words.hash, begin, begin + length, WORD_BASE_2)) >> np.uint64(33)
        owner = whose[begin]
        return code, check, begin - words.first[owner], np.asarray(part.column("t"))[owner], np.minimum(np.asarray(part.column("n")), 2)[owner]

    def run(batches):
        for batch in batches:
            for code, check, place, text, weight in _gathered(batch, hashed):
                many, sample = _settled(code ^ (check << np.uint64(33)), weight)
                first, runs = _runs(text[many], place[many])
                code, check, lone = code.view(np.int64), check.astype(np.int64), ~many
                settled = text[many][first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([code[lone], code[sample], settled])),
                        pa.array(np.concatenate([check[lone] << 32 | place[lone], check[sample] << 32, place[many][first]])),
                        pa.array(np.concatenate([np.ones(lone.sum(), np.int32), np.full(len(sample), -1, np.int32), runs.astype(np.int32) + 1])),
                        pa.array(np.concatenate([text[lone], np.zeros(len(sample), np.int64), settled])),
                    ],
                    ["k", "at", "run", "t"],
                )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = batch.column("found").to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, windows in zip(texts, found):
                words = text.split()
                n_words.append(len(words))
                if windows:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, [w["place"] for w in windows], 1)
                    np.add.at(delta, [w["place"] + w["run"] - 1 + length for w in windows], -1)
                    stay = np.cumsum(delta[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["t", "n_words", "n_removed", "kept"],
            )

    return run


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """(t, found array<struct<place, run>>): for each text the starts of repeated windows, as runs."""
    anchors = texts.mapInArrow(_anchors(length), "k long, mark long, t long")
    weight = F.expr("if(mark % 2 = 0, 1, 2)")  # -1 is odd, too
    marks = (
        anchors.withColumn("total", F.sum(weight).over(Window.partitionBy("k")))
        .where("total >= 2 and mark >= 0")
        .groupBy("t")
        .agg(F.collect_list(F.shiftright("mark", 1).cast("int")).alias("marks"))
    )
    windows = texts.join(marks, "t").mapInArrow(_extensions(length), "k long, at long, run int, t long")
    # run: 1 for a window to be judged, -1 for a repeated one without a place, else 1 more than the settled run's length.
    weight = F.when(F.col("run") == 1, 1).otherwise(2)
    return (
        windows.withColumn("total", F.sum(weight).over(Window.partitionBy("k", F.shiftright("at", 32))))
        .where("total >= 2 and run > 0")
        .groupBy("t")
        .agg(F.collect_list(F.struct(F.expr("cast(at & 4294967295 as int)").alias("place"), F.greatest(F.lit(1), F.col("run") - 1).alias("run"))).alias("found"))
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text, t): t is the text's 64-bit hash, or a hash of 128 bits where other texts have the same 64."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), text_hash(body).alias("t"))
    second = F.xxhash64(F.lit(1), "text")
    clashes = rows.groupBy("t").agg(F.min(second).alias("a"), F.max(second).alias("b")).where("a != b").select("t")
    clashes = written(clashes)  # nearly always empty: n texts have about n**2 / 2**65
    if clashes.isEmpty():
        return rows
    own = F.when(F.col("clash"), F.xxhash64("t", second)).otherwise(F.col("t"))
    return rows.join(clashes.withColumn("clash", F.lit(True)), "t", "left").select("key", "text", own.alias("t"))


def dedup_substrings(docs: DataFrame, length: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept): kept words are joined by one space."""
    rows = _numbered(docs, text, key)
    texts = rows.groupBy("t").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    found = repeated_windows(texts, length)
    cut = texts.join(found, "t", "left").select("t", "text", "n", "found").mapInArrow(_cut(length), "t long, n_words long, n_removed long, kept string")
    return rows.select(F.col("key").alias(key), "t").join(cut, "t").drop("t")


def removal_digests(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    lean(docs.sparkSession)
    rows = _numbered(docs, "text", "doc_id").withColumn("doc_id", F.col("key").cast("long"))
    texts = rows.groupBy("t").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    found = repeated_windows(texts, length)
    cut = _cut(length)

    def digests(batches):
        for batch in cut(batches):
            sums = [hashlib.sha256(k).hexdigest() for k in batch.column("kept").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.string())], ["t", "n_words", "n_removed", "kept_sha256"])

    out = texts.join(found, "t", "left").select("t", "text", "n", "found").mapInArrow(digests, "t long, n_words long, n_removed long, kept_sha256 string")
    return rows.select("doc_id", "t").join(out, "t").select("doc_id", "n_words", "n_removed", "kept_sha256")
