"""Approximate cosine search by a stored inverted-file index.

``write_ann`` learns at most ``MAX_CELLS`` centroids, on a bounded sample, and deals every vector to its
nearest one.  A cell is a folder; it holds each vector whole and as a code of one byte a component,
the difference to its centroid in steps of a fixed size.  ``search`` takes the cells nearest to each
question, reads the codes of these cells alone, and scores again, with the whole vectors, every one
that could be among the ``rerank`` best of each question: each row carries how far its code is from its
vector, which bounds its score from both sides.  Of equal vectors only the first ``rerank`` by key can be.
So results are exact within the cells that are read; only which cells these are is approximate.

How many cells a question needs for a stated recall depends on the vectors.  It is measured when the
index is written: sampled vectors are asked as questions against all rows, by brute force and by the
cells in their order, and the least number of cells that reaches ``recall`` is stored.

``add`` deals new vectors to the cells that are there; nothing else is written again.
Vectors of another length than the first are refused; null ones and null keys are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.operators import retrieval
from corpusforge.operators.best import CELLS
from corpusforge.session import delete_folder, folder_exists, shared_folder

#: Centroids at most; sampled vectors for each centroid; sampled questions for the number of cells; and of codes to score again.
MAX_CELLS, SAMPLE, ASKED, RERANK = 1024, 64, 128, 100
#: Format of a stored index.
VERSION = "ivf.v2"
#: Scores that are this near may be equal when they are rounded.
NEAR = 2e-6


@dataclass
class AnnIndex:
    """cells (key, embedding, code, slack, same, cell), centroids (a row for each cell), step of the codes, and cells to read for a question."""

    cells: DataFrame
    centroids: np.ndarray
    step: float
    probes: int


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _nearest(own: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * (own @ centroids.T)).argmin(1)


def _learn(sample: DataFrame, vec: str, cells: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm over the sample: each task sums its vectors by centroid, and sums of sums come back (cells x (length + 1) numbers)."""
    spark = sample.sparkSession
    first = sample.orderBy(F.xxhash64(vec)).limit(cells).collect()
    centroids = np.array([r[vec] for r in first], np.float64)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centroids)

        def run(batches, held=held):
            sums = np.zeros((held.value.shape[0], held.value.shape[1] + 1))
            for batch in batches:
                if batch.num_rows:
                    own = _matrix(batch.column(0), batch.num_rows)
                    np.add.at(sums, _nearest(own, held.value), np.hstack([own, np.ones((len(own), 1))]))
            used = np.flatnonzero(sums[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["cell", "sums"])

        parts = sample.select(vec).mapInArrow(run, "cell int, sums array<double>").select("cell", F.posexplode("sums"))
        total = np.zeros((centroids.shape[0], centroids.shape[1] + 1))
        for r in parts.groupBy("cell", "pos").agg(F.sum("col").alias("value")).collect():
            total[r.cell, r.pos] = r.value
        centroids = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centroids)
        held.destroy()
    return centroids


def _dealt(vectors: DataFrame, centroids: np.ndarray, step: float, key: str, vec: str) -> DataFrame:
    """(key, embedding, code, slack, cell, same): slack is the distance of code and vector; equal vectors share a hash."""
    kind = vectors.schema[key].dataType.simpleString()
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = _matrix(batch.column(1), n)
            cell = _nearest(own, held.value)
            code = np.clip(np.rint((own - held.value[cell]) / step), -127, 127).astype(np.int8)
            whole = pa.array(list(own.astype(np.float32)), pa.list_(pa.float32()))
            slack = np.linalg.norm(own - (code * step + held.value[cell]), axis=1)
            columns = [batch.column(0), whole, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(slack), pa.array(cell, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "embedding", "code", "slack", "cell"])

    dealt = vectors.select(F.col(key).alias("key"), F.col(vec).alias("embedding")).mapInArrow(run, f"key {kind}, embedding array<float>, code binary, slack double, cell int")
    return dealt.withColumn("same", F.xxhash64("embedding"))


def _usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    return vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0))


def write_ann(vectors: DataFrame, path: str, key: str = "vec_id", vec: str = "embedding", cells: int | None = None, rounds: int = 6, recall: float = 0.97, top: int = 20) -> None:
    """Stores an index of all rows.  ``cells``: by default four times the root of their number, up to ``MAX_CELLS``."""
    spark = vectors.sparkSession
    rows = _usable(vectors, key, vec)
    count, least, most = rows.agg(F.count("*"), F.min(F.size(vec)), F.max(F.size(vec))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components can't share an index")
    cells = max(1, min(MAX_CELLS, count, cells or int(4 * count**0.5)))
    share = min(1.0, SAMPLE * cells / max(1, count))
    at = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) / (1 << 20)
    sampled = shared_folder(spark, f"ann-sample-{uuid.uuid4().hex}")
    rows.where(at < share).select(F.col(key).alias("key"), F.col(vec).alias("embedding")).write.parquet(sampled)
    sample = spark.read.parquet(sampled)
    if sample.limit(1).count() == 0:
        sample = rows.select(F.col(key).alias("key"), F.col(vec).alias("embedding"))
    centroids = _learn(sample, "embedding", cells, rounds) if count else np.zeros((0, most or 1))
    # A step covers nearly all of the sampled differences; the rest are clipped, which only a first ranking sees.
    step = _step(sample, centroids) if count else 1.0
    for part in ("facts", "cells"):
        delete_folder(spark, f"{path}/{part}")
    _put(_dealt(rows, centroids, step, key, vec), path)
    probes = _probes(spark, path, rows, sample, centroids, step, key, vec, recall, top) if count else 1
    facts = [(VERSION, len(centroids), float(step), probes, float(recall), count, c, [float(x) for x in v]) for c, v in enumerate(centroids)]
    schema = "version string, n_cells int, step double, probes int, recall double, vectors long, cell int, centroid array<double>"
    spark.createDataFrame(facts, schema).coalesce(1).write.mode("overwrite").parquet(path + "/facts")  # last: an index without it isn't whole
    delete_folder(spark, sampled)


def _put(dealt: DataFrame, path: str) -> None:
    dealt.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(path + "/cells")


def add(spark: SparkSession, path: str, vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> None:
    """More vectors, into the cells that are there."""
    index = load_ann(spark, path)
    _put(_dealt(_usable(vectors, key, vec), index.centroids, index.step, key, vec), path)


def _step(sample: DataFrame, centroids: np.ndarray) -> float:
    held = sample.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(0), batch.num_rows)
                far = np.abs(own - held.value[_nearest(own, held.value)]).max(1)
                yield pa.RecordBatch.from_arrays([pa.array(far)], ["far"])

    far = sample.select("embedding").mapInArrow(run, "far double").agg(F.percentile_approx("far", 0.99)).first()[0]
    return (far or 1.0) / 127


def load_ann(spark: SparkSession, path: str) -> AnnIndex:
    if not folder_exists(spark, path + "/facts"):
        raise retrieval.IndexUnavailable(path)
    facts = spark.read.parquet(path + "/facts").orderBy("cell").collect()  # MAX_CELLS rows at most
    if facts and facts[0].version != VERSION:
        raise retrieval.IndexMismatch(f"{path} is of format {facts[0].version}, not {VERSION}")
    centroids = np.array([r.centroid for r in facts], np.float64)
    return AnnIndex(spark.read.parquet(path + "/cells"), centroids, facts[0].step if facts else 1.0, facts[0].probes if facts else 1)


def _order(questions: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Cells of each question, those with the likeliest best vectors first: by the product with the centroid."""
    return np.argsort(-(questions @ centroids.T), axis=1, kind="stable")[:, :probes]


def _scan(index: AnnIndex, ids: list, questions: np.ndarray, chosen: np.ndarray, keep: int, kinds: str) -> DataFrame:
    """(qid, key, low, high, cell): of each task the codes that could be among the ``keep`` best of each question, in the cells
    chosen for it, with the bounds of their scores."""
    by_cell = {int(c): np.flatnonzero((chosen == c).any(1)) for c in np.unique(chosen)}
    held = index.cells.sparkSession.sparkContext.broadcast((ids, questions, by_cell, index.centroids, index.step))
    names = [f.split()[0] for f in kinds.split(", ")]

    def run(batches):
        ids, questions, by_cell, centroids, step = held.value
        far = np.linalg.norm(questions, axis=1)
        lows = np.full((len(ids), keep), -np.inf)  # the best lower bounds of each question so far
        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                rows = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(cells == cell)))]).sort_by([("same", "ascending"), ("key", "ascending")])
                same = rows.column("same").to_numpy()
                rows = rows.take(pa.array(np.flatnonzero(np.arange(len(same)) - np.searchsorted(same, same) < keep)))
                own = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1) * step + centroids[cell]
                slack, keys = rows.column("slack").to_numpy(), rows.column("key").combine_chunks()
                all_asked, size = by_cell[int(cell)], max(1, CELLS // rows.num_rows)
                for start in range(0, len(all_asked), size):
                    asked = all_asked[start : start + size]
                    near, wide = questions[asked] @ own.T, far[asked, None] * slack[None, :] + NEAR
                    low, high = near - wide, near + wide
                    lows[asked] = np.partition(np.hstack([lows[asked], low]), low.shape[1], axis=1)[:, low.shape[1] :]
                    q, d = np.nonzero(high >= lows[asked].min(1)[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(asked[q])), keys.take(pa.array(d)), pa.array(low[q, d]), pa.array(high[q, d]), pa.array(np.full(len(q), cell, np.int32))], names)

    return index.cells.where(F.col("cell").isin(list(by_cell))).select("key", "code", "cell", "slack", "same").mapInArrow(run, kinds)


def search(questions: DataFrame, index: AnnIndex, top: int = 20, probes: int | None = None, rerank: int = RERANK, qkey: str = "qid", qvec: str = "qvec", key: str = "vec_id") -> DataFrame:
    """(qid, key, ann_score, ann_rank, cells_read): the stated questions go to every task in blocks of about ``retrieval.BLOCK_BYTES``."""
    spark = questions.sparkSession
    probes = min(probes or index.probes, max(1, len(index.centroids)))
    asked = questions.select(qkey, qvec).where(F.col(qvec).isNotNull())
    size = asked.agg(F.sum(F.size(qvec) * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // retrieval.BLOCK_BYTES))
    kinds = f"{qkey} {questions.schema[qkey].dataType.simpleString()}, key {index.cells.schema['key'].dataType.simpleString()}, low double, high double, cell int"
    out, read = None, set()
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == block).collect()
        if not rows or not len(index.centroids):
            continue
        ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        chosen = _order(matrix, index.centroids, probes)
        read |= {int(c) for c in np.unique(chosen)}
        found = _scan(index, ids, matrix, chosen, max(rerank, top), kinds)
        place = F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("low")))
        limit = F.max(F.when(F.col("place") == max(rerank, top), F.col("low"))).over(Window.partitionBy(qkey))
        found = found.withColumn("place", place).withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("high") >= F.col("limit"))).select(qkey, "key", "cell")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"{kinds.split(', ')[0]}, {key} {index.cells.schema['key'].dataType.simpleString()}, ann_score double, ann_rank int, cells_read int")
    # The few candidates meet the whole vectors of their own cells.
    whole = index.cells.where(F.col("cell").isin(sorted(read))).select("cell", "key", "embedding")
    exact = out.join(whole, ["cell", "key"]).join(asked, qkey)
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), retrieval.cosine(F.col("embedding"), F.col(qvec)))), 6)
    best = retrieval.ranked(exact.select(qkey, F.col("key").alias(key), score.alias("ann_score")), qkey, "ann_score", key, "ann_rank", top)
    return best.withColumn("cells_read", F.lit(probes))


def recall(found: DataFrame, exact: DataFrame, qkey: str = "qid", key: str = "vec_id", score: str = "dense_score") -> DataFrame:
    """(qid, wanted, found, recall): how many of the exact hits were found.  A hit that only ties with the last exact one counts."""
    last = exact.groupBy(qkey).agg(F.count("*").alias("wanted"), F.min(score).alias("last"))
    got = found.join(last.select(qkey, "last"), qkey).where(F.col("ann_score") >= F.col("last")).groupBy(qkey).agg(F.count("*").alias("found"))
    rows = last.join(got, qkey, "left").select(qkey, "wanted", F.least("wanted", F.coalesce("found", F.lit(0))).alias("found"))
    return rows.withColumn("recall", F.col("found") / F.col("wanted"))


def _probes(spark: SparkSession, path: str, rows: DataFrame, sample: DataFrame, centroids: np.ndarray, step: float, key: str, vec: str, wanted: float, top: int) -> int:
    """The least number of cells with which ASKED sampled vectors, as questions, find that share of their exact hits."""
    asked = sample.orderBy(F.xxhash64(F.lit("asked"), "key")).limit(ASKED).select(F.col("key").cast("string").alias("qid"), F.col("embedding").alias("qvec"))
    exact = retrieval.dense(asked, rows, top, "qid", "qvec", key, vec)
    cells = spark.read.parquet(path + "/cells").select(F.col("key").alias(key), "cell")
    hits = exact.join(cells, key).select("qid", "cell").collect()  # ASKED x top rows
    questions = {r.qid: r.qvec for r in asked.collect()}
    ids = list(questions)
    order = _order(np.array([questions[i] for i in ids], np.float64), centroids, len(centroids))
    place = {i: {int(c): p for p, c in enumerate(row)} for i, row in zip(ids, order)}
    needed = np.sort([place[r.qid][r.cell] + 1 for r in hits])
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)]) if len(needed) else len(centroids)
