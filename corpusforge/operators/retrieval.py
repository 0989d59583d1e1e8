"""Sparse and dense retrieval for many questions at once, fusion and gate."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.operators import segments
from corpusforge.operators.best import CELLS, Best
from corpusforge.operators.segments import Bm25Index, IndexMismatch, IndexUnavailable  # noqa: F401
from corpusforge.session import shared_folder

RRF_K, NO_MATCH = 60, -1.0
#: Bytes of question vectors that are sent to every task at a time.
BLOCK_BYTES = 16 << 20


def ranked(scores: DataFrame, group: str, score: str, key: str, rank: str, limit: int | None = None) -> DataFrame:
    """Adds the position by score, ties by key; keeps the first ``limit``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(key)))
    out = scores.withColumn(rank, place)
    return out if limit is None else out.where(F.col(rank) <= limit)


#: Of the stored index: changes whenever ``tokenize`` does.
TOKENIZER = "words.v1"


def write_bm25(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Stores the index of all of docs as one segment, in place of what is there."""
    segments.write(docs, path, key, text, TOKENIZER)


def update_bm25(docs: DataFrame, gone: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Adds new and changed documents, and takes out the keys in the one column of ``gone``: one segment is written."""
    segments.update(docs, gone, path, key, text, TOKENIZER)


def load_bm25(spark: SparkSession, path: str, documents: int | None = None, number: int | None = None) -> Bm25Index:
    """A stored index; ``documents``: how many it has to cover; ``number``: of which commit, the last by default."""
    return segments.load(spark, path, TOKENIZER, documents, number)


def bm25_search(questions: DataFrame, index: Bm25Index, top: int = 20, qkey: str = "qid", qtext: str = "question", key: str = "doc_id") -> DataFrame:
    """(qid, key, sparse_score, sparse_rank): positive scores only, ties by key.

    A term asked twice counts twice.  Scores that differ by less than 1e-9, the noise of adding in another order, tie."""
    found = segments.scores(questions, index, top, qkey, qtext).where("key is not null").select(qkey, F.col("key").alias(key), "raw")
    return ranked(found, qkey, "raw", key, "sparse_rank", top).select(qkey, key, F.round("raw", 5).alias("sparse_score"), "sparse_rank")


def bm25_work(questions: DataFrame, index: Bm25Index, top: int = 20, qkey: str = "qid", qtext: str = "question") -> DataFrame:
    """(qid, blocks, blocks_scored): of each question with a known term, how many blocks of its terms there are, and how many were scored."""
    rows = segments.scores(questions, index, top, qkey, qtext).where("key is null")
    return rows.groupBy(qkey).agg(F.sum("met").alias("blocks"), F.sum("scored").alias("blocks_scored"))


def bm25(questions: DataFrame, docs: DataFrame, top: int = 20, qkey: str = "qid", qtext: str = "question", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same over documents without a stored index, for a corpus that is asked once."""
    return bm25_search(questions, segments.in_memory(docs, key, text), top, qkey, qtext, key)


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision; of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(cosine(a, a))


def dense(questions: DataFrame, vectors: DataFrame, top: int = 20, qkey: str = "qid", qvec: str = "qvec", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(qid, key, dense_score, dense_rank): exact cosine search.

    The stated questions go to every task in blocks of about ``BLOCK_BYTES``, one pass over the
    vectors for each; each task multiplies its vectors with the block, ``CELLS`` products at a time,
    and passes on at most ``top`` rows for each question.  With more than one block each pass is written and its
    block released before the next one is fetched."""
    spark = questions.sparkSession
    asked = questions.select(qkey, qvec).where(F.col(qvec).isNotNull())
    size = asked.agg(F.sum(F.size(qvec) * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    kinds = f"{qkey} {questions.schema[qkey].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, dense_score double"
    folder, out = shared_folder(spark, f"dense-{uuid.uuid4().hex}"), []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))

        def run(batches, held=held):
            ids, matrix = held.value
            best = Best(len(ids), top)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.array(batch.column(vec).to_pylist(), np.float64)
                keys = np.array(batch.column(key).to_pylist())
                step = max(1, CELLS // len(own))
                for start in range(0, len(ids), step):
                    scores = matrix[start : start + step] @ own.T
                    q, d = best.reaching(np.clip(scores, -1, 1, out=scores), np.arange(start, start + len(scores)), np.full(len(scores), 1e-6))
                    best.add(q + start, keys[d], np.round(scores[q, d], 6))
            best.settle()
            for q, keys, scores in best.found:
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(keys), pa.array(scores)], [qkey, key, "dense_score"])

        one = vectors.select(key, vec).where(F.col(vec).isNotNull()).mapInArrow(run, kinds)
        if blocks > 1:
            path = f"{folder}/{block}"
            one.write.mode("overwrite").parquet(path)
            one = spark.read.schema(one.schema).parquet(path)
            held.destroy()
        out.append(one)
    found = reduce(DataFrame.union, out) if out else spark.createDataFrame([], kinds)
    return ranked(found, qkey, "dense_score", key, "dense_rank", top)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, resolved: DataFrame, top: int = 5, k: int = RRF_K, penalty: float = 0.85, qkey: str = "qid", key: str = "chunk_id") -> DataFrame:
    """(qid, chunk_id, dense_score, sparse_score, fused_rank): reciprocal rank fusion.

    ``resolved``: (chunk_id, return_heavy) and, for hits of the sparse leg alone, a column
    ``exact`` if their cosine is known.  The penalty lowers return-heavy chunks; the fused
    score itself isn't part of the result."""
    both = dense_hits.join(sparse_hits, [qkey, key], "full_outer").join(resolved, key if "exact" not in resolved.columns else [qkey, key], "left")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    held = F.lit(min(1.0, max(0.0, penalty)))
    score = F.round((part("dense_rank") + part("sparse_rank")) * F.when(F.coalesce("return_heavy", F.lit(False)), held).otherwise(1.0), 9)
    exact = F.col("exact") if "exact" in resolved.columns else F.lit(None).cast("double")
    rows = both.select(qkey, key, F.coalesce("dense_score", exact, F.lit(NO_MATCH)).alias("dense_score"), "sparse_score", score.alias("score"))
    return ranked(rows, qkey, "score", key, "fused_rank", top).drop("score")


def gate(questions: DataFrame, candidates: DataFrame, dense_hits: DataFrame, threshold: float | None, qkey: str = "qid") -> DataFrame:
    """(qid, found_answer, reason, raw_dense_max, candidates_considered): only the raw dense maximum is held against the threshold."""
    if threshold is None:
        raise ValueError("the similarity threshold isn't calibrated")
    best = dense_hits.groupBy(qkey).agg(F.max("dense_score").alias("top"))
    count = candidates.groupBy(qkey).agg(F.count("*").alias("n"))
    rows = questions.select(qkey).join(best, qkey, "left").join(count, qkey, "left")
    top, n = F.coalesce("top", F.lit(NO_MATCH)), F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "no_candidates").when(top < threshold, "below_threshold").otherwise("ok")
    return rows.select(qkey, (reason == "ok").alias("found_answer"), reason.alias("reason"), top.alias("raw_dense_max"), n.cast("long").alias("candidates_considered"))
