"""Hybrid search as one operator: both legs, exact cosines, fusion, gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import chunking, retrieval


@dataclass
class Found:
    """dense (qid, chunk_id, dense_score, dense_rank), sparse (qid, chunk_id, sparse_score, sparse_rank), fused candidates."""

    dense: DataFrame
    sparse: DataFrame
    fused: DataFrame


def exact_scores(questions: DataFrame, vectors: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, vec_id, score): the cosine of each question's vector with the vectors of its hits (qid, vec_id)."""
    rows = hits.join(vectors, "vec_id").join(questions.select("qid", "qvec"), "qid")
    return rows.select("qid", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("qvec")), 6).alias("score"))


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, index: retrieval.Bm25Index, top: int = 5, legs: int = 20, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Found:
    """Without a gate.  questions (qid, question, qvec), chunks (doc_id, text), vectors (vec_id, embedding).  ``keep`` may store the legs
    and the candidates, where several branches will read them.

    Hits of the sparse leg alone get their cosine from their own vectors; whether a chunk is mostly returns is asked of candidates alone."""
    dense = keep(retrieval.dense(questions, vectors, legs).withColumnRenamed("vec_id", "chunk_id"))
    hits = keep(retrieval.bm25_search(questions, index, legs))
    sparse = hits.withColumnRenamed("doc_id", "chunk_id")
    exact = exact_scores(questions, vectors, hits.select("qid", F.col("doc_id").alias("vec_id"))).select("qid", F.col("vec_id").alias("chunk_id"), F.col("score").alias("exact"))
    both = dense.select("qid", "chunk_id").union(sparse.select("qid", "chunk_id")).distinct()
    texts = chunks.select(F.col("doc_id").alias("chunk_id"), "text").join(both.select("chunk_id").distinct(), "chunk_id", "left_semi")
    heavy = texts.select("chunk_id", chunking.return_heavy(F.col("text")).alias("return_heavy"))
    resolved = both.join(exact, ["qid", "chunk_id"], "left").join(heavy, "chunk_id", "left")
    return Found(dense, sparse, keep(retrieval.fuse(dense, sparse, resolved, top)))


def search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, index: retrieval.Bm25Index, threshold: float | None, top: int = 5, legs: int = 20, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[Found, DataFrame]:
    """The same with each question's gate decision."""
    found = retrieve(questions, chunks, vectors, index, top, legs, keep)
    return found, retrieval.gate(questions, found.fused, found.dense, threshold)
