"""Idempotent ingest: plan, upsert, purge, manifest, embeddings."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from corpusforge.operators.chunking import PROVENANCE
from corpusforge.session import delete_folder, shared_folder
from corpusforge.sources import versions


def plan(current: DataFrame, manifest: DataFrame, present: DataFrame, reindex: bool = False) -> DataFrame:
    """(page_id, action): skip only what has the manifest's hash and is in the index; replace what is there; purge what left the corpus.

    current: (page_id, content_hash), and failed where pages may fail: these are left as they are;
    manifest: the same, from the run before; present: (page_id)."""
    before = manifest.select("page_id", F.col("content_hash").alias("old_hash"))
    there = present.select("page_id").distinct().withColumn("there", F.lit(True))
    failed = F.col("failed") if "failed" in current.columns else F.lit(False)
    rows = current.select("page_id", "content_hash", failed.alias("failed"), F.lit(True).alias("wanted")).join(before, "page_id", "left").join(there, "page_id", "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("there").isNotNull() & F.lit(not reindex)
    action = F.when(F.col("wanted").isNull(), "purge").when(F.col("failed"), "failed").when(same, "skip").when(F.col("there").isNotNull(), "replace").otherwise("new")
    return rows.select("page_id", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_page(chunks: DataFrame, page) -> DataFrame:
    return chunks.where(~F.col("page_id").eqNullSafe(F.lit(page)))


def orphans(present: DataFrame, corpus: DataFrame) -> DataFrame:
    return present.select("page_id").distinct().join(corpus.select("page_id"), "page_id", "left_anti")


def manifest(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, chunks, content_hash) for every page of the index."""
    return chunks.groupBy("page_id").agg(F.count("*").alias("chunks")).join(pages.select("page_id", "content_hash"), "page_id", "left")


def write_index(chunks: DataFrame, path: str, gone: DataFrame | None = None, tidy: bool = True) -> int:
    """The pages in ``chunks`` take the place of their older versions, pages in the one column of ``gone`` leave, the others stay.

    Pages lie in a fixed number of buckets; readers see the run when it is whole.  The commit's number.  ``tidy``: older versions are
    deleted at once."""
    spark = chunks.sparkSession
    staged = shared_folder(spark, f"chunks-{uuid.uuid4().hex}")
    chunks.write.parquet(staged)
    number = versions.replace(spark, path, spark.read.schema(chunks.schema).parquet(staged), gone)
    delete_folder(spark, staged)
    if tidy:
        versions.clean(spark, path)
    return number


def purge_pages(spark: SparkSession, path: str, gone: DataFrame, tidy: bool = True) -> int:
    """Takes these pages out; how many there were."""
    there = versions.read(spark, path)
    if there is None:
        return 0
    pages = gone.toDF("page_id").select(F.col("page_id").cast("string"))
    count = there.select(F.col("page_id").cast("string").alias("page_id")).distinct().join(pages, "page_id", "left_semi").count()
    if count:
        versions.replace(spark, path, there.limit(0), pages)
        if tidy:
            versions.clean(spark, path)
    return count


def read_chunks(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The index's chunks, of one commit if told; rows without metadata are left out."""
    rows = versions.read(spark, path, number)
    if rows is None:
        raise FileNotFoundError(f"there is no index at {path}")
    return rows.where("chunk_id is not null and text is not null")


def write_manifest(spark: SparkSession, chunks: DataFrame, pages: DataFrame, path: str, tidy: bool = True, **facts) -> int:
    """One row for each page of the index (with the page's provenance), and one with what holds for all.  The commit's number."""
    rows = manifest(chunks, pages).join(chunks.groupBy("page_id").agg(*(F.max(c).alias(c) for c in PROVENANCE)), "page_id", "left")
    number = versions.overwrite(spark, path, rows)
    known = {"embedding_model": "", "embedding_dim": 0, "chunk_size": 0, "chunk_overlap": 0} | facts
    total = versions.read(spark, path, number).agg(F.count("*").alias("pages"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.current_timestamp().alias("generated_at"))
    total.select("*", *(F.lit(v).alias(k) for k, v in known.items())).write.mode("overwrite").json(path + "-facts")
    if tidy:
        versions.clean(spark, path)
    return number


def read_manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The manifest's pages; one that can't be read counts as absent."""
    try:
        rows = versions.read(spark, path, number).select("page_id", "content_hash")
        rows.limit(1).count()
        return rows
    except Exception:
        return None


def index_present(spark: SparkSession, path: str, number: int | None = None) -> bool:
    """Whether an index has pages there; asked of the path's own file system."""
    now = versions.state(spark, path, number)
    return bool(now and now["buckets"])


def vector_of(text: str, dim: int) -> np.ndarray:
    """A unit vector from a text's SHA-256: reproducible, without a model."""
    raw = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8) / 255
    v = np.resize(raw, dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embed_each(texts: list[str], dim: int) -> list[np.ndarray]:
    return [vector_of(t, dim) for t in texts]


def hash_embed(rows: DataFrame, dim: int = 384, key: str = "doc_id", text: str = "text", embed=embed_each, batch_size: int = 32, keep: Sequence[str] = ()) -> DataFrame:
    """(key, embedding, and the columns to keep); ``embed`` may be any function of (texts, dim) and gets ``batch_size`` texts at a time."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch_size) for v in embed(texts[i : i + batch_size], dim)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), *batch.columns[2:]], [key, "embedding", *keep])

    fields = [rows.schema[key], StructField("embedding", ArrayType(FloatType())), *(rows.schema[c] for c in keep)]
    return rows.select(key, text, *keep).mapInArrow(run, StructType(fields))


def check_fits(chunks: DataFrame, ceiling: int, tokens: str = "token_count") -> DataFrame:
    """The chunks; reading them fails if one is over the embedder's ceiling."""
    fits = F.assert_true(F.col(tokens) <= ceiling, F.concat(F.lit("chunk over the token ceiling: "), F.col("chunk_id")))
    return chunks.where(fits.isNull())


def check_dim(vectors: DataFrame, expected: int, vec: str = "embedding") -> None:
    found = [r[0] for r in vectors.select(F.size(vec).alias("n")).distinct().limit(2).collect()]
    if found and found != [expected]:
        raise ValueError(f"the index holds vectors of {sorted(found)} dimensions, not {expected}")
