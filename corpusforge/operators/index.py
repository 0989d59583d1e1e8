"""The index of a corpus as a whole: chunks, vectors, BM25 tables and manifest; built, probed, and built where it is missing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.text import content_hash
from corpusforge.operators import chunking, ingest, pages, retrieval, segments
from corpusforge.session import delete_folder, shared_folder
from corpusforge.sources import versions

CEILING, DIM, MODEL = 256, 384, "sha256"


class DeploymentError(Exception):
    """There is no index and none can be built."""


def build(
    spark: SparkSession, source: DataFrame, path: str, reindex: bool = False, drop_return_heavy: bool = False, min_chars: int = 1500, size: int = 200, overlap: int = 40, embed=ingest.embed_each
) -> dict[str, int]:
    """Pages (page_id, html and any provenance) to an index; how many pages met each action.

    Unchanged pages are skipped, thin ones fail and leave what is there, others are replaced, and pages
    that left the table are purged.  Only chunks of new and replaced pages are embedded, and they make one
    segment of the BM25 index; all of it is made anew if it is missing or doesn't cover the chunks.

    Chunks, vectors, BM25 index and manifest are each written beside their last version.  One commit of the
    index then names the four, and only after it the older versions are deleted: whoever opens the index sees
    the run as a whole or not at all, and a run that broke off is done again by the next one."""
    source = source.withColumn("page_id", F.col("page_id").cast("string"))
    blocks = pages.parse_pages(source).persist()
    flat = source.select("page_id").join(pages.flat_text(blocks), "page_id", "left").withColumn("flat_text", F.coalesce("flat_text", F.lit("")))
    current = flat.select("page_id", content_hash(F.col("flat_text")).alias("content_hash"), (F.length("flat_text") < min_chars).alias("failed"))
    was = state(spark, path)
    moved = _moved(spark, path, was)
    have = ingest.index_present(spark, path)
    chunks_before = ingest.read_chunks(spark, path) if have else None
    none = current.select("page_id", "content_hash").limit(0)
    old = ingest.read_manifest(spark, path + "-manifest", was.get("manifest")) if have else None
    old = none if old is None else old
    present = chunks_before.select("page_id").distinct() if have else none.select("page_id")
    # What failed keeps the hash it was indexed with.  The plan is written, as what it was made from changes below.
    todo = ingest.plan(current, old, present, reindex).join(current, "page_id", "left").join(old.withColumnRenamed("content_hash", "old_hash"), "page_id", "left")
    plan_path = shared_folder(spark, f"plan-{uuid.uuid4().hex}")
    todo.select("page_id", "action", F.when(F.col("action") == "failed", F.col("old_hash")).otherwise(F.col("content_hash")).alias("content_hash")).write.parquet(plan_path)
    todo = spark.read.parquet(plan_path)
    actions = {r.action: r["count"] for r in todo.groupBy("action").count().collect()}
    fresh, gone = todo.where("action in ('new', 'replace')").select("page_id"), todo.where("action in ('replace', 'purge')").select("page_id")
    chunks = chunking.chunk_blocks(blocks.join(fresh, "page_id"), source.join(fresh, "page_id"), size, overlap, drop_return_heavy)
    now = {"chunks": ingest.write_index(ingest.check_fits(chunks, CEILING), path, gone, tidy=False)}
    blocks.unpersist()
    whole = ingest.read_chunks(spark, path, now["chunks"])
    if have or ingest.index_present(spark, path):
        own = whole.join(fresh, "page_id", "left_semi")
        now["vectors"] = _vectors(spark, path + "-vectors", whole, own, gone, moved, embed)
        now["bm25"] = _bm25(spark, path + "-bm25", whole, own, None if moved else chunks_before, gone, actions)
        now["manifest"] = ingest.write_manifest(spark, whole, todo.where("action != 'purge'"), path + "-manifest", False, embedding_model=MODEL, embedding_dim=DIM, chunk_size=size, chunk_overlap=overlap)
        versions.commit(spark, path + "-index", now)
        _tidy(spark, path, now)
    delete_folder(spark, plan_path)
    return actions


def state(spark: SparkSession, path: str) -> dict[str, int]:
    """Which commits of its parts the index consists of; nothing if it isn't there."""
    return versions.state(spark, path + "-index") or {}


def _moved(spark: SparkSession, path: str, was: dict[str, int]) -> bool:
    """Whether a part has another commit than the index names: a run broke off, or chunks were written by themselves."""
    ends = {"chunks": "", "vectors": "-vectors", "manifest": "-manifest", "bm25": "-bm25"}
    return any((versions.state(spark, path + end) or {}).get("number") != was.get(part) for part, end in ends.items())


def _vectors(spark: SparkSession, path: str, whole: DataFrame, own: DataFrame, gone: DataFrame, moved: bool, embed) -> int:
    if not ingest.index_present(spark, path):
        own = whole
    elif moved:
        gone = gone.unionAll(versions.read(spark, path).select("page_id").distinct().join(whole, "page_id", "left_anti"))
    number = ingest.write_index(ingest.hash_embed(own, DIM, "chunk_id", embed=embed, keep=["page_id"]), path, gone, tidy=False)
    ingest.check_dim(versions.read(spark, path, number), DIM)
    return number


def _bm25(spark: SparkSession, path: str, whole: DataFrame, own: DataFrame, before: DataFrame | None, gone: DataFrame, actions: dict[str, int]) -> int:
    held = (versions.state(spark, path) or {}).get("number", 0)
    try:
        if before is None:
            raise retrieval.IndexUnavailable(path)
        retrieval.load_bm25(spark, path, documents=before.count())
        if {"new", "replace", "purge"} & actions.keys():
            left = before.join(gone, "page_id", "left_semi").select("chunk_id")
            segments.update(own, left, path, "chunk_id", "text", retrieval.TOKENIZER, keep=(held,))
    except (retrieval.IndexUnavailable, retrieval.IndexMismatch):
        segments.write(whole, path, "chunk_id", "text", retrieval.TOKENIZER, keep=(held,))
    return versions.state(spark, path)["number"]


def _tidy(spark: SparkSession, path: str, now: dict[str, int]) -> None:
    for end in ("", "-vectors", "-manifest"):
        versions.clean(spark, path + end)
    segments.clean(spark, path + "-bm25")
    versions.clean(spark, path + "-index")


def missing_parts(spark: SparkSession, path: str) -> list[str]:
    """What an index lacks, by its commits alone: nothing of it is read."""
    now = state(spark, path)
    there = {
        "chunks": ingest.index_present(spark, path, now.get("chunks")),
        "vectors": ingest.index_present(spark, path + "-vectors", now.get("vectors")),
        "BM25 tables": versions.state(spark, path + "-bm25", now.get("bm25")) is not None,
    }
    return [part for part, found in there.items() if not found]


def ensure(spark: SparkSession, source: str, path: str, **settings) -> dict[str, int]:
    """Builds the index from the pages in ``source`` if a part of it is missing; the actions taken, none if it is whole.

    Whatever keeps it from being whole is one kind of error, as an empty index would pass for a corpus
    without answers: a build that breaks off, pages that fail, no chunk, or parts that are still missing."""
    missing = missing_parts(spark, path)
    if not missing:
        return {}
    lacks = f"the index lacks {', '.join(missing)}"
    try:
        # Vectors and BM25 tables follow the chunks; without one of them all pages are done again.
        actions = build(spark, spark.read.parquet(source), path, reindex=True, **settings)
    except Exception as error:
        raise DeploymentError(f"{lacks}, and building it from {source} broke off: {type(error).__name__}: {error}") from error
    if actions.get("failed"):
        raise DeploymentError(f"{lacks}, and {actions['failed']} pages of {source} failed")
    if not ingest.index_present(spark, path):
        raise DeploymentError(f"{lacks}, and {source} gives no chunk")
    if still := missing_parts(spark, path):
        raise DeploymentError(f"{lacks}, and after a build still {', '.join(still)}: {path} may not be writable")
    return actions


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, retrieval.Bm25Index]:
    """Chunks (doc_id, source, source_url, scheme, text), vectors (vec_id, embedding) and BM25 index, as answers.answer takes them: of one run."""
    now = state(spark, path)
    chunks = ingest.read_chunks(spark, path, now.get("chunks")).select(F.col("chunk_id").alias("doc_id"), F.col("page_id").alias("source"), "source_url", "scheme", "text")
    vectors = versions.read(spark, path + "-vectors", now.get("vectors")).select(F.col("chunk_id").alias("vec_id"), "embedding")
    return chunks, vectors, retrieval.load_bm25(spark, path + "-bm25", chunks.count(), now.get("bm25"))
