"""Index quality: facts, return density, duplicates, boilerplate, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import vocabulary as V
from corpusforge.functions.text import _pieces
from corpusforge.operators.retrieval import norm


def fact_coverage(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, *(F.col(text).rlike("(?i)" + p).alias(n) for n, p in V.FACTS))


def fact_snippets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fact, snippet): 60 characters before each fact's first place and 100 after it."""
    # The bounded run before a fact is tried at every place, so only texts that hold the fact pay for it.
    snippet = lambda p: F.when(F.col(text).rlike(f"(?i)(?:{p})"), F.regexp_extract(F.col(text), f"(?is)(.{{0,60}}(?:{p}).{{0,100}})", 1))
    found = F.array(*(F.struct(F.lit(n).alias("fact"), snippet(p).alias("snippet")) for n, p in V.FACTS))
    rows = docs.select(key, F.explode(found).alias("f")).select(key, "f.fact", F.trim(F.regexp_replace("f.snippet", r"\s+", " ")).alias("snippet"))
    return rows.where("snippet != ''")


def perf_density(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    parts = _pieces(F.col(text), r"(?<=[.!?])\s+")
    rows = docs.select(key, parts.alias("parts"))
    hits = F.size(F.filter("parts", lambda s: s.rlike("(?i)" + V.PERF_SENTENCE)))
    return rows.select(key, F.size("parts").alias("sentences"), hits.alias("hits"), F.round(F.try_divide(hits, F.size("parts")), 6).alias("density"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, first_id, copies): groups of equal trimmed texts; hashes move, not texts."""
    rows = docs.select(key, F.sha2(F.trim(text), 256).alias("h"))
    return rows.groupBy("h").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def boilerplate(blocks: DataFrame, page: str, text: str = "text", pages_min: int = 2) -> DataFrame:
    """(body, pages, copies): normalised bodies on several pages; a leading ``... (...)`` prefix is no part of a body."""
    body = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"^[^()]*\([^)]*\)", ""), r"\s+", " ")))
    rows = blocks.select(page, body.alias("body")).where("body != ''").groupBy("body", page).agg(F.count("*").alias("own"))
    return rows.groupBy("body").agg(F.count("*").alias("pages"), F.sum("own").alias("copies")).where(F.col("pages") >= pages_min)


def chunk_integrity(chunks: DataFrame) -> DataFrame:
    """One row: chunks, those without text, those whose source_url is no http link, and redundant copies of a text."""
    bad_url = ~F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False))
    hashes = chunks.select(F.sha2(F.trim("text"), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))
    counted = chunks.agg(F.count("*").alias("chunks"), F.count_if(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("empty"), F.count_if(bad_url).alias("bad_urls"))
    return counted.crossJoin(hashes)


def dump(chunks: DataFrame, only: str | None = None, most: int | None = None, flags: bool = True) -> DataFrame:
    """Chunks in page order for reading: of one page only, at most so many of a page (a report limit), with their flags."""
    rows = chunks.where(F.col("page_id") == only) if only is not None else chunks
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("chunk_id"))
    rows = rows.withColumn("place", place)
    if most is not None:
        rows = rows.where(F.col("place") <= most)
    shown = [c for c in ("return_heavy", "token_count", "section") if flags and c in rows.columns]
    return rows.select("page_id", "place", "chunk_id", F.length("text").alias("chars"), *shown)


def dump_vectors(vectors: DataFrame, decimals: int = 6, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, dim, norm, vector): components rounded, as one text with commas."""
    text = F.array_join(F.transform(vec, lambda x: F.format_string(f"%.{decimals}f", x.cast("double"))), ",")
    return vectors.select(key, F.size(vec).alias("dim"), F.round(norm(F.col(vec)), decimals).alias("norm"), text.alias("vector"))


def integrity(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: dimensions, norms, and whether all is well."""
    rows = vectors.select(F.size(vec).alias("dim"), norm(F.col(vec)).alias("norm"))
    return rows.agg(
        F.count("*").alias("rows"), F.countDistinct("dim").alias("dims"), F.min("dim").alias("dim"), F.round(F.min("norm"), 4).alias("norm_min"), F.round(F.max("norm"), 4).alias("norm_max"),
        F.round(F.avg("norm"), 4).alias("norm_mean"), F.count_if(~F.col("norm").between(0.99, 1.01)).alias("bad_norms"),
    )
