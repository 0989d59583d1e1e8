"""Corpus definition, link map, question sets and probes: read with explicit schemas and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.sources import http, page_source

CORPUS = "page_id string, scheme string, category string, source_url string"
QUESTION_SET = "id string, question string, answerable boolean, intent string, expected_source string, expected_facts array<string>, note string"
PROBES = "id string, question string, expect string, note string"
CALIBRATION = "similarity_threshold double, selection_rule string, feasible boolean, rationale string"


def url_ok(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^\s]+$"), F.lit(False))


def violations(corpus: DataFrame, key: str = "page_id", url: str = "source_url") -> DataFrame:
    """(key, problem): missing keys, repeated keys, bad links."""
    bad_url = corpus.where(~url_ok(F.col(url))).select(F.col(key).cast("string").alias("key"), F.lit("url").alias("problem"))
    repeated = corpus.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).cast("string").alias("key"), F.lit("repeated").alias("problem"))
    missing = corpus.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).select(F.lit(None).cast("string").alias("key"), F.lit("missing").alias("problem"))
    return bad_url.unionByName(repeated).unionByName(missing)


def load_corpus(spark: SparkSession, path: str, min_extract_chars: int | None = None) -> DataFrame:
    """Pages from JSON lines; raises if they break a rule, or if they state another minimum than the settings do."""
    pages = spark.read.schema(CORPUS + ", min_extract_chars int").option("mode", "FAILFAST").json(path)
    bad = violations(pages).limit(5).collect()
    if bad or pages.isEmpty():
        raise ValueError(f"the corpus definition is empty or breaks rules: {[tuple(r) for r in bad]}")
    stated = [r[0] for r in pages.select("min_extract_chars").where("min_extract_chars is not null").distinct().limit(2).collect()]
    if min_extract_chars is not None and any(x != min_extract_chars for x in stated):
        raise ValueError(f"the corpus definition wants {stated} characters of a page, the settings {min_extract_chars}")
    return pages.drop("min_extract_chars")


def load_questions(spark: SparkSession, path: str, composition: dict[str, int] | None = None) -> DataFrame:
    """The question set; ``composition`` gives the wanted number of rows by intent."""
    rows = spark.read.schema(QUESTION_SET).option("mode", "FAILFAST").json(path)
    if composition is not None:
        found = {r["intent"]: r["n"] for r in by_intent(rows).collect()}
        if found != composition or rows.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError(f"the question set has {found}, or repeated ids; wanted {composition}")
    return rows


def by_intent(rows: DataFrame) -> DataFrame:
    return rows.groupBy("intent").agg(F.count("*").alias("n"))


def load_probes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PROBES).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError("there are no probes")
    return rows


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1))


def allowed(url: Column, suffixes: list[str]) -> Column:
    """Whether a link's host is one of the suffixes or below one."""
    test = F.lit(False)
    for s in suffixes:
        test = test | (host(url) == s) | host(url).endswith("." + s)
    return test


def link_for(intents: DataFrame, links: DataFrame, default: str = "default") -> DataFrame:
    """Adds url and title of the intent's verified link, or of the default one."""
    good = links.where("url is not null and verified_by is not null and verified_on is not null").select("intent", "url", "title")
    # One link each, the first by url, should there be several.
    good = good.groupBy("intent").agg(F.min(F.struct("url", "title")).alias("own"))
    fallback = good.where(F.col("intent") == default).agg(F.min("own").alias("other"))
    own = intents.join(good, "intent", "left").crossJoin(F.broadcast(fallback))
    return own.withColumn("link", F.coalesce("own", "other")).select("*", "link.url", "link.title").drop("own", "other", "link")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, fetched_at, bytes, html) of fetched page files; empty files count as missing, bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", F.col("modificationTime").alias("fetched_at"), F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def cached_or_fetched(spark: SparkSession, corpus: DataFrame, path: str | None, get=None, refresh: bool = False, **settings) -> DataFrame:
    """(page_id, html, fetched_at, from_cache, error) of every page: from a file ``<page_id>.html`` under path if there is one
    and nothing is refreshed, else over HTTP: by the page source, or by ``get`` where one is given."""
    kind = "page_id string, html string, fetched_at timestamp"
    files = raw_pages(spark, path) if path and not refresh else None
    cached = spark.createDataFrame([], kind) if files is None else files.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("page_id"), "html", "fetched_at").where("page_id != ''")
    have = corpus.join(cached, "page_id").select("page_id", "html", "fetched_at", F.lit(True).alias("from_cache"), F.lit(None).cast("string").alias("error"))
    missing = corpus.join(cached, "page_id", "left_anti")
    if get is None:
        fetched = page_source.fetched(spark, missing, **settings).select("page_id", "html", "fetched_at", F.lit(False).alias("from_cache"), "error")
    else:
        fetched = http.fetch(missing, open=get).select("page_id", "html", F.current_timestamp().alias("fetched_at"), F.lit(False).alias("from_cache"), "error")
    return have.unionByName(fetched)


def storage_paths(paths: list[str], suffixes: tuple[str, ...] = (".parquet", ".json", ".jsonl", ".log", ".txt")) -> list[str]:
    """Of stored files, those in which personal data would be looked for."""
    return sorted(p for p in paths if p.lower().endswith(suffixes))


def threshold(env: str | None, calibration: DataFrame | None) -> float:
    """The similarity threshold: from the environment, else from the calibration, else an error."""
    if env:
        return float(env)
    row = calibration.select("similarity_threshold").first() if calibration is not None else None
    if row is None or row[0] is None:
        raise ValueError("the similarity threshold isn't calibrated")
    return float(row[0])


def write_calibration(decision: DataFrame, path: str) -> None:
    decision.coalesce(1).write.mode("overwrite").json(path)


def source_list(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    return corpus.join(manifest, "page_id", "left")


def markdown_table(rows: DataFrame) -> str:
    """The rows as a Markdown table; for reports, as all of them reach the driver."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *rows.collect()]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
