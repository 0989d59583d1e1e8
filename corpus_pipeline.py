"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row the one before it kept.  All
but the last return the columns of docs.  ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again, so that a lost executor costs one stage's tasks at most;
what a stage read is deleted when its own rows are written.

Edges, for all stages: an empty table stays empty; a null text counts as an empty one, and
language identification drops both; documents with a null doc_id are linked with nothing and
are judged by their text alone; other columns pass through, whatever their names; n_chars, if
there, follows the text.  What happens to ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, decontam, langid, linededup, minhash
from corpusforge.llm.queries import ranks
from corpusforge.llm.scratch import discard, lean, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language isn't recognised.  Rows that repeat share their fate; a text of no letters goes."""
    lean(spark)
    model = langid.fit(docs, langid.fold() != 1, per_language=400)
    return langid.drop_rejected(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of two lines or more that stand elsewhere first, by doc_id and then by place in the text; a
    document that has no word left goes.  Rows that repeat doc_id and text are one document and share their fate."""
    used = {c.lower() for c in docs.columns}
    own = tuple(next(n for n in (f"{c}{'_' * i}" for i in range(len(used) + 1)) if n not in used) for c in linededup.COUNTS)
    changed = linededup.dedup_runs(docs, drop_emptied=True, counts=own)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col(own[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select([F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id: five words, a similarity of 0.8.  Of rows
    that repeat doc_id and text one stays, that with the least hash of its other columns."""
    lean(spark)
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.  Rows that repeat share their fate; no items: all stay."""
    lean(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: one row for each row."""
    lean(spark)
    return bpe.encoding_digests(docs, ranks(), with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: The language model and the hashes of the later stages have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
