"""Batch answering: scan, route, retrieve, gate, draft, screen; one row for each question."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusforge.functions import prompts
from corpusforge.functions import text as T
from corpusforge.operators import drafting, ingest, pii, retrieval, routing, screens, search, segments
from corpusforge.session import stored


def extractive(candidates: Column) -> Column:
    """The default draft: the best candidate's first sentence, cited."""
    first = F.get(T.sentences(F.get(candidates, F.lit(0))["text"]), F.lit(0))
    return F.coalesce(F.concat(F.regexp_replace(first, r"\.+$", ""), F.lit(" [S1].")), F.lit(""))


def drafts(rows: DataFrame, generate: Callable[[str, list], str] | None = None, log: str | None = None) -> DataFrame:
    """Adds ``draft``: extractive, or by a generator of (question, candidates), which may be slow and
    have effects.  Such a one runs over Arrow batches; no filter moves past it, and each row meets it once.
    With a ``log`` (a folder) no question is asked twice, over all runs with that log."""
    if generate is None:
        return rows.withColumn("draft", extractive(F.col("candidates")))
    if log:
        return drafting.logged(rows, generate, log)

    def run(batches):
        for batch in batches:
            asked = zip(batch.column("question").to_pylist(), batch.column("candidates").to_pylist())
            texts = [generate(q or "", c or []) for q, c in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "draft"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("draft", StringType())]))


def stream_draft(draft: str):
    """A draft piece by piece, words with the white space before them.  It hasn't passed any screen yet, so it is not to be shown."""
    yield from re.findall(r"\s*\S+", draft)


def evidence(rows: DataFrame, budget: int = prompts.BUDGET, qkey: str = "qid") -> DataFrame:
    """(qid, chunk_id, fused_rank, block, total) of rows (qid, chunk_id, fused_rank, source, text): numbered blocks in rank
    order while they fit the budget, headers and gaps between them included, up to the first that doesn't."""
    block = F.concat(F.lit("[S"), F.col("fused_rank"), F.lit("] "), F.col("source"), F.lit("\n"), F.col("text"))
    rows = rows.select(qkey, "chunk_id", "fused_rank", block.alias("block"))
    before = Window.partitionBy(qkey).orderBy("fused_rank")
    total = F.sum(F.length("block") + 2).over(before) - 2
    return rows.withColumn("total", total.cast("long")).where(F.col("total") <= budget)


def messages(questions: DataFrame, blocks: DataFrame, qkey: str = "qid") -> DataFrame:
    """(qid, system, user): the turns that a model gets."""
    joined = blocks.groupBy(qkey).agg(F.array_join(F.sort_array(F.collect_list(F.struct("fused_rank", "block")))["block"], "\n\n").alias("context"))
    user = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
    return questions.select(qkey, "question").join(joined, qkey, "left").select(qkey, F.lit(prompts.SYSTEM).alias("system"), user.alias("user"))


def _again(rows: DataFrame, generate: Callable[[str, list], str] | None, limit: int = 3) -> DataFrame:
    """Adds ``again``: a second draft where the first has too many sentences; such a generator is asked once more, others aren't."""
    if generate is None:
        return rows.withColumn("again", F.lit(None).cast("string"))
    long = rows.withColumn("long", T.count_sentences(T.strip_urls(F.col("draft"))) > limit)

    def run(batches):
        for batch in batches:
            asked = zip(batch.column("question").to_pylist(), batch.column("candidates").to_pylist(), batch.column("long").to_pylist())
            texts = [generate(q or "", c or []) if again else None for q, c, again in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "again"])

    return long.mapInArrow(run, StructType([*long.schema.fields, StructField("again", StringType())]))


def answer(
    questions: DataFrame, docs: DataFrame, vectors: DataFrame, threshold: float | None, generate: Callable[[str, list], str] | None = None, embed=ingest.embed_each, dim: int = 64, top: int = 5,
    index: retrieval.Bm25Index | None = None, block_pii: bool = True, dry_run: bool = False, log: str | None = None,
) -> DataFrame:
    """(qid, intent, refused, reason, answer, source_url, decision, notes): one row for each question.

    Personal data is looked for first: what the policy blocks never reaches routing; in a dry run, or where nothing is to be blocked, it
    goes on with a note.  Opinions and questions outside the corpus are refused on routing, and questions for the sources are
    answered with the list of pages; none of these meets retrieval.  Without a threshold every factual question is refused.
    ``decision``: ``intent:`` and the intent where routing decided, else the gate's reason; ``log``: a folder of drafts (see
    ``drafting``); ``index``: a stored BM25 index of docs (doc_id, source, text, and source_url, scheme if known)."""
    scanned = pii.scan(questions, "question").withColumn("policy", pii.policy(F.col("pii_found"), block_pii, dry_run))
    note = F.when(F.col("policy") == "mark", "personal data, not blocked: dry run").when(F.col("pii_found"), F.when(F.col("policy") == "pass", "personal data, not blocked"))
    keep = lambda rows: stored(rows, "answer")
    scanned = scanned.withColumn("pii_note", F.concat(F.lit("personal data: "), F.size("pii_spans"), F.coalesce(F.concat(F.lit("; "), note), F.lit(""))))
    intent = F.when(F.col("policy") != "block", routing.explain(F.col("question"))["intent"])
    scanned = keep(scanned.select("qid", F.when(F.col("policy") != "block", F.col("question")).alias("question"), "policy", "pii_note", intent.alias("intent")))
    blocked = scanned.where("policy = 'block'").select("qid", F.lit(routing.OUT).alias("intent"), F.lit("pii").alias("reason"), F.lit("pii").alias("decision"), "pii_note")
    routed = scanned.where("policy != 'block'").select("qid", "question", "pii_note", "intent")
    decided_by_route = routed.where(F.col("intent") != routing.FACTUAL)
    kind = F.when(F.col("intent") == routing.OPINION, "opinion").when(F.col("intent") == routing.SOURCES, "sources").otherwise("not_in_corpus")
    closed = [blocked, decided_by_route.select("qid", "intent", kind.alias("reason"), F.concat(F.lit("intent:"), "intent").alias("decision"), "pii_note")]
    factual = routed.where(F.col("intent") == routing.FACTUAL)
    answered = None
    if threshold is None:
        closed.append(factual.select("qid", "intent", F.lit("not_in_corpus").alias("reason"), F.lit("uncalibrated").alias("decision"), "pii_note"))
    else:
        embedded = keep(ingest.hash_embed(factual, dim, "qid", "question", embed, keep=["question"]).withColumnRenamed("embedding", "qvec"))
        found, decided = search.search(embedded, docs, vectors.select("vec_id", "embedding"), index or segments.in_memory(docs, "doc_id", "text"), threshold, top, keep=keep)
        decided = factual.select("qid", "question", "pii_note").join(decided.select("qid", "found_answer", F.col("reason").alias("decision")), "qid")
        closed.append(decided.where(~F.col("found_answer")).select("qid", F.lit(routing.FACTUAL).alias("intent"), F.lit("not_in_corpus").alias("reason"), "decision", "pii_note"))
        url = F.col("source_url") if "source_url" in docs.columns else F.concat(F.lit("https://corpus.example.org/"), "source")
        texts = docs.select(F.col("doc_id").alias("chunk_id"), url.alias("source_url"), "text")
        held = found.fused.join(texts, "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("fused_rank", "chunk_id", "source_url", "text"))).alias("candidates"))
        opened = decided.where("found_answer").join(held, "qid")
        drafted = _again(drafts(opened, generate, log), generate)
        checked = screens.validate(drafted.select(F.col("qid").alias("id"), "draft", "again", "candidates"), regenerated="again" if generate else None)
        told = checked.join(decided.select(F.col("qid").alias("id"), "decision", "pii_note"), "id")
        notes = F.concat_ws("; ", "pii_note", F.nullif("notes", F.lit("")))
        answered = told.select(F.col("id").alias("qid"), F.lit(routing.FACTUAL).alias("intent"), "refused", "reason", "answer", "source_url", "decision", notes.alias("notes"))
    refused = reduce(DataFrame.unionByName, closed)
    scheme = F.col("scheme") if "scheme" in docs.columns else F.col("source")
    pages = docs.groupBy(F.col("source").alias("page_id")).agg(F.coalesce(F.max(scheme), F.max("source")).alias("scheme"))
    listed = refused.crossJoin(F.broadcast(screens.source_list_answer(pages).withColumnRenamed("answer", "list")))  # one row
    sources = F.col("reason") == "sources"
    rest = listed.select(
        "qid", "intent", (F.col("reason") != "sources").alias("refused"), F.when(~sources, F.col("reason")).alias("reason"),
        F.when(sources, F.coalesce("list", screens.refusal(F.lit("not_in_corpus")))).otherwise(screens.refusal(F.col("reason"))).alias("answer"), F.lit(None).cast("string").alias("source_url"), "decision", F.col("pii_note").alias("notes"),
    )
    return rest if answered is None else answered.unionByName(rest)


def log_rows(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """What may be logged of a run: a reference in place of the question, no text of it."""
    return answers.join(questions.select("qid", T.question_ref(F.col("question")).alias("question_ref")), "qid").select("question_ref", "intent", "refused", "reason")
