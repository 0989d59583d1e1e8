"""Command line: ingest, ask, retrieve, dump, calibrate, profile.  Exit codes: 0 well, 1 failed pages, 2 refused, uncalibrated or infeasible."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from corpusforge.operators import answers, evaluation, index, ingest, pii, profiling, retrieval, routing, search
from corpusforge.session import session
from corpusforge.sources import corpus


def _ingest(spark, a) -> int:
    actions = index.build(spark, spark.read.parquet(a.pages), a.index, a.reindex, a.drop_return_heavy, a.min_chars, a.size, a.overlap)
    print(actions)
    return 1 if actions.get("failed") else 0


def _ask(spark, a) -> int:
    rows = spark.createDataFrame(list(enumerate(a.question)), "qid long, question string")
    if pii.scan(rows, "question").where("pii_found").limit(1).count():
        print("A question holds personal data.", file=sys.stderr)
        return 2
    if a.pages:
        index.ensure(spark, a.pages, a.index)
    chunks, vectors, stored = index.tables(spark, a.index)
    answers.answer(rows, chunks, vectors, a.threshold, dim=index.DIM, index=stored).show(truncate=False)
    return 0


def _retrieve(spark, a) -> int:
    """Candidates and gate decision of one question, without a model; with ``--show-rule`` only how it is routed."""
    rows = spark.createDataFrame([(0, " ".join(a.question))], "qid long, question string")
    scanned = pii.scan(rows, "question").first()
    if scanned.pii_found:
        print(f"question : {scanned.redacted}\nrefused  : personal data ({', '.join(scanned.pii_kinds)}); nothing was embedded, sent or stored")
        return 2
    match, claim = rows.select(routing.explain(F.col("question")).alias("m"), routing.is_performance_claim(F.col("question")).alias("claim")).first()
    print(f"question : {' '.join(a.question)}\nintent   : {match.intent}  (rule={match.rule})\nperformance claim: {claim}")
    if a.show_rule:
        return 0
    if match.intent != routing.FACTUAL:
        print(f"decision : intent:{match.intent}")
        return 0
    chunks, vectors, stored = index.tables(spark, a.index)
    asked = ingest.hash_embed(rows, index.DIM, "qid", "question", keep=["question"]).withColumnRenamed("embedding", "qvec")
    found = search.retrieve(asked, chunks, vectors, stored)
    found.fused.orderBy("fused_rank").show(truncate=False)
    if a.threshold is None:
        print("decision : uncalibrated; no threshold is guessed")
        return 2
    retrieval.gate(asked, found.fused, found.dense, a.threshold).drop("qid").show(truncate=False)
    return 0


def _dump(spark, a) -> int:
    """The index for reading: chunks as CSV, vectors as CSV with rounded components."""
    now = index.state(spark, a.index)
    chunks, vectors, _ = index.tables(spark, a.index)
    if a.only in ("chunks", "all"):
        whole = ingest.read_chunks(spark, a.index, now.get("chunks"))
        rows = profiling.dump(whole).join(whole.select("chunk_id", "text"), "chunk_id").orderBy("page_id", "place")
        corpus.write_csv(rows if a.max_chunks is None else rows.limit(a.max_chunks), a.out + "/chunks")
    if a.only in ("embeddings", "all"):
        rows = profiling.dump_vectors(vectors, a.nd).orderBy("vec_id")
        corpus.write_csv(rows if a.max_chunks is None else rows.limit(a.max_chunks), a.out + "/embeddings")
    return 0


def _calibrate(spark, a) -> int:
    decision = evaluation.choose(spark.read.parquet(a.observations))
    decision.show(truncate=False)
    return 0 if decision.first().feasible else 2


def _profile(spark, a) -> int:
    profiling.integrity(spark.read.parquet(a.vectors)).show(truncate=False)
    profiling.exact_duplicates(spark.read.parquet(a.docs)).agg(F.count("*").alias("groups"), F.sum(F.col("copies") - 1).alias("redundant")).show()
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("corpusforge")
    parts = parser.add_subparsers(required=True)
    p = parts.add_parser("ingest")
    p.add_argument("pages")
    p.add_argument("index")
    p.add_argument("--reindex", action="store_true")
    p.add_argument("--drop-return-heavy", action="store_true")
    p.add_argument("--min-chars", type=int, default=1500)
    p.add_argument("--size", type=int, default=200)
    p.add_argument("--overlap", type=int, default=40)
    p.set_defaults(run=_ingest)
    p = parts.add_parser("ask")
    p.add_argument("index")
    p.add_argument("question", nargs="+")
    p.add_argument("--pages", help="where the index is built from if a part of it is missing")
    p.add_argument("--threshold", type=float, required=True)
    p.set_defaults(run=_ask)
    p = parts.add_parser("retrieve")
    p.add_argument("index")
    p.add_argument("question", nargs="+")
    p.add_argument("--show-rule", action="store_true", help="only how the question is routed")
    p.add_argument("--threshold", type=float)
    p.set_defaults(run=_retrieve)
    p = parts.add_parser("dump")
    p.add_argument("index")
    p.add_argument("out")
    p.add_argument("--only", choices=("chunks", "embeddings", "all"), default="all")
    p.add_argument("--nd", type=int, default=6, help="decimals of vector components")
    p.add_argument("--max-chunks", type=int, help="only the first so many")
    p.set_defaults(run=_dump)
    p = parts.add_parser("calibrate")
    p.add_argument("observations")
    p.set_defaults(run=_calibrate)
    p = parts.add_parser("profile")
    p.add_argument("docs")
    p.add_argument("vectors")
    p.set_defaults(run=_profile)
    a = parser.parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
