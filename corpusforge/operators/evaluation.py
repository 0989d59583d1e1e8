"""Calibration and evaluation: sweep, threshold choice, checks, metrics, judge verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import retrieval, routing, screens
from corpusforge.sources.corpus import markdown_table


def facts_missing(facts: Column, context: Column) -> Column:
    """The expected facts that aren't pieces of the context."""
    return F.filter(facts, lambda f: F.instr(context, f) == 0)


def observe(questions: DataFrame, dense_hits: DataFrame, candidates: DataFrame, texts: DataFrame, qkey: str = "qid") -> DataFrame:
    """(qid, question, answerable, raw_dense_max, gate_routed, facts_in_context, missing_facts, page_ids): one row for each question
    (qid, question, answerable, facts), from one retrieval of all of them.

    candidates: (qid, chunk_id, fused_rank); texts: (chunk_id, page_id, text)."""
    best = dense_hits.groupBy(qkey).agg(F.max("dense_score").alias("top"))
    held = candidates.join(texts, "chunk_id").groupBy(qkey).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("fused_rank", "text")))["text"], "\n").alias("context"), F.sort_array(F.collect_set("page_id")).alias("page_ids")
    )
    rows = questions.join(best, qkey, "left").join(held, qkey, "left")
    missing = facts_missing(F.col("facts"), F.coalesce("context", F.lit("")))
    routed = routing.explain(F.col("question"))["intent"] == routing.FACTUAL
    return rows.select(
        qkey, "question", "answerable", F.coalesce("top", F.lit(retrieval.NO_MATCH)).alias("raw_dense_max"), routed.alias("gate_routed"),
        (F.size(missing) == 0).alias("facts_in_context"), missing.alias("missing_facts"), F.coalesce("page_ids", F.array()).alias("page_ids"),
    )


def capture(outcomes: DataFrame, metrics_rows: DataFrame, path: str, **facts) -> None:
    """A run as JSON lines: one of facts (provider, model, threshold, ...), the outcomes and the metrics, each marked by kind."""
    spark = outcomes.sparkSession
    kinds = [("facts", spark.range(1).select(*(F.lit(v).alias(k) for k, v in facts.items()))), ("outcome", outcomes), ("metric", metrics_rows)]
    lines = [rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("value")) for kind, rows in kinds if rows.columns]
    reduce(DataFrame.union, lines).write.mode("overwrite").json(path)


def report(metrics_rows: DataFrame, latency: DataFrame | None = None) -> str:
    """Metrics, and latencies where they are known, as Markdown."""
    parts = ["# Evaluation", markdown_table(metrics_rows.orderBy("metric"))]
    return "\n\n".join(parts + (["## Latency", markdown_table(latency)] if latency is not None else []))


def sweep(observations: DataFrame, start: float = 0.0, step: float = 0.01, points: int = 96) -> DataFrame:
    """One row for each threshold: how many factual and negative observations pass.

    Scores fold into counts by hundredth first, so that the thresholds meet a bounded table
    (of at most a few hundred rows), not the observations."""
    spark = observations.sparkSession
    cell = F.floor(F.round((F.col("raw_dense_max") - start) / step, 6)).cast("long")
    folded = observations.groupBy(cell.alias("cell"), "answerable").agg(F.count("*").alias("n"), F.count_if("facts_in_context").alias("facts"))
    grid = spark.range(points).select(F.col("id").alias("point"))
    met = folded.join(F.broadcast(grid), F.col("cell") >= F.col("point"), "right")
    passed = met.groupBy("point").agg(
        F.coalesce(F.sum(F.when(F.col("answerable"), F.col("n"))), F.lit(0)).alias("factual_passed"),
        F.coalesce(F.sum(F.when(F.col("answerable"), F.col("facts"))), F.lit(0)).alias("facts_passed"),
        F.coalesce(F.sum(F.when(~F.col("answerable"), F.col("n"))), F.lit(0)).alias("negatives_passed"),
    )
    totals = observations.agg(F.count_if("answerable").alias("factual"), F.count_if(~F.col("answerable")).alias("negatives"))
    rows = passed.crossJoin(F.broadcast(totals))
    return rows.select(
        F.round(start + F.col("point") * step, 2).alias("threshold"), "factual_passed", "facts_passed", "negatives_passed",
        F.round(F.try_divide("facts_passed", "factual"), 6).alias("m1_proxy"), F.round(1 - F.try_divide("negatives_passed", "negatives"), 6).alias("m3"),
        F.round(F.try_divide("negatives_passed", "negatives"), 6).alias("false_answer_rate"),
    )


def choose(observations: DataFrame) -> DataFrame:
    """One row: the midpoint between the hardest negative and the easiest factual score, if these leave room."""
    routed = F.col("gate_routed")
    rows = observations.agg(
        F.max(F.when(routed & ~F.col("answerable"), F.col("raw_dense_max"))).alias("lower"), F.min(F.when(routed & F.col("answerable"), F.col("raw_dense_max"))).alias("upper")
    )
    missing = F.col("lower").isNull() | F.col("upper").isNull()
    rule = F.when(missing, "missing_class").when(F.col("lower") >= F.col("upper"), "overlap").otherwise("midpoint")
    return rows.select(F.when(rule == "midpoint", F.bround((F.col("lower") + F.col("upper")) / 2, 4)).alias("threshold"), rule.alias("rule"), (rule == "midpoint").alias("feasible"), "lower", "upper")


def run_checks(answers: DataFrame, limit: int = 3) -> DataFrame:
    """(id, metric, name, passed): one row for each check that applies.

    answers: id, answer, refused, must_refuse, source_url, known_url (the cited page is in the
    corpus), retrieved (it was among the candidates), last_updated, pii_found."""
    leaks = [("M-4", "advice", F.size(screens.advice_leaks(F.col("answer"))) == 0), ("M-5", "performance", F.size(screens.performance_leaks(F.col("answer"))) == 0), ("PII", "absent", ~F.col("pii_found"))]
    refused = [("M-3", "refusal_correct", F.col("refused") & F.col("must_refuse")), ("M-3", "leaks_nothing", F.col("source_url").isNull())]
    links = F.size(T.urls(F.col("answer"))) + F.col("source_url").isNotNull().cast("int")
    answered = [
        ("M-2", "citation_in_corpus", F.coalesce("known_url", F.lit(False))), ("M-2", "citation_retrieved", F.coalesce("retrieved", F.lit(False))),
        ("M-6", "sentence_limit", T.count_sentences(F.col("answer")) <= limit), ("M-7", "one_link", links == 1), ("M-7", "last_updated", F.col("last_updated").isNotNull()),
    ]

    def listed(checks, when: Column | None = None) -> Column:
        rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(n).alias("name"), p.alias("passed")) for m, n, p in checks))
        return rows if when is None else F.when(when, rows).otherwise(F.slice(rows, 1, 0))

    # An answered question that had to be refused fails M-3 openly.
    wrong = [("M-3", "refusal_correct", F.lit(False))]
    every = F.concat(listed(leaks), listed(refused, F.col("refused")), listed(answered, ~F.col("refused")), listed(wrong, ~F.col("refused") & F.col("must_refuse")))
    return answers.select("id", F.explode(every).alias("c")).select("id", "c.metric", "c.name", "c.passed")


METRICS = ["M-1", "M-2", "M-3", "M-4", "M-5", "M-6", "M-7"]


#: Fixed value: the least mean score, of 2, with which answers count as right.
JUDGED = 1.6


def metrics(checks: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(metric, numerator, denominator, status): unavailable where nothing was measured.

    ``verdicts``: a judge's scores (0 to 2), from which M-1 is taken: points of all that could be had; it is unavailable
    if one is missing."""
    names = checks.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    counted = checks.groupBy("metric").agg(F.count_if("passed").alias("numerator"), F.count("*").alias("denominator"))
    status = F.when(F.coalesce("denominator", F.lit(0)) == 0, "unavailable").when(F.col("numerator") == F.col("denominator"), "pass").otherwise("fail")
    out = names.join(counted, "metric", "left").select("metric", F.coalesce("numerator", F.lit(0)).cast("long").alias("numerator"), F.coalesce("denominator", F.lit(0)).cast("long").alias("denominator"), status.alias("status"))
    if verdicts is None:
        return out
    n, whole = F.count("*"), (F.count_if(F.col("score").isNull()) == 0) & (F.count("*") > 0)
    judged = F.when(~whole, "unavailable").when(F.avg("score") >= JUDGED, "pass").otherwise("fail")
    mean = verdicts.agg(F.lit("M-1").alias("metric"), F.when(whole, F.sum("score")).otherwise(0).cast("long").alias("numerator"), F.when(whole, 2 * n).otherwise(0).cast("long").alias("denominator"), judged.alias("status"))
    return out.where("metric != 'M-1'").unionByName(mean)


#: What a judge is asked; its answer is one JSON object.
JUDGE = """Score the answer against the expected facts and the evidence: 2 if all facts are stated and supported, 1 if some are, 0 if none is or something is unsupported.
Reply with JSON only: {"score": 0, 1 or 2, "reason": text, "missing": [facts], "unsupported": [claims]}."""
STRING_LIST = r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'


def judge_prompts(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, system, user) for each row (key, question, facts, answer, evidence)."""
    user = F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.col("question")), F.concat(F.lit("Expected facts: "), F.array_join("facts", "; ")), F.concat(F.lit("Answer: "), F.col("answer")), F.concat(F.lit("Evidence: "), F.col("evidence")))
    return rows.select(key, F.lit(JUDGE).alias("system"), user.alias("user"))


VERDICT = "score string, reason string, missing array<string>, unsupported array<string>"


def parse_verdicts(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Adds score (0, 1 or 2, else null) and reason of a judge's JSON reply, with or without a code fence."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    whole = F.regexp_extract(bare, r'"score"\s*:\s*(-?[0-9]+)\s*[,}]', 1)
    parsed = F.from_json(bare, VERDICT)
    good = whole.isin("0", "1", "2") & parsed["reason"].isNotNull() & parsed["score"].isNotNull()
    for listed in ("missing", "unsupported"):
        own = F.get_json_object(bare, f"$.{listed}")
        good = good & (own.isNull() | own.rlike(STRING_LIST))
    return replies.withColumns({"score": F.when(good, whole.try_cast("int")), "reason": F.when(good, parsed["reason"])})


def judge_mean(verdicts: DataFrame) -> DataFrame:
    """One row: the mean score, or null if any verdict is missing."""
    mean = F.when((F.count_if(F.col("score").isNull()) == 0) & (F.count("*") > 0), F.round(F.avg("score"), 2))
    return verdicts.agg(mean.alias("mean"), F.count("*").alias("n"))
