"""Answering as a whole: policies, routing decisions, the list of sources, one prompt, second drafts, and runs that stop half way."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import prompts
from corpusforge.operators import answers, drafting, ingest, retrieval, search, segments

QUESTIONS = [
    ("load", "What is the exit load of the equity fund?"), ("buy", "Should I buy units?"), ("tax", "How to file income tax return"), ("list", "What sources do you use?"),
    ("mail", "What is the exit load? Write to a.b@example.org"), ("empty", ""),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [("c1", "p1", "https://x.org/1", "HDFC Equity Fund Direct Plan - Growth", "The exit load of the equity fund is 1% within a year. More is said here."), ("c2", "p2", "https://x.org/2", "HDFC Large Cap Fund", "The benchmark is the NIFTY 100."), ("c3", "p3", "https://x.org/3", None, "Nothing of note.")]
    chunks = spark.createDataFrame(docs, "doc_id string, source string, source_url string, scheme string, text string")
    vectors = ingest.hash_embed(chunks, 16, "doc_id").withColumnRenamed("doc_id", "vec_id")
    return chunks, vectors


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "qid string, question string")


def by_id(df):
    return {r.qid: r for r in df.collect()}


def test_each_way_to_an_answer(spark, corpus):
    got = by_id(answers.answer(asked(spark), *corpus, threshold=-1.0, dim=16))
    assert {q: (r.refused, r.reason, r.decision) for q, r in got.items()} == {
        "load": (False, None, "ok"), "buy": (True, "opinion", "intent:opinion"), "tax": (True, "not_in_corpus", "intent:out_of_scope"), "list": (False, None, "intent:corpus_sources"), "mail": (True, "pii", "pii"),
        "empty": (True, "not_in_corpus", "intent:out_of_scope"),
    }
    assert got["load"].answer == "The exit load of the equity fund is 1% within a year." and got["load"].source_url == "https://x.org/1"
    assert got["list"].answer == "I answer from these pages: HDFC Equity Fund, HDFC Large Cap Fund, and p3."
    assert got["load"].notes.startswith("personal data: 0") and got["mail"].notes.startswith("personal data: 1")
    assert "a.b@" not in str(got["mail"])


def test_policies_and_thresholds(spark, corpus):
    dry = by_id(answers.answer(asked(spark), *corpus, threshold=-1.0, dim=16, block_pii=False, dry_run=True))
    assert dry["mail"].decision == "ok" and "dry run" in dry["mail"].notes and "dry run" not in dry["load"].notes
    open_ = by_id(answers.answer(asked(spark), *corpus, threshold=-1.0, dim=16, block_pii=False))
    assert open_["mail"].decision == "ok" and "not blocked" in open_["mail"].notes
    assert {r.decision for q, r in by_id(answers.answer(asked(spark), *corpus, threshold=1.0, dim=16)).items() if q == "load"} == {"below_threshold"}
    none = by_id(answers.answer(asked(spark), *corpus, threshold=None, dim=16))
    assert none["load"].decision == "uncalibrated" and none["load"].refused and none["list"].answer.startswith("I answer")


def test_a_long_draft_is_asked_once_more(spark, corpus, tmp_path):
    calls = tmp_path / "calls"

    def generate(question, candidates):
        with calls.open("a") as f:
            f.write("x")
        return "One. Two. Three. Four. Five [S1]." if len(calls.read_text()) == 1 else "It is due [S1]."

    only = asked(spark).where("qid = 'load'")
    got = answers.answer(only, *corpus, threshold=-1.0, dim=16, generate=generate).collect()
    assert got[0].answer in ("It is due.", "One. Two. Three.") and len(calls.read_text()) >= 2


def test_exact_scores_of_sparse_hits(spark, corpus):
    """A hit of the sparse leg alone has its own cosine, not the mark of no match."""
    chunks, vectors = corpus
    q = ingest.hash_embed(asked(spark).where("qid = 'load'"), 16, "qid", "question", keep=["question"]).withColumnRenamed("embedding", "qvec")
    found = search.retrieve(q, chunks, vectors, segments.in_memory(chunks, "doc_id", "text"), top=3, legs=1)
    assert all(r.dense_score > retrieval.NO_MATCH for r in found.fused.collect())


def test_one_prompt(spark):
    blocks = [{"text": "a" * 20, "source_url": "u1"}, {"text": "b" * 30, "source_url": "u2"}]
    rows = spark.createDataFrame([(0, f"c{i}", i + 1, b["source_url"], b["text"]) for i, b in enumerate(blocks)], "qid long, chunk_id string, fused_rank int, source string, text string")
    system, user = answers.messages(spark.createDataFrame([(0, "Q?")], "qid long, question string"), answers.evidence(rows)).select("system", "user").first()
    assert [t["content"] for t in prompts.turns("Q?", blocks)] == [system, user]
    assert "[S2]" not in prompts.turns("Q?", blocks, budget=40)[1]["content"]


def test_a_run_that_stops_asks_nothing_twice(spark, tmp_path):
    log, calls = str(tmp_path / "log"), tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"question {i % 40}", [("t",)]) for i in range(50)], "qid int, question string, candidates array<struct<text:string>>").repartition(4)
    fail = tmp_path / "fail"
    fail.write_text("x")

    def generate(question, candidates):
        if fail.exists() and question == "question 17":
            raise OSError("stopped")
        (calls / question).open("a").write("x")
        return "answer to " + question

    with pytest.raises(Exception, match="stopped"):
        drafting.logged(rows, generate, log, workers=2)
    fail.unlink()
    got = drafting.logged(rows, generate, log, workers=2)
    assert got.count() == 50 and all(r.draft == "answer to " + r.question for r in got.collect())
    assert {f.name: f.read_text() for f in calls.iterdir()} == {f"question {i}": "x" for i in range(40)}
    assert drafting.logged(rows, generate, log).count() == 50 and all(f.read_text() == "x" for f in calls.iterdir())
    assert "question" not in "".join(r.value for r in spark.read.text(log).select(F.regexp_replace("value", '"question_ref"|answer to question \\d+', "").alias("value")).collect())
