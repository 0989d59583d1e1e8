"""Shared pieces of the named queries: driver tables in the engine's terms, and SQL helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import table

__all__ = ["F", "DataFrame", "SparkSession", "table", "documents", "lines", "questions", "literal", "quoted", "matches", "values", "QUESTIONS", "LINES_SQL", "QUESTIONS_SQL"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of blocks: the first line is a heading, the others are paragraphs."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"), "source", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))
    return rows.withColumn("kind", F.when(F.col("ordinal") == 0, "heading").otherwise("paragraph"))


LINES_SQL = """(SELECT doc_id AS page_id, source, CAST(i - 1 AS INTEGER) AS ordinal, text, CASE WHEN i = 1 THEN 'heading' ELSE 'paragraph' END AS kind
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""

#: A battery of questions of every route, in our own words.
QUESTIONS = [
    "What is the expense ratio of HDFC Equity Fund?", "Tell me the exit load for units sold early", "exit load after 3 years?", "Which asset allocation does the page state?",
    "What are the top 10 holdings?", "Can I redeem after 3 years?", "Should I put money here?", "Which of these is the best option?", "I want to buy units", "Please recommend one",
    "Is it worth buying now?", "How do I rebalance my portfolio?", "switch to direct plan, good idea?", "How can I download my capital gains statement?", "where do I get an account statement",
    "How to file income tax return", "tax planning ideas", "Does section 80C apply?", "Which term plan has good cover?", "fd rates of a bank", "What is the home loan EMI?", "I need a lawyer",
    "expense ratio of SBI Bluechip", "Is Axis fund cheaper?", "What is the NAV of HDFC Mid Cap Opportunities Fund?", "hdfc infrastructure fund exit load", "minimum sip for hdfc large cap fund",
    "HDFC Nifty 50 ETF charges", "Name the pages you are using", "How many schemes are covered?", "What sources do you use?", "which funds are you referring to", "Tell me about your corpus",
    "What are the expense ratios of the funds you cover?", "What do you know about HDFC Large Cap Fund?", "scheme details please", "overview of the ELSS fund", "who is the fund manager",
    "lock-in of ELSS", "what is the riskometer level", "benchmark index?", "direct growth option", "why to invest", "hello there", "", "   ", "18% in 3 years?", "What is the CAGR?",
    "latest NAV today", "top performing scheme", "performance risk level", "performance last year", "returns since inception", "AUM as of now", "min. amount", "How old is the universe?",
]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    """VALUES rows of SQL literals."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return quoted(v)

    names = ", ".join(f"column{i}" for i in range(len(rows[0])))
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): the battery, and everything that users say in conversations."""
    battery = literal(spark, [(f"b{i}", q) for i, q in enumerate(QUESTIONS)], "qid string, question string")
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return battery.unionByName(said.select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("qid"), F.col("text").alias("question")))


#: The same; accented letters are replaced by a plain one, as DuckDB's word boundaries know ASCII only.
QUESTIONS_SQL = f"""(SELECT qid, question, trim(regexp_replace(regexp_replace(question, '[À-ɏ]', 'Z', 'g'), '\\s+', ' ', 'g')) AS q FROM (
  SELECT column0 AS qid, column1 AS question FROM {values([(f"b{i}", q) for i, q in enumerate(QUESTIONS)])}
  UNION ALL SELECT 'c' || conv_id || ':' || turn, text FROM conversations WHERE role = 'user'))"""


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)}, 'i')"
