"""Drafts by a slow generator, kept in a log so that a run which stops half way asks nothing twice.

The log is a folder of JSON lines (key, question_ref, draft).  A key is a digest of the question and
everything that it is asked with, so a changed prompt is another one.  Tasks ask ``workers`` at a time
and write what they got after every few answers, also when a call fails; the next run asks only what
the log lacks.  Texts of questions aren't in the log."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import question_ref
from corpusforge.session import folder_exists

#: Answers of a task that are written together.
TOGETHER = 16


def _store(log: str) -> tuple[fs.FileSystem, str]:
    uri = log if re.match(r"^[a-z0-9]+:/", log) else "file://" + log
    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri))


def known(rows: DataFrame, log: str) -> DataFrame:
    """(key, draft) of the log; of a key that was asked twice, as by a task that ran again, the least draft."""
    spark = rows.sparkSession
    if not folder_exists(spark, log):
        return spark.createDataFrame([], "key string, draft string")
    return spark.read.schema("key string, draft string").json(log).where("draft is not null").groupBy("key").agg(F.min("draft").alias("draft"))


def logged(rows: DataFrame, generate: Callable[[str, list], str], log: str, workers: int = 4) -> DataFrame:
    """The rows (question, candidates and others) with ``draft``.  The calls are made here, in one job; what is returned only joins
    the log."""
    keyed = rows.withColumns({"key": F.sha2(F.to_json(F.struct("question", "candidates")), 256), "ref": question_ref(F.col("question"))})
    asked = keyed.join(known(rows, log), "key", "left_anti").dropDuplicates(["key"])

    def run(batches):
        store, base = _store(log)

        def write(answers: list[dict]) -> None:
            if answers:
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/{uuid.uuid4().hex}.json") as out:
                    out.write("".join(json.dumps(a) + "\n" for a in answers).encode())

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                todo = batch.to_pylist()
                for i in range(0, len(todo), TOGETHER):
                    part = todo[i : i + TOGETHER]
                    calls = [pool.submit(generate, r["question"] or "", r["candidates"] or []) for r in part]
                    got = [(r, c.exception(), None if c.exception() else c.result()) for r, c in zip(part, calls)]
                    write([{"key": r["key"], "question_ref": r["ref"], "draft": text} for r, error, text in got if error is None])
                    for _, error, _ in got:
                        if error is not None:
                            raise error
                yield pa.RecordBatch.from_arrays([batch.column("key")], ["key"])

    asked.select("key", "ref", "question", "candidates").mapInArrow(run, "key string").write.format("noop").mode("overwrite").save()
    return keyed.join(known(rows, log), "key").drop("key", "ref")
