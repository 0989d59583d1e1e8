"""The command line over a small index: retrieve and dump."""

import pytest

from corpusforge.__main__ import main
from corpusforge.operators import index


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "idx")
    pages = [(str(i), f"<main><h1>Fund {i}</h1><p>The exit load of fund {i} is {i}% within a year. " + "More words stand here. " * 30 + "</p></main>", f"Scheme {i}", f"https://x.org/{i}") for i in (1, 2)]
    index.build(spark, spark.createDataFrame(pages, "page_id string, html string, scheme string, source_url string"), path, min_chars=100)
    return path


def test_retrieve(built, capsys):
    assert main(["retrieve", built, "What", "is", "the", "exit", "load", "of", "fund", "2?", "--threshold", "-1"]) == 0
    out = capsys.readouterr().out
    assert "(rule=exit_load)" in out and "fused_rank" in out and "found_answer" in out
    assert main(["retrieve", built, "What is the exit load?"]) == 2 and "uncalibrated" in capsys.readouterr().out
    assert main(["retrieve", built, "Should I buy?", "--show-rule"]) == 0 and "rule=should_i" in capsys.readouterr().out
    assert main(["retrieve", built, "Should I buy?"]) == 0 and "intent:opinion" in capsys.readouterr().out
    assert main(["retrieve", built, "I am a.b@x.org"]) == 2
    assert "a.b@x.org" not in capsys.readouterr().out


def test_dump(spark, built, tmp_path):
    out = str(tmp_path / "out")
    assert main(["dump", built, out, "--nd", "3"]) == 0
    chunks, vectors = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/{n}") for n in ("chunks", "embeddings"))
    assert chunks.count() == vectors.count() >= 2 and {"page_id", "place", "chunk_id", "text"} <= set(chunks.columns)
    first = vectors.first()
    assert first.dim == "384" and len(first.vector.split(",")) == 384 and all(len(x.partition(".")[2]) == 3 for x in first.vector.split(","))
    assert main(["dump", built, out, "--only", "chunks", "--max-chunks", "1"]) == 0
    assert spark.read.option("header", True).csv(f"{out}/chunks").count() == 1
