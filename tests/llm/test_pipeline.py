import hashlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import bpe, langid, quality, queries

from .conftest import words
from .test_operators import WORD, linked, without_runs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus in which each stage has something to do."""
    path = str(tmp_path_factory.mktemp("sf"))
    item = words(40, 77)
    rows = [(i, words(150, 1000 + i, 5000), "en") for i in range(60)]
    near = rows[0][1].split()
    near[75] = "changed"
    rows += [(100, " ".join(near), "en"), (101, words(40, 90) + " " + item + " " + words(40, 91), "en"), (102, "123 456", "en"), (103, None, None)]
    block = "\n".join(words(8, 200 + i) for i in range(30))
    rows += [(104, words(30, 95) + "\n" + block, "en"), (105, words(30, 96) + "\n" + block + "\n" + words(30, 97), "en"), (106, rows[1][1], "en")]
    docs = [(i, t, lang, f"s{i % 3}", len(t) if t is not None else None, "extra") for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns = docs.columns
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        gone[name] = before - {r.doc_id for r in docs.collect()}
    assert gone["language_id"] == {102, 103}
    assert gone["line_dedup"] == set()
    assert gone["near_dedup"] == {100, 106}
    assert gone["decontamination"] == {101}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts[105]) < len(texts[104]) and all(r.n_chars == len(r.text) for r in docs.collect())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(texts)
    assert all(out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and len(out[i].ids) == out[i].n_tokens for i, t in texts.items())


def test_run_by_brute_force(spark, folder, tmp_path):
    """All five stages against plain versions of each, on rows with nulls, blanks, copies and repeats, too."""
    docs = spark.read.parquet(folder + "/documents.parquet")
    block = "\n".join(words(8, 200 + i) for i in range(6))
    more = [(300, "", "en", "s", 0, "x"), (301, " \n\t", "en", "s", 4, "x"), (302, block, "en", "s", 1, "x"), (302, block, "en", "s", 1, "x"), (302, block, "en", "s", 1, "y"), (None, words(90, 999), None, None, None, None), (None, None, None, None, None, None), (303, words(60, 5) + "\n" + block, "en", "s", 9, "x")]
    path = str(tmp_path)
    docs.union(spark.createDataFrame(more, docs.schema)).repartition(3).write.parquet(path + "/documents.parquet")
    items = [(0, words(40, 77)), (1, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    docs = spark.read.parquet(path + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.fit(docs, langid.fold() != 1, per_language=400)
    rows = [r for r in rows if not model.predict([r[1] or ""])[2][0]]
    left = without_runs(rows)
    cleaned = []
    for k, t in rows:
        lines = left[-(2**63) if k is None else k, t or ""]
        kept = "\n".join(lines) if len(lines) < len(t.split("\n")) else t
        if kept == t or WORD.search(kept):
            cleaned.append((k, kept))
    found = linked(cleaned, 5, 80)
    one = {(k, t) for k, t in cleaned if k is None or found[k, t][1] == k}
    plain = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())

    def leaks(text, item):
        cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        a, s = Counter(cut(plain(item))), cut(plain(text))
        n = min(a.total(), len(s))
        return bool(a) and any(100 * (both := (Counter(s[i : i + n]) & a).total()) >= 80 * (n + a.total() - both) for i in range(len(s) - n + 1) if n)

    wanted = Counter((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in one if not any(leaks(t, item) for _, item in items))
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == wanted and len(wanted) > 40
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Encoder(queries.ranks()).ranks, special_tokens={})
    by = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in one}
    assert all(r.ids == library.encode_ordinary(by[r.decoded_sha256]) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in out)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(folder + "/documents.parquet")
    path = str(tmp_path)
    docs.limit(0).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).columns == docs.columns


def test_columns_of_any_name_pass_through(spark, folder):
    """Also those that a stage would give itself, and names with dots and backticks."""
    docs = spark.read.parquet(folder + "/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    names = ["n_removed", "N_Lines", "a.b", "c`d", "gone", "chunks", "row", "label", "rest"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == f"{i}:{r['doc_id']}" for r in rows for i, name in enumerate(names))
    emptied = quality.without_boilerplate(docs)
    assert emptied.columns == docs.columns and all(r["a.b"] == f"2:{r['doc_id']}" for r in emptied.collect())


def test_names():
    numbers = {int(n[2:].split("_")[0]) for n in queries.queries()}
    assert numbers == set(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
