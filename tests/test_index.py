"""Stored indexes: segments of BM25, the inverted file of vectors, versioned tables, and runs that break off."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import ann, index, ingest, retrieval, segments
from corpusforge.sources import versions


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def texts(n, seed):
    rng = random.Random(seed)
    stock = [f"w{int(rng.expovariate(0.05))}" for _ in range(300)]
    return [" ".join(rng.choice(stock) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus_and_questions(spark):
    docs = [*enumerate(texts(400, 1)), (400, None), (401, ""), (402, "w1 w1 w1 w1"), (403, "w1 w1 w1 w1")]
    asked = [*enumerate(texts(25, 2)), (25, None), (26, "nowhere"), (27, "w1 w1 w0")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "qid long, question string")


def brute_bm25(docs, asked, top):
    import math
    from collections import Counter

    texts = {k: (t or "").lower().split() for k, t in docs}
    n, average = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, question in asked:
        scores = {}
        for k, t in texts.items():
            tf = Counter(t)
            s = sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in (question or "").split() if tf[w])
            if round(s, 9) > 0:
                scores[k] = round(s, 9)
        best = sorted(scores, key=lambda k: (-scores[k], k))[:top]
        out += [(q, k, round(scores[k], 4), i + 1) for i, k in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted((r.qid, r.doc_id, round(r.sparse_score, 4), r.sparse_rank) for r in df.collect())


@pytest.mark.parametrize("top", [1, 20])
def test_bm25_cells_against_brute_force(spark, corpus_and_questions, tmp_path, monkeypatch, top):
    docs, asked = corpus_and_questions
    monkeypatch.setattr(segments, "CELL", 8)
    path = str(tmp_path / "i")
    retrieval.write_bm25(docs, path)
    stored = retrieval.load_bm25(spark, path, documents=404)
    got = retrieval.bm25_search(asked, stored, top)
    wanted = brute_bm25(docs.collect(), asked.collect(), top)
    assert [r[:2] + r[3:] for r in found(got)] == [r[:2] + r[3:] for r in wanted] and all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(found(got), wanted))
    work = retrieval.bm25_work(asked, stored, top).collect()
    assert all(0 < r.blocks_scored <= r.blocks for r in work)
    assert top > 1 or sum(r.blocks_scored for r in work) < sum(r.blocks for r in work)  # some are skipped
    monkeypatch.setattr(segments, "BLOCK_BYTES", 5000)  # questions in some blocks
    assert rows_of(retrieval.bm25_search(asked, stored, top)) == rows_of(got) == rows_of(retrieval.bm25(asked, docs, top))


def test_segments_equal_an_index_made_anew(spark, corpus_and_questions, tmp_path, monkeypatch):
    docs, asked = corpus_and_questions
    path, anew = str(tmp_path / "i"), str(tmp_path / "j")
    retrieval.write_bm25(docs.where("doc_id < 300").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("w1 w2 other words")).otherwise(F.col("text"))), path)
    none = docs.select("doc_id").limit(0)
    retrieval.update_bm25(docs.where("doc_id >= 300 or doc_id % 10 = 0"), none, path)
    retrieval.update_bm25(docs.limit(0), docs.where("doc_id % 7 = 3").select("doc_id"), path)
    retrieval.update_bm25(docs.where("doc_id = 10"), none, path)  # comes back
    live = docs.where("doc_id % 7 != 3 or doc_id = 10")
    retrieval.write_bm25(live, anew)
    a, b = retrieval.load_bm25(spark, path, documents=live.count()), retrieval.load_bm25(spark, anew)
    assert len(versions.state(spark, path)["segments"]) == 4
    assert rows_of(retrieval.bm25_search(asked, a)) == rows_of(retrieval.bm25_search(asked, b))
    assert rows_of(a.postings.drop("bucket")) == rows_of(b.postings.drop("bucket")) and rows_of(a.lengths) == rows_of(b.lengths)
    assert rows_of(a.terms.select("term", "df", F.round("idf", 9))) == rows_of(b.terms.select("term", "df", F.round("idf", 9)))
    segments.merge(spark, path, retrieval.TOKENIZER)
    assert len(versions.state(spark, path)["segments"]) == 1
    assert rows_of(retrieval.bm25_search(asked, retrieval.load_bm25(spark, path))) == rows_of(retrieval.bm25_search(asked, b))
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 1)
    retrieval.update_bm25(docs.limit(0), live.select("doc_id"), path)  # nothing is left
    left = retrieval.load_bm25(spark, path, documents=0)
    assert len(versions.state(spark, path)["segments"]) == 1 and retrieval.bm25_search(asked, left).count() == 0


def vectors(n, seed, groups=12, dim=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    own = middle[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dim))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(own)]


def test_ann(spark, tmp_path):
    rows = vectors(1560, 1)
    rows, others = rows[:1500], rows[1500:]
    table = spark.createDataFrame([*rows, (9999, None), (None, rows[0][1]), (9998, [])], "vec_id long, embedding array<float>").repartition(4)
    path = str(tmp_path / "ann")
    with pytest.raises(retrieval.IndexUnavailable):
        ann.load_ann(spark, path)
    ann.write_ann(table, path, cells=30, recall=0.95)
    stored = ann.load_ann(spark, path)
    assert stored.centroids.shape == (30, 16) and 1 <= stored.probes < 30 and stored.cells.count() == 1500
    asked = spark.createDataFrame([(i, v) for i, v in others] + [(99, None)], "qid long, qvec array<float>")
    usable = table.where("vec_id is not null and vec_id < 9990")
    exact = retrieval.dense(asked, usable, 10)
    got = ann.search(asked, stored, 10)
    share = ann.recall(got, exact).agg(F.avg("recall")).first()[0]
    assert share >= 0.9
    whole = ann.search(asked, stored, 10, probes=30, rerank=400)
    assert rows_of(whole.select("qid", "vec_id", "ann_score", "ann_rank")) == rows_of(exact)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan
    # New vectors are found without another build; the old cells stay as they are.
    ann.add(spark, path, spark.createDataFrame([(5000, rows[7][1])], "vec_id long, embedding array<float>"))
    one = spark.createDataFrame([(0, rows[7][1])], "qid long, qvec array<float>")
    assert {r.vec_id for r in ann.search(one, ann.load_ann(spark, path), 2).collect()} == {7, 5000}
    assert ann.search(asked.limit(0), stored).count() == 0
    with pytest.raises(ValueError):
        ann.write_ann(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), path)


def test_ann_with_all_cells_is_exact(spark, tmp_path):
    """Far more vectors near a question, and copies, than codes are scored again: every cell read gives the exact rows."""
    rng = np.random.default_rng(3)
    own = np.ones(8) + np.concatenate([0.002 * rng.normal(size=(300, 8)), np.repeat(0.001 * rng.normal(size=(1, 8)), 200, axis=0), rng.normal(size=(60, 8))])
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    rows = [(int(k), v.astype(np.float32).tolist()) for k, v in zip(rng.permutation(len(own)), own)]
    table, path = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), str(tmp_path / "near")
    ann.write_ann(table, path, cells=4)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (0, 7, 400, 520)], "qid long, qvec array<float>")
    got = ann.search(asked, ann.load_ann(spark, path), 10, probes=4, rerank=10)
    assert rows_of(got.select("qid", "vec_id", "ann_score", "ann_rank")) == rows_of(retrieval.dense(asked, table, 10))


def test_ann_of_nothing_and_of_one(spark, tmp_path):
    path = str(tmp_path / "ann")
    schema = "vec_id string, embedding array<double>"
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvec array<double>")
    ann.write_ann(spark.createDataFrame([("a", [0.6, 0.8])], schema), path)
    assert [(r.qid, r.vec_id, r.ann_score) for r in ann.search(asked, ann.load_ann(spark, path)).collect()] == [("q", "a", 0.6)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(rows, "page_id string, chunk_id string, text string")
    assert versions.read(spark, path) is None and versions.state(spark, path) is None
    first = versions.replace(spark, path, table(("a", "a0", "x"), ("a", "a1", "y"), ("b", "b0", "z"), (None, "n", "w")), buckets=4)
    second = versions.replace(spark, path, table(("a", "a0", "new")), table(("b", "", "")).select("page_id"))
    assert (first, second) == (1, 2)
    assert sorted(r.text for r in versions.read(spark, path).collect()) == ["new", "w"]
    assert sorted(r.text for r in versions.read(spark, path, 1).collect()) == ["w", "x", "y", "z"]
    assert versions.replace(spark, path, table().limit(0)) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, {}, after=1)
    versions.clean(spark, path)
    assert versions.state(spark, path, 1) is None and sorted(r.text for r in spark.read.parquet(path).collect()) == ["new", "w"]
    versions.replace(spark, path, table().limit(0), table((None, "", ""), ("a", "", "")).select("page_id"))
    assert versions.read(spark, path).count() == 0


HTML = "<html><body><main><h1>T{0}</h1><p>" + "Some words stand here, number {0}. " * 40 + "</p></main></body></html>"


def test_a_run_that_breaks_off_is_not_seen(spark, tmp_path):
    """Killed while it embeds, after the new chunks were written: readers have the old index, and the next run mends it."""
    path = str(tmp_path / "idx")
    pages = lambda *rows: spark.createDataFrame([(p, HTML.format(w), f"S{p}", f"https://x.org/{p}") for p, w in rows], "page_id string, html string, scheme string, source_url string")
    build = lambda source, **more: index.build(spark, source, path, min_chars=100, **more)
    assert build(pages(("1", "one"), ("2", "two"), ("3", "three"))) == {"new": 3}

    def seen():
        chunks, vectors, bm25 = index.tables(spark, path)
        return rows_of(chunks), rows_of(vectors.select("vec_id")), rows_of(bm25.lengths)

    before = seen()

    def broken(batch, dim):
        raise RuntimeError("killed")

    then = pages(("1", "changed"), ("3", "three"), ("4", "four"))
    with pytest.raises(Exception, match="killed"):
        build(then, embed=broken)
    assert seen() == before and index.missing_parts(spark, path) == []
    assert build(then) == {"replace": 2, "skip": 1}
    chunks, vectors, bm25 = seen()
    assert {r[1] for r in chunks} == {"1", "3", "4"} and "changed" in str(chunks) and [r[0] for r in chunks] == [r[0] for r in vectors] == [r[0] for r in bm25]
    assert build(then) == {"skip": 3} and seen() == (chunks, vectors, bm25)
    # One changed page writes one segment.
    assert build(pages(("1", "changed"), ("3", "other"), ("4", "four"))) == {"replace": 1, "skip": 2}
    assert len(versions.state(spark, path + "-bm25")["segments"]) == 2
    anew = str(tmp_path / "anew")
    index.build(spark, pages(("1", "changed"), ("3", "other"), ("4", "four")), anew, min_chars=100)
    asked = spark.createDataFrame([(0, "number other words"), (1, "changed four")], "qid long, question string")
    assert rows_of(retrieval.bm25_search(asked, index.tables(spark, path)[2])) == rows_of(retrieval.bm25_search(asked, index.tables(spark, anew)[2]))


def test_purge(spark, tmp_path):
    path = str(tmp_path / "c")
    ingest.write_index(spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "page_id string, chunk_id string, text string"), path)
    assert ingest.purge_pages(spark, path, spark.createDataFrame([("b",), ("zz",)], "page_id string")) == 1
    assert [r.page_id for r in ingest.read_chunks(spark, path).collect()] == ["a"]
