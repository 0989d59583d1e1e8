import math

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import retrieval


@pytest.fixture(scope="module")
def hits(spark):
    dense = spark.createDataFrame([(0, "a", 0.9, 1), (0, "b", 0.8, 2), (1, "a", 0.4, 1)], "qid long, chunk_id string, dense_score double, dense_rank int")
    sparse = spark.createDataFrame([(0, "b", 5.0, 1), (0, "c", 4.0, 2)], "qid long, chunk_id string, sparse_score double, sparse_rank int")
    return dense, sparse


def test_rrf_worked_example():
    assert round(1 / 62 + 1 / 61, 6) == 0.032522 and round(1 / 61 + 1 / 66, 6) == 0.031545


def test_fuse_order_and_penalty(spark, hits):
    dense, sparse = hits
    plain = spark.createDataFrame([(c, False) for c in "abc"], "chunk_id string, return_heavy boolean")
    rows = retrieval.fuse(dense, sparse, plain).where("qid = 0").orderBy("fused_rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"] and rows[2].dense_score == retrieval.NO_MATCH and "score" not in rows[0].asDict()
    heavy = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "chunk_id string, return_heavy boolean")
    rows = retrieval.fuse(dense, sparse, heavy, penalty=0.4).where("qid = 0").orderBy("fused_rank").collect()
    assert [r.chunk_id for r in rows] == ["a", "c", "b"]
    assert [r.chunk_id for r in retrieval.fuse(dense, sparse, heavy, penalty=1.0).where("qid = 0").orderBy("fused_rank").collect()] == ["b", "a", "c"]


def test_gate(spark, hits):
    dense, sparse = hits
    plain = spark.createDataFrame([(c, False) for c in "abc"], "chunk_id string, return_heavy boolean")
    fused = retrieval.fuse(dense, sparse, plain)
    questions = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    rows = {r.qid: r for r in retrieval.gate(questions, fused, dense, 0.9).collect()}
    assert [rows[i].reason for i in range(3)] == ["ok", "below_threshold", "no_candidates"] and rows[2].raw_dense_max == -1.0
    with pytest.raises(ValueError):
        retrieval.gate(questions, fused, dense, None)


def test_bm25_against_formula(spark):
    texts = ["red red blue", "blue green", "red", "", "green green green blue"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "red blue blue"), (1, "none")], "qid long, question string")
    got = {(r.qid, r.doc_id): r.sparse_score for r in retrieval.bm25(asked, docs).collect()}
    n, lengths = 5, [len(t.split()) for t in texts]
    average = sum(lengths) / n
    raw = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w, df in {"red": 2, "blue": 3, "green": 2}.items()}
    floor = 0.25 * sum(raw.values()) / 3
    for i, t in enumerate(texts):
        score = 0.0
        for w in "red blue blue".split():
            tf = t.split().count(w)
            score += (raw[w] if raw[w] >= 0 else floor) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[i] / average))
        assert (0, i) in got if score > 0 else (0, i) not in got
        assert score <= 0 or abs(got[0, i] - score) < 1e-4
    assert not any(q == 1 for q, _ in got)


def test_dense_is_exact_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(0)
    unit = lambda: [x / 2 for x in rng.choice([[1.0, 1, 1, 1], [2.0, 0, 0, 0], [0, 2.0, 0, 0], [1, -1, 1, -1]])]
    vectors = [(i, unit()) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in vectors[:6]] + [(7, None)], "qid long, qvec array<double>")
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 200)
    got = retrieval.dense(asked, df, 4).collect()
    for q, v in vectors[:6]:
        best = sorted((-round(sum(a * b for a, b in zip(v, w)), 6), i) for i, w in vectors[:50])[:4]
        assert [(-r.dense_score, r.vec_id) for r in sorted(got, key=lambda r: r.dense_rank) if r.qid == q] == best
    assert retrieval.dense(asked.limit(0), df).count() == 0
    assert spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(retrieval.norm(F.col("v"))).first()[0] == 5.0


def test_stored_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bm25")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red red blue", "blue green", "red", "", "green green green blue"])], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "red blue blue"), (1, "none"), (2, None)], "qid long, question string")
    with pytest.raises(retrieval.IndexUnavailable):
        retrieval.load_bm25(spark, path)
    for _ in range(2):
        retrieval.write_bm25(docs, path)
    index = retrieval.load_bm25(spark, path, documents=5)
    assert sorted(map(tuple, retrieval.bm25_search(asked, index).collect())) == sorted(map(tuple, retrieval.bm25(asked, docs).collect()))
    with pytest.raises(retrieval.IndexMismatch):
        retrieval.load_bm25(spark, path, documents=6)
    monkeypatch.setattr(retrieval, "TOKENIZER", "other")
    with pytest.raises(retrieval.IndexMismatch):
        retrieval.load_bm25(spark, path)


def test_equal_texts_rank_by_key(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c x", "a b c y", "a b c z", "q", "r", "s", "t"])], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "c b a")], "qid long, question string")
    assert [r.doc_id for r in retrieval.bm25(asked, docs).orderBy("sparse_rank").collect()] == [0, 1, 2]


def test_searches_of_many_questions_stay_within_their_slices(monkeypatch):
    """Slices so small that each question is one, and ties across them: the same rows; what waits is bounded."""
    import numpy as np
    import pyarrow as pa

    from corpusforge.operators import best, segments

    lists = lambda k: pa.array([[(i * k) % 5 + 1 for i in range(9)], [i % 3 + 1 for i in range(7)]], pa.list_(pa.int32()))
    keys = pa.array([list(range(9)), list(range(1, 8))], pa.list_(pa.int64()))
    cell = pa.table({"term": ["a", "b"], "bound": [2.5, 2.5], "keys": keys, "tfs": lists(2), "dls": lists(3), "dead": pa.array([[4], [4]], pa.list_(pa.int64()))})
    asked = {"a": (np.arange(40), np.arange(40) % 4 + 0.5), "b": (np.arange(0, 40, 2), np.ones(20))}
    found = []
    for cells in (1 << 20, 4):
        monkeypatch.setattr(segments, "CELLS", cells)
        scorer = segments._Scorer(asked, 40, 3, 2.0)
        scorer.cell(cell, 1.0)
        scorer.best.settle()
        found.append([x.tolist() for x in scorer.best.found[0]])
    assert found[0] == found[1] and len(found[0][0]) == 120 and 4 not in found[0][1]
    kept = best.Best(2, 2)
    for part in range(50):
        kept.add(np.array([0, 1, 1]), np.array([99 - part, part, part + 100]), np.array([1.0, part, 7.0]))
        assert kept.waiting <= 4 * 2 * 2 + 3
    kept.settle()
    assert [x.tolist() for x in kept.found[0]] == [[0, 0, 1, 1], [50, 51, 49, 48], [1.0, 1.0, 49.0, 48.0]]


def test_common_terms_of_many_questions_are_not_added_one_by_one(monkeypatch):
    """2,000 questions with common and rare terms over 400 documents: the best by plain sums, from few single additions."""
    import numpy as np
    import pyarrow as pa

    from corpusforge.operators import segments

    rng = np.random.default_rng(0)
    n, docs, added = 2000, 400, []
    dls = rng.integers(5, 200, docs)
    held = [np.arange(docs)] * 3 + [np.sort(rng.choice(docs, 2, False)) for _ in range(30)]
    tfs = [rng.integers(1, 9, len(h)) for h in held]
    column = lambda parts, kind: pa.array([np.asarray(p) for p in parts], pa.list_(kind))
    cell = pa.table({"term": [f"t{i}" for i in range(33)], "bound": [2.5] * 33, "keys": column(held, pa.int64()), "tfs": column(tfs, pa.int32()), "dls": column([dls[h] for h in held], pa.int32()), "dead": pa.nulls(33, pa.list_(pa.int64()))})
    who = [np.arange(n)] * 3 + [np.sort(rng.choice(n, 5, False)) for _ in range(30)]
    asked = {f"t{i}": (w, rng.random(len(w)) * (1 if i < 3 else 9)) for i, w in enumerate(who)}
    plain = np.zeros((n, docs))
    for i, (w, weight) in enumerate(asked.values()):
        impact = tfs[i] * 2.5 / (tfs[i] + 1.5 * (0.25 + 0.75 * dls[held[i]] / 100.0))
        plain[np.ix_(w, held[i])] += np.outer(weight, impact)
    scorer, count = segments._Scorer(asked, n, 2, 100.0), np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: added.append(len(x)) or count(x, *a, **b))
    scorer.cell(cell, 1.0)
    scorer.best.settle()
    q, keys, score = scorer.best.found[0]
    best = np.argsort(-np.round(plain, 9), axis=1, kind="stable")[:, :2]
    assert np.array_equal(q, np.repeat(np.arange(n), 2)) and np.array_equal(keys, best.ravel())
    assert np.allclose(score, plain[q, keys], atol=2e-9)
    assert sum(added) < n * 3 * docs / 10


def test_questions_in_blocks_share_one_dealing_of_the_index(spark, tmp_path, monkeypatch):
    from corpusforge.operators import segments

    path = str(tmp_path / "bm25")
    retrieval.write_bm25(spark.createDataFrame([(i, f"red w{i} w{i % 7}") for i in range(40)], "doc_id long, text string"), path)
    asked = spark.createDataFrame([(i, f"red w{i % 7} w{i}") for i in range(30)], "qid long, question string")
    whole = sorted(map(tuple, retrieval.bm25_search(asked, retrieval.load_bm25(spark, path), 3).collect()))
    monkeypatch.setattr(segments, "BLOCK_BYTES", 500)
    rows = segments.scores(asked, retrieval.load_bm25(spark, path), 3, "qid", "question")
    assert rows.count() > 0
    got = rows.where("key is not null")
    assert sorted(map(tuple, retrieval.bm25_search(asked, retrieval.load_bm25(spark, path), 3).collect())) == whole
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") > 2 and plan.count("ReusedExchange") >= plan.count("MapInArrow") - 1
