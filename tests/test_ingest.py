import shutil

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import chunking, evaluation, ingest, pages, profiling
from corpusforge.sources import corpus, http
from corpusforge.streaming import ingest_stream

HTML = """<html><body><nav>Menu here</nav><main><h1>Scheme page</h1><header><span>Very High Risk</span></header><div><div>Exit load</div><div>1% within a year</div></div>
<p>This scheme page states facts about a fund, its charges and its terms, in whole sentences that are long enough to count as a content root for the parser under test here.</p>
<table aria-label="Costs"><tr><th>Kind</th><th>Value</th></tr><tr><td>Only</td></tr></table><ul><li>First item</li></ul><button>Log in</button><div class="newsletterSignup">Join</div><a>Share this</a></main>
<footer>Imprint</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_blocks():
    blocks = pages.parse_blocks(HTML)
    kinds = {k for k, _, _ in blocks}
    texts = [t for _, t, _ in blocks]
    assert {"heading", "paragraph", "table_row", "list_item", "fact_row", "text"} <= kinds
    assert "Exit load | 1% within a year" in texts and "Very High Risk" in texts
    assert "Costs | Kind | Value" in texts and "Costs | Costs | Only" in texts
    assert not any(x in " ".join(texts) for x in ("Menu", "Log in", "Join", "Share this", "var x", "Imprint"))
    assert len(texts) == len(set(texts)) and blocks[0] == ("heading", "Scheme page", "Scheme page")
    assert pages.parse_blocks("") == [] and pages.parse_blocks("<p>a<p>b") == [("paragraph", "a", None), ("paragraph", "b", None)]


def test_plan(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "page_id string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("e", "5")], "page_id string, content_hash string")
    there = spark.createDataFrame([("a",), ("b",), ("e",), ("a",)], "page_id string")
    assert {r.page_id: r.action for r in ingest.plan(current, old, there).collect()} == {"a": "skip", "b": "replace", "c": "new", "d": "new", "e": "purge"}
    assert {r.action for r in ingest.plan(current, old, there, reindex=True).where("page_id = 'a'").collect()} == {"replace"}
    assert [r[0] for r in ingest.orphans(there, current).collect()] == ["e"]


def test_ingest_twice_is_the_same(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([("a", "One two three. " * 30), ("b", "Four five six. " * 30)], "page_id string, text string")
    assert not ingest.index_present(spark, path)
    for _ in range(2):
        ingest.write_index(chunking.chunk_documents(docs, 30, 5), path)
    assert ingest.index_present(spark, path)
    count = spark.read.parquet(path).count()
    ingest.write_index(chunking.chunk_documents(spark.createDataFrame([("a", "Short.")], "page_id string, text string"), 30, 5), path)
    after = spark.read.parquet(path)
    assert after.where("page_id = 'a'").count() == 1 and after.where("page_id = 'b'").count() == count - chunking.chunk_documents(docs.where("page_id = 'a'"), 30, 5).count()


def test_upsert_and_dim(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, page_id string")
    new = spark.createDataFrame([(2, "c"), (3, "c")], "chunk_id int, page_id string")
    assert sorted(map(tuple, ingest.upsert(old, new).collect())) == [(1, "a"), (2, "c"), (3, "c")]
    vectors = ingest.hash_embed(spark.createDataFrame([(1, "x"), (2, None)], "doc_id int, text string"), 8)
    ingest.check_dim(vectors, 8)
    with pytest.raises(ValueError):
        ingest.check_dim(vectors, 9)
    assert profiling.integrity(vectors).first().bad_norms == 0
    chunks = spark.createDataFrame([("a", 5), ("b", 300)], "chunk_id string, token_count int")
    assert ingest.check_fits(chunks.limit(1), 256).count() == 1
    with pytest.raises(Exception, match="ceiling"):
        ingest.check_fits(chunks, 256).collect()


def test_stream(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "page_id string, text string"
    spark.createDataFrame([("a", "One two. " * 20), ("b", "Three. " * 5)], schema).write.parquet(source)
    for _ in range(2):
        ingest_stream.ingest_pages(spark.readStream.schema(schema).parquet(source), index, str(tmp_path / "cp"), 20, 4).awaitTermination()
    assert spark.read.parquet(index).select("page_id").distinct().count() == 2
    assert "token" in ingest_stream.redacted(spark.createDataFrame([("token = x",)], "text string")).first().text


def test_sources(spark, tmp_path):
    good = str(tmp_path / "c.json")
    spark.createDataFrame([("p1", "S", "c", "https://x.org/1")], corpus.CORPUS).coalesce(1).write.json(good)
    assert corpus.load_corpus(spark, good).count() == 1
    bad = spark.createDataFrame([("p1", "S", "c", "ftp:x"), ("p1", "S", "c", "https://x.org"), (None, "S", "c", "https://y.org")], corpus.CORPUS)
    assert sorted(r.problem for r in corpus.violations(bad).collect()) == ["missing", "repeated", "url"]
    assert corpus.threshold("0.5", None) == 0.5
    with pytest.raises(ValueError):
        corpus.threshold(None, None)
    links = spark.createDataFrame([("opinion", "https://a.org", "A", "me", "d"), ("default", "https://d.org", "D", "me", "d"), ("x", "https://x.org", "X", None, None)], "intent string, url string, title string, verified_by string, verified_on string")
    asked = spark.createDataFrame([("opinion",), ("x",), ("other",)], "intent string")
    assert {r.intent: r.title for r in corpus.link_for(asked, links).collect()} == {"opinion": "A", "x": "D", "other": "D"}


def test_http(spark):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise OSError("down")
        return "text"

    assert http.attempt(flaky, 2, lambda n: 0) == "text" and len(tries) == 2
    with pytest.raises(ValueError):
        http.attempt(lambda: "", 2, lambda n: 0)


def test_sweep_and_choose(spark):
    rows = [(0.9, True, True, True), (0.7, True, True, False), (0.6, False, True, False), (0.3, False, True, False)]
    obs = spark.createDataFrame(rows, "raw_dense_max double, answerable boolean, gate_routed boolean, facts_in_context boolean")
    by = {r.threshold: r for r in evaluation.sweep(obs).collect()}
    assert len(by) == 96 and (by[0.6].factual_passed, by[0.6].negatives_passed) == (2, 1) and (by[0.61].negatives_passed, by[0.71].factual_passed) == (0, 1)
    best = evaluation.choose(obs).first()
    assert best.feasible and best.threshold == 0.65
    assert evaluation.choose(obs.where("answerable")).first().rule == "missing_class"
    assert evaluation.choose(obs.withColumn("answerable", ~F.col("answerable"))).first().rule == "overlap"


def test_metrics_unavailable(spark):
    checks = spark.createDataFrame([(1, "M-2", "x", True), (1, "M-3", "y", False)], "id int, metric string, name string, passed boolean")
    by = {r.metric: r.status for r in evaluation.metrics(checks).collect()}
    assert by["M-2"] == "pass" and by["M-3"] == "fail" and by["M-1"] == "unavailable" and len(by) == 7


def test_generator_retries_passing_faults_only():
    import urllib.error

    sent = []

    def send(url, body, key):
        sent.append(body)
        if len(sent) == 1:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        if body["model"] == "bad":
            raise urllib.error.HTTPError(url, 400, "no", None, None)
        return {"choices": [{"message": {"content": "It is so [S1]."}}]}

    ask = http.generator("http://x", "m", send=send)
    assert ask("q", [{"text": "t"}]) == "It is so [S1]." and len(sent) == 2
    with pytest.raises(urllib.error.HTTPError):
        http.generator("http://x", "bad", send=send)("q", [])
    assert len(sent) == 3


def test_command_line_ingest(spark, tmp_path):
    """Twice the same; then a page changes, one turns thin, one leaves, and one comes."""
    from corpusforge.__main__ import main
    from corpusforge.operators import retrieval

    source, index = str(tmp_path / "pages"), str(tmp_path / "idx")
    body = "<html><body><main><h1>T{0}</h1><p>" + "Some words stand here. " * 40 + "</p></main></body></html>"
    schema = "page_id string, html string, scheme string, source_url string"

    def run(rows, code):
        spark.createDataFrame([(p, h, f"Scheme {p}", f"https://x.org/{p}") for p, h in rows], schema).write.mode("overwrite").parquet(source)
        assert main(["ingest", source, index, "--min-chars", "200"]) == code
        chunks = ingest.read_chunks(spark, index)
        assert retrieval.load_bm25(spark, index + "-bm25", documents=chunks.count()) and spark.read.parquet(index + "-vectors").count() == chunks.count()
        return {p: sorted(map(str, (r for r in chunks.collect() if r.page_id == p))) for p in "1 2 3 4 thin".split()}

    first = run([*((str(i), body.format(i)) for i in (1, 2, 3)), ("thin", "<p>x</p>")], 1)
    assert all(first[p] for p in "123") and not first["thin"]
    files = lambda: {r[0] for r in spark.read.parquet(index + "-vectors").select(F.input_file_name()).collect()}
    before = files()
    assert run([*((str(i), body.format(i)) for i in (1, 2, 3)), ("thin", "<p>x</p>")], 1) == first
    assert files() == before  # nothing was embedded again
    manifest = spark.read.parquet(index + "-manifest")
    assert manifest.count() == 3 and {r.source_url for r in manifest.collect()} == {f"https://x.org/{i}" for i in (1, 2, 3)}
    facts = spark.read.json(index + "-manifest-facts").first()
    assert (facts.pages, facts.chunk_size, facts.chunk_overlap, facts.embedding_dim) == (3, 200, 40, 384)
    then = run([("1", body.format("new") + "More."), ("2", "<p>thin now</p>"), ("4", body.format(4))], 1)
    assert then["1"] and then["1"] != first["1"] and then["2"] == first["2"] and not then["3"] and then["4"]
    assert {r.page_id for r in spark.read.parquet(index + "-manifest").collect()} == {"1", "2", "4"}
    assert run([("1", body.format("new") + "More."), ("4", body.format(4))], 0)["2"] == []


def test_missing_index_is_built(spark, tmp_path, capsys):
    from corpusforge.__main__ import main
    from corpusforge.operators import index

    source, path = str(tmp_path / "pages"), str(tmp_path / "idx")
    schema = "page_id string, html string, scheme string, source_url string"

    def pages(*rows):
        spark.createDataFrame([(p, h, f"Scheme {p}", f"https://x.org/{p}") for p, h in rows], schema).write.mode("overwrite").parquet(source)

    with pytest.raises(index.DeploymentError, match="broke off"):
        index.ensure(spark, source, path)
    pages(("1", "<p>x</p>"))
    with pytest.raises(index.DeploymentError, match="1 pages .* failed"):
        index.ensure(spark, source, path)
    pages(("1", "<main></main>"))
    with pytest.raises(index.DeploymentError, match="no chunk"):
        index.ensure(spark, source, path, min_chars=0)
    pages(*((str(i), f"<main><h1>Fund {i}</h1><p>The exit load of fund {i} is {i}% within a year. " + "More words stand here. " * 100 + "</p></main>") for i in (1, 2, 3)))
    assert index.missing_parts(spark, path) == ["chunks", "vectors", "BM25 tables"]
    assert index.ensure(spark, source, path) == {"new": 3}
    assert index.ensure(spark, source, path) == {}
    shutil.rmtree(path + "-bm25")
    assert index.missing_parts(spark, path) == ["BM25 tables"]
    assert main(["ask", path, "What is the exit load of fund 2?", "--pages", source, "--threshold", "-1"]) == 0
    assert index.missing_parts(spark, path) == [] and "https://x.org/" in capsys.readouterr().out


def test_chunks_with_provenance(spark):
    blocks = [(0, "heading", "Costs", "Costs"), (1, "heading", "Exit load", "Exit load"), (2, "paragraph", "It is 1%.", "Exit load"), (3, "paragraph", " ", None), (4, "list_item", "Exit load is due", "Exit load"), (5, "paragraph", "One two three. " * 30, None), (6, "heading", "Tail", "Tail")]
    rows = spark.createDataFrame([("p", *b) for b in blocks] + [("q", 0, "heading", "Only", None)], "page_id string, ordinal int, kind string, text string, section string")
    pages_of = spark.createDataFrame([("p", "Fund A", "https://x.org/p"), ("q", None, None)], "page_id string, scheme string, source_url string")
    got = [r for r in chunking.chunk_blocks(rows, pages_of, 50, 10).orderBy("page_id", "ordinal").collect()]
    texts = [r.text for r in got if r.page_id == "p"]
    assert texts[:2] == ["Fund A (Exit load) Exit load: It is 1%.", "Fund A (Exit load) Exit load is due"] and texts[-1] == "Fund A Tail"
    assert all(r.token_count <= 50 for r in got) and texts[2].startswith("Fund A One two three.") and len(texts) > 5
    flat = "\n".join(b[2] for b in blocks)
    assert flat[got[0].char_start : got[0].char_end] == "It is 1%." and (got[len(texts) - 1].char_start, got[len(texts) - 1].char_end) == (0, len(flat))
    assert [r.ordinal for r in got if r.page_id == "p"] == list(range(len(texts))) and got[0].source_url == "https://x.org/p" and got[0].category is None
    assert got[-1].text == "Only" and len({r.chunk_id for r in got}) == len(got)
    heavy = chunking.chunk_blocks(spark.createDataFrame([("p", 0, "paragraph", "CAGR is high", None), ("p", 1, "paragraph", "Fee", None)], rows.schema), pages_of, drop_return_heavy=True).collect()
    assert [(r.ordinal, r.text) for r in heavy] == [(0, "Fund A Fee")]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_blocks(rows, pages_of, size, overlap)


def test_pack_counts_as_it_goes():
    import random

    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(" ".join(rng.choice(["a", "b1", "c-d", "x.y"]) for _ in range(rng.randrange(1, 30))).capitalize() + "." for _ in range(rng.randrange(8)))
        for piece in chunking.pack(text, 20, 5):
            assert len(chunking.TOKEN.findall(piece)) <= 20 and all(w in text.split() for w in piece.split())
        seen = {w for p in chunking.pack(text, 20, 5) for w in p.split()}
        assert seen == set(text.split())
    assert chunking.pack("Short  text. Here", 20, 5) == ["Short  text. Here"] and chunking.pack(" ", 5, 1) == []


def test_raw_pages_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"abc \xff def")
    (tmp_path / "empty.html").write_bytes(b"")
    rows = corpus.raw_pages(spark, str(tmp_path)).collect()
    assert [r.html for r in rows] == ["abc \ufffd def"]
    listed = spark.createDataFrame([("a", "https://x.org/a"), ("b", "https://x.org/b"), ("bad", "https://x.org/bad")], "page_id string, source_url string")

    def get(url):
        if url.endswith("bad"):
            raise OSError("down")
        return "fetched " + url

    got = {r.page_id: r for r in corpus.cached_or_fetched(spark, listed, str(tmp_path), get).collect()}
    assert got["a"].from_cache and got["b"].html == "fetched https://x.org/b" and not got["b"].from_cache and "down" in got["bad"].error
    assert not any(r.from_cache for r in corpus.cached_or_fetched(spark, listed.limit(1), str(tmp_path), get, refresh=True).collect())


def test_stream_takes_the_last_version(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "page_id string, text string, fetched_at long"
    spark.createDataFrame([("a", "Old words. ", 1), ("a", "New words.", 2), ("a", "Older words.", 0)], schema).write.parquet(source)
    ingest_stream.ingest_pages(spark.readStream.schema(schema).parquet(source), index, str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in spark.read.parquet(index).collect()] == ["New words."]


def test_links_and_reports(spark, tmp_path):
    schema = "intent string, url string, title string, verified_by string, verified_on string"
    links = spark.createDataFrame([("default", "https://b.org", "B", "me", "d"), ("default", "https://a.org", "A", "me", "d")], schema)
    assert [r.url for r in corpus.link_for(spark.createDataFrame([("x",), ("y",)], "intent string"), links).collect()] == ["https://a.org"] * 2
    assert corpus.link_for(spark.createDataFrame([("x",)], "intent string"), links.limit(0)).first().url is None
    rows = spark.createDataFrame([("M-1", 1, "a|b")], "metric string, numerator int, status string")
    assert evaluation.report(rows).splitlines()[-1] == "| M-1 | 1 | a\\|b |"
    evaluation.capture(spark.createDataFrame([(1, "x")], "id int, answer string"), rows, str(tmp_path / "run"), model="m", threshold=0.5)
    assert sorted(r.kind for r in spark.read.json(str(tmp_path / "run")).collect()) == ["facts", "metric", "outcome"]
    assert corpus.storage_paths(["a.parquet", "b.bin", "c.LOG"]) == ["a.parquet", "c.LOG"]
    path = str(tmp_path / "c")
    spark.createDataFrame([("p", "S", "c", "https://x.org/1", 400)], corpus.CORPUS + ", min_extract_chars int").write.json(path)
    assert corpus.load_corpus(spark, path, 400).columns == ["page_id", "scheme", "category", "source_url"]
    with pytest.raises(ValueError, match="400"):
        corpus.load_corpus(spark, path, 500)


def test_content_roots():
    long = "Words of the page that are read. " * 10
    for root in ('<div class="x layout-main">{}</div>', '<section role="main">{}</section>', "<article>{}</article>", '<div class="pw14MainWrapper">{}</div>'):
        assert [t for _, t, _ in pages.parse_blocks(f"<body><p>Outside it</p>{root.format(f'<p>{long}</p>')}</body>")] == [long.strip()]


def test_chunk_integrity_and_dump(spark):
    rows = spark.createDataFrame([("c1", "p", "x", "https://a.org"), ("c2", "p", " x ", "ftp:a"), ("c3", "q", " ", None)], "chunk_id string, page_id string, text string, source_url string")
    assert tuple(profiling.chunk_integrity(rows).first()) == (3, 1, 2, 1)
    assert [r.chunk_id for r in profiling.dump(rows, only="p", most=1).collect()] == ["c1"]


def test_ollama():
    sent = []
    ask = http.ollama("http://x/api/chat", "m", send=lambda url, body, key: sent.append(body) or {"message": {"content": "It is so [S1]."}})
    assert ask("q", [{"text": "t"}]) == "It is so [S1]." and sent[0]["options"] == {"temperature": 0, "num_predict": 400}


def test_seen_texts():
    """Both ways to look for a text in texts against plain search."""
    import random

    rng = random.Random(2)
    for plain in (0, 3, 10**6):
        for _ in range(200):
            texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(60))).strip() for _ in range(8)]
            seen, known = pages.Seen(texts[:3]), texts[:3]
            seen.PLAIN = plain
            for t in [*texts[3:], *(x[2:20] for x in texts), "b", "ab"]:
                if t:
                    assert seen.holds(t) == any(t in k for k in known)
                    if not seen.holds(t):
                        seen.add(t)
                        known.append(t)


def test_judged_metric(spark):
    checks = spark.createDataFrame([(1, "M-2", "x", True)], "id int, metric string, name string, passed boolean")
    scores = lambda *s: spark.createDataFrame([(x,) for x in s], "score int")
    one = lambda v: next(tuple(r) for r in evaluation.metrics(checks, v).collect() if r.metric == "M-1")
    assert one(scores(2, 2, 1)) == ("M-1", 5, 6, "pass") and one(scores(2, 1, 1)) == ("M-1", 4, 6, "fail") and one(scores(2, None)) == ("M-1", 0, 0, "unavailable") and one(scores()) == ("M-1", 0, 0, "unavailable")
