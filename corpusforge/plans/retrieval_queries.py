"""Search, fusion, gate and index queries: benchmark items are the questions, documents the chunks."""

from __future__ import annotations

import uuid

from corpusforge.functions import prompts
from corpusforge.functions import text as T
from corpusforge.operators import ann, answers, chunking, evaluation, ingest, profiling, retrieval, search
from corpusforge.plans.base import F, documents, quoted, table, values
from corpusforge.plans.text_queries import TOKENS
from corpusforge.session import fingerprint, shared_folder, stored
from corpusforge.sources import corpus

THRESHOLD = 0.3
FAULTS = [(0, "https://x.example.org/a"), (-1, "ftp://x.example.org"), (-2, None), (-3, "https://two words"), (None, "https://x.example.org/b"), (-4, "https://x.example.org/c"), (-4, "https://x.example.org/d")]


def _questions(spark, d):
    """(qid, question, qvec): the vector of item i is the one with id i."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return items.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid", "left")


_stored: dict[tuple[str, str, str], tuple[str, str]] = {}


def _built(spark, d, kind, of, write):
    """Where an index of a table is, built when a session first asks for it, or the table's files are others than then."""
    at, now = (spark.sparkContext.applicationId, d, kind), fingerprint(spark, f"{d}/{of}.parquet")
    if _stored.get(at, ("", ""))[0] != now:
        path = shared_folder(spark, f"{kind}-{uuid.uuid4().hex}")
        write(table(spark, d, of), path)
        _stored[at] = (now, path)
    return _stored[at][1]


def index_of(spark, d):
    """The stored BM25 index of the documents."""
    return retrieval.load_bm25(spark, _built(spark, d, "bm25", "documents", retrieval.write_bm25))


def ann_of(spark, d):
    """The stored inverted-file index of the vectors."""
    return ann.load_ann(spark, _built(spark, d, "ann", "embeddings", ann.write_ann))


def _sparse(spark, d, top=20):
    return stored(retrieval.bm25_search(_questions(spark, d), index_of(spark, d), top), "sparse")


def _dense(spark, d, top=20):
    return retrieval.dense(_questions(spark, d), table(spark, d, "embeddings"), top)


def bm25_postings(spark, d):
    return index_of(spark, d).postings.select("term", F.col("key").alias("doc_id"), "tf")


def bm25_idf(spark, d):
    return index_of(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return _sparse(spark, d)


def bm25_work(spark, d):
    """How many posting blocks of its terms each question has, and how many could still reach its twenty best."""
    return retrieval.bm25_work(_questions(spark, d), index_of(spark, d))


def bm25_segments(spark, d):
    """An index of three runs: at first without source 5 and with other texts for source 7; then these; then source 3 leaves."""
    docs, path = documents(spark, d), shared_folder(spark, f"segments-{uuid.uuid4().hex}")
    old = docs.where(~F.col("source").eqNullSafe(F.lit("src5"))).withColumn("text", F.when(F.col("source") == "src7", F.reverse("text")).otherwise(F.col("text")))
    retrieval.write_bm25(old, path)
    retrieval.update_bm25(docs.where("source in ('src5', 'src7')"), docs.select("doc_id").limit(0), path)
    retrieval.update_bm25(docs.limit(0), docs.where("source = 'src3'").select("doc_id"), path)
    return retrieval.bm25_search(_questions(spark, d), retrieval.load_bm25(spark, path))


def dense_topk(spark, d):
    return _dense(spark, d)


def ann_topk(spark, d):
    """Hits of the inverted-file index, which reads some cells, with each question's recall against the exact search."""
    found = ann.search(_questions(spark, d), ann_of(spark, d))
    return found.join(ann.recall(found, _dense(spark, d)).select("qid", "recall"), "qid", "left")


def ann_all_cells(spark, d):
    """The same index, with every cell read: all that remains approximate is which codes are scored again."""
    index = ann_of(spark, d)
    return ann.search(_questions(spark, d), index, probes=len(index.centroids)).select("qid", "vec_id", "ann_score", "ann_rank")


def raw_dense_max(spark, d):
    best = _dense(spark, d, 1).groupBy("qid").agg(F.max("dense_score").alias("top"))
    return _questions(spark, d).select("qid").join(best, "qid", "left").select("qid", F.coalesce("top", F.lit(retrieval.NO_MATCH)).alias("raw_dense_max"))


def score_ids(spark, d):
    """Exact cosine of each question with its sparse hits."""
    return search.exact_scores(_questions(spark, d), table(spark, d, "embeddings").select("vec_id", "embedding"), _sparse(spark, d).select("qid", F.col("doc_id").alias("vec_id")))


def l2_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(retrieval.norm(F.col("embedding")), 6).alias("norm"))


def dim_check(spark, d):
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


def _fused(spark, d):
    """Legs and candidates are stored: several branches read them, and by their true sizes Spark sends them to the texts, not the texts around."""
    keep = lambda rows: stored(rows, "fused")
    found = search.retrieve(_questions(spark, d), documents(spark, d), table(spark, d, "embeddings").select("vec_id", "embedding"), index_of(spark, d), keep=keep)
    return found.dense, found.sparse, found.fused


def rrf_fusion(spark, d):
    return _fused(spark, d)[2]


def gate_decision(spark, d):
    dense, _, fused = _fused(spark, d)
    return retrieval.gate(_questions(spark, d), fused, dense, THRESHOLD)


def hybrid_search(spark, d):
    """Every question's fused candidates under an open gate."""
    dense, _, fused = _fused(spark, d)
    decided = retrieval.gate(_questions(spark, d), fused, dense, THRESHOLD).where("found_answer")
    pages = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source")
    return fused.join(decided.select("qid", "raw_dense_max"), "qid").join(pages, "chunk_id", "left")


def cited_pages(spark, d):
    pages = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source")
    return rrf_fusion(spark, d).join(pages, "chunk_id").groupBy("qid", "source").agg(F.min("fused_rank").alias("best_rank"), F.min_by("chunk_id", "fused_rank").alias("chunk_id"))


def bm25_only(spark, d):
    sparse = _sparse(spark, d).select("qid", F.col("doc_id").alias("chunk_id"))
    return sparse.join(_dense(spark, d).select("qid", F.col("vec_id").alias("chunk_id")), ["qid", "chunk_id"], "left_anti")


def hydrate_join(spark, d):
    rows = _sparse(spark, d).join(documents(spark, d).select("doc_id", "source", "lang", "text"), "doc_id")
    return rows.select("qid", "doc_id", "sparse_rank", "source", "lang", T.content_hash(F.col("text")).alias("content_hash"))


def evidence_budget(spark, d):
    """Candidates whose rendered blocks fit 6,000 characters, up to the first that doesn't."""
    return _evidence(spark, d).select("qid", "chunk_id", "fused_rank", "total")


def _evidence(spark, d):
    texts = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source", "text")
    return answers.evidence(rrf_fusion(spark, d).join(texts, "chunk_id"))


def prompt(spark, d):
    """Both turns of every question: what is told to the model, then numbered blocks of evidence and the question."""
    return answers.messages(_questions(spark, d), _evidence(spark, d)).select("qid", F.sha2(F.concat_ws("\n", "system", "user"), 256).alias("prompt_hash"))


def facts_present(spark, d):
    """Which words of a question's first sentence the evidence lacks."""
    texts = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    rows = rrf_fusion(spark, d).join(texts, "chunk_id").select("qid", F.struct("fused_rank", "text").alias("b"))
    context = rows.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("b")).getField("text"), "\n").alias("context"))
    asked = _questions(spark, d).select("qid", F.array_distinct(F.split("question", r"\s+")).alias("facts"))
    missing = evaluation.facts_missing(F.col("facts"), F.col("context"))
    return asked.join(context, "qid").select("qid", (F.size(missing) == 0).alias("all_present"), F.array_join(F.sort_array(missing), " ").alias("missing"))


def corpus_validate(spark, d):
    """The pages' problems, with planted ones: repeated and missing keys, and links that aren't any."""
    planted = spark.createDataFrame(FAULTS, "page_id long, url string")
    return corpus.violations(table(spark, d, "pages").select("page_id", "url").union(planted), "page_id", "url").groupBy("problem").agg(F.count("*").alias("n"))


def page_lookup(spark, d):
    return table(spark, d, "pages").where("page_id % 50 = 0").select("page_id", "url")


def raw_missing(spark, d):
    """Pages of documents' ids for which no page file is there, in order."""
    return documents(spark, d).select(F.col("doc_id").alias("page_id")).join(table(spark, d, "pages").select("page_id"), "page_id", "left_anti")


def distinct_pages(spark, d):
    return documents(spark, d).select("source").distinct()


def _chunks(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_id"), "text")


def upsert_chunks(spark, d):
    chunks = _chunks(spark, d)
    changed = chunks.where("page_id in ('src3', 'src7')").select((F.col("chunk_id") * 2).alias("chunk_id"), "page_id", F.upper(F.lit("new")).alias("text"))
    return ingest.upsert(chunks, changed).select("chunk_id", "page_id", F.sha2("text", 256).alias("h"))


def delete_page(spark, d):
    return ingest.delete_page(_chunks(spark, d), "src3").select("chunk_id", "page_id")


def _hashes(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("page_id"), T.content_hash(F.col("text")).alias("content_hash"))


def ingest_plan(spark, d):
    """Documents against a manifest in which every third hash is old and every fifth page unknown, and an index without every seventh."""
    current = _hashes(spark, d)
    old = current.where("page_id % 5 != 0").withColumn("content_hash", F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    there = current.where("page_id % 7 != 0").select("page_id").union(table(spark, d, "pages").select((F.col("page_id") + 100_000_000).alias("page_id")))
    return ingest.plan(current, old, there)


def orphan_pages(spark, d):
    return ingest.orphans(documents(spark, d).select(F.col("doc_id").alias("page_id")), table(spark, d, "pages"))


def manifest(spark, d):
    pages = documents(spark, d).groupBy(F.col("source").alias("page_id")).agg(T.content_hash(F.max("text")).alias("content_hash"))
    return ingest.manifest(_chunks(spark, d), pages)


def source_list(spark, d):
    known = ingest.manifest(table(spark, d, "labels").select(F.col("doc_id").alias("page_id")), _hashes(spark, d))
    return corpus.source_list(documents(spark, d).select(F.col("doc_id").alias("page_id"), "source"), known)


def url_allowlist(spark, d):
    return table(spark, d, "pages").select("page_id", corpus.host(F.col("url")).alias("host"), corpus.allowed(F.col("url"), ["example.org", "example.com"]).alias("allowed"))


def dump_chunks(spark, d):
    """The first three chunks of every page (a report limit)."""
    rows = _chunks(spark, d).withColumn("return_heavy", chunking.return_heavy(F.col("text")))
    return profiling.dump(rows, most=3)


def dump_vectors(spark, d):
    return profiling.dump_vectors(table(spark, d, "embeddings"), 3).select("vec_id", "dim", "norm", "vector")


def chunks_per_page(spark, d):
    return _chunks(spark, d).groupBy("page_id").agg(F.count("*").alias("n"))


def exact_dups(spark, d):
    return profiling.exact_duplicates(documents(spark, d))


def boilerplate(spark, d):
    rows = documents(spark, d).select("source", F.explode(F.split("text", "\n")).alias("text"))
    return profiling.boilerplate(rows, "source").select(F.sha2("body", 256).alias("body"), "pages", "copies")


def index_integrity(spark, d):
    return profiling.integrity(table(spark, d, "embeddings"))


def parse_ts(spark, d):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ssX").alias("parsed"), F.nullif(F.col("event_type"), F.lit("")).alias("section"))


def latency_summary(spark, d):
    rows = table(spark, d, "events").where("value > 0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 1).alias("median"), F.round(F.max("value"), 1).alias("most"))


QUERIES = {f.__name__: f for f in (
    bm25_postings, bm25_idf, bm25_topk, bm25_work, bm25_segments, dense_topk, ann_topk, ann_all_cells, raw_dense_max, score_ids, l2_norm, dim_check, rrf_fusion, gate_decision, hybrid_search, cited_pages, bm25_only, hydrate_join,
    evidence_budget, prompt, facts_present, corpus_validate, page_lookup, raw_missing, distinct_pages, upsert_chunks, delete_page, ingest_plan, orphan_pages, manifest, source_list,
    url_allowlist, dump_chunks, dump_vectors, chunks_per_page, exact_dups, boilerplate, index_integrity, parse_ts, latency_summary,
)}

_BM25 = f"""
tok AS (SELECT doc_id, {TOKENS} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM tok),
posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM posts GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_SPARSE = f"""{_BM25},
asked AS (SELECT qid, term, count(*) AS asked FROM (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT qid, doc_id, round(sum(asked * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 9) AS raw
  FROM posts JOIN idf USING (term) JOIN asked USING (term) JOIN dl USING (doc_id) GROUP BY qid, doc_id),
sparse AS (SELECT qid, doc_id, round(raw, 5) AS sparse_score, sparse_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc_id) AS INTEGER) AS sparse_rank FROM bm WHERE raw > 0) WHERE sparse_rank <= 20)"""
_DOT = "round(greatest(-1, least(1, list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])))), 6)"
_DENSE = f"""
q AS (SELECT item_id AS qid, text AS question, embedding AS qvec FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
sims AS (SELECT qid, vec_id, {_DOT.format('qvec', 'embedding')} AS dense_score FROM q, embeddings WHERE qvec IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, vec_id) AS INTEGER) AS dense_rank FROM sims) WHERE dense_rank <= 20)"""
_HEAVY = (
    "(regexp_matches(text, '\\b(?:annuali[sz]ed|CAGR|absolute return|periodic return|fund returns?|returns and rankings|return calculator)\\b|\\bNAV\\b[^\\n]{0,24}(?:₹|Rs\\.?|\\d)', 'i')"
    " OR regexp_matches(text, '[+\\-−]\\s*\\d[\\d,]*\\.?\\d*\\s*%') OR len(regexp_extract_all(text, '[+\\-−]?\\s*\\d[\\d,]*\\.?\\d*\\s*%')) >= 3)"
)
_FUSED = f"""{_SPARSE}, {_DENSE},
merged AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(vec_id, doc_id) AS chunk_id, dense_score, dense_rank, sparse_score, sparse_rank
  FROM dense a FULL JOIN sparse b ON a.qid = b.qid AND vec_id = doc_id),
scored AS (SELECT m.qid, chunk_id, coalesce(dense_score, s.exact, -1.0) AS dense_score, sparse_score,
  round((coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + sparse_rank), 0)) * CASE WHEN h.heavy THEN 0.85 ELSE 1 END, 9) AS score
  FROM merged m LEFT JOIN (SELECT doc_id, {_HEAVY} AS heavy FROM documents) h ON h.doc_id = chunk_id
  LEFT JOIN (SELECT qid, vec_id, round(list_dot_product(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS exact FROM q, embeddings WHERE qvec IS NOT NULL) s ON s.qid = m.qid AND s.vec_id = chunk_id),
fused AS (SELECT * EXCLUDE (score) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS fused_rank FROM scored) WHERE fused_rank <= 5),
gate AS (SELECT q.qid, coalesce(top, -1.0) AS raw_dense_max, coalesce(n, 0) AS candidates_considered,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidates' WHEN coalesce(top, -1.0) < {THRESHOLD} THEN 'below_threshold' ELSE 'ok' END AS reason
  FROM q LEFT JOIN (SELECT qid, max(dense_score) AS top FROM dense GROUP BY qid) t USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM fused GROUP BY qid) c USING (qid))"""
_BUDGET = """budget AS (SELECT * FROM (SELECT qid, chunk_id, fused_rank, block, CAST(sum(length(block) + 2) OVER (PARTITION BY qid ORDER BY fused_rank) - 2 AS BIGINT) AS total
  FROM (SELECT *, '[S' || fused_rank || '] ' || source || chr(10) || text AS block FROM fused JOIN documents ON doc_id = chunk_id)) WHERE total <= 6000)"""

SQL = {
    "bm25_postings": f"WITH {_BM25} SELECT term, doc_id, tf FROM posts",
    "bm25_idf": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_SPARSE} SELECT qid, doc_id, sparse_score, sparse_rank FROM sparse",
    "bm25_segments": f"WITH documents AS (SELECT * FROM main.documents WHERE source IS DISTINCT FROM 'src3'), {_SPARSE} SELECT qid, doc_id, sparse_score, sparse_rank FROM sparse",
    "dense_topk": f"WITH {_DENSE} SELECT qid, vec_id, dense_score, dense_rank FROM dense",
    "ann_all_cells": f"WITH {_DENSE} SELECT qid, vec_id, dense_score AS ann_score, dense_rank AS ann_rank FROM dense",
    "raw_dense_max": f"WITH {_DENSE} SELECT qid, coalesce(max(dense_score), -1.0) AS raw_dense_max FROM q LEFT JOIN dense USING (qid) GROUP BY qid",
    "score_ids": f"WITH {_SPARSE}, {_DENSE} SELECT s.qid, vec_id, round(list_dot_product(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM sparse s JOIN embeddings ON vec_id = doc_id JOIN q ON q.qid = s.qid WHERE qvec IS NOT NULL",
    "l2_norm": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings",
    "dim_check": "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "rrf_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "gate_decision": f"WITH {_FUSED} SELECT qid, reason = 'ok' AS found_answer, reason, raw_dense_max, candidates_considered FROM gate",
    "hybrid_search": f"WITH {_FUSED} SELECT f.*, raw_dense_max, source FROM fused f JOIN gate g ON g.qid = f.qid AND reason = 'ok' LEFT JOIN documents ON doc_id = chunk_id",
    "cited_pages": f"WITH {_FUSED} SELECT qid, source, min(fused_rank) AS best_rank, arg_min(chunk_id, fused_rank) AS chunk_id FROM fused JOIN documents ON doc_id = chunk_id GROUP BY qid, source",
    "bm25_only": f"WITH {_SPARSE}, {_DENSE} SELECT s.qid, doc_id AS chunk_id FROM sparse s LEFT JOIN dense t ON t.qid = s.qid AND vec_id = doc_id WHERE vec_id IS NULL",
    "hydrate_join": f"WITH {_SPARSE} SELECT qid, doc_id, sparse_rank, source, lang, sha256(text) AS content_hash FROM sparse JOIN documents USING (doc_id)",
    "evidence_budget": f"WITH {_FUSED}, {_BUDGET} SELECT qid, chunk_id, fused_rank, total FROM budget",
    "prompt": f"""WITH {_FUSED}, {_BUDGET}, ctx AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY fused_rank) AS context FROM budget GROUP BY qid)
      SELECT qid, sha256({quoted(prompts.SYSTEM)} || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question) AS prompt_hash FROM q LEFT JOIN ctx USING (qid)""",
    "facts_present": f"""WITH {_FUSED}, ctx AS (SELECT qid, string_agg(text, chr(10) ORDER BY fused_rank) AS context FROM fused JOIN documents ON doc_id = chunk_id GROUP BY qid),
      m AS (SELECT qid, list_sort(list_filter(list_distinct(string_split_regex(question, '\\s+')), lambda f: NOT contains(context, f))) AS missing FROM q JOIN ctx USING (qid))
      SELECT qid, len(missing) = 0 AS all_present, array_to_string(missing, ' ') AS missing FROM m""",
    "corpus_validate": f"WITH pages AS (SELECT page_id, url FROM main.pages UNION ALL SELECT column0, column1 FROM {values(FAULTS)}) " "SELECT problem, count(*) AS n FROM (SELECT 'url' AS problem FROM pages WHERE NOT coalesce(regexp_matches(url, '^https?://[^\\s]+$'), false) UNION ALL SELECT 'repeated' FROM (SELECT page_id FROM pages GROUP BY page_id HAVING count(*) > 1) UNION ALL SELECT 'missing' FROM pages WHERE page_id IS NULL) GROUP BY problem",
    "page_lookup": "SELECT page_id, url FROM pages WHERE page_id % 50 = 0",
    "raw_missing": "SELECT doc_id AS page_id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)",
    "distinct_pages": "SELECT DISTINCT source FROM documents",
    "upsert_chunks": """WITH n AS (SELECT doc_id * 2 AS chunk_id, source AS page_id, 'NEW' AS text FROM documents WHERE source IN ('src3', 'src7'))
      SELECT chunk_id, page_id, sha256(text) AS h FROM (SELECT doc_id AS chunk_id, source AS page_id, text FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n)""",
    "delete_page": "SELECT doc_id AS chunk_id, source AS page_id FROM documents WHERE source IS DISTINCT FROM 'src3'",
    "ingest_plan": """WITH c AS (SELECT doc_id AS page_id, sha256(text) AS h FROM documents), o AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE h END AS h FROM c WHERE page_id % 5 <> 0),
      t AS (SELECT page_id FROM c WHERE page_id % 7 <> 0 UNION SELECT page_id + 100000000 FROM pages)
      SELECT coalesce(c.page_id, t.page_id) AS page_id, CASE WHEN c.page_id IS NULL THEN 'purge' WHEN c.h = o.h AND t.page_id IS NOT NULL THEN 'skip' WHEN t.page_id IS NOT NULL THEN 'replace' ELSE 'new' END AS action
      FROM c LEFT JOIN o ON o.page_id = c.page_id FULL JOIN t ON t.page_id = c.page_id""",
    "orphan_pages": "SELECT DISTINCT doc_id AS page_id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)",
    "manifest": "SELECT source AS page_id, count(*) AS chunks, sha256(max(text)) AS content_hash FROM documents GROUP BY source",
    "source_list": "SELECT d.doc_id AS page_id, source, l.chunks, CASE WHEN l.chunks IS NOT NULL THEN sha256(text) END AS content_hash FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS chunks FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id",
    "url_allowlist": "SELECT page_id, h AS host, h = 'example.org' OR ends_with(h, '.example.org') OR h = 'example.com' OR ends_with(h, '.example.com') AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS h FROM pages)",
    "dump_chunks": "SELECT source AS page_id, CAST(place AS INTEGER) AS place, doc_id AS chunk_id, CAST(length(text) AS INTEGER) AS chars, heavy AS return_heavy FROM (SELECT *, " + _HEAVY + " AS heavy, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 3",
    "dump_vectors": """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 3) AS norm,
      array_to_string(list_transform(embedding, lambda x: printf('%.3f', CAST(x AS DOUBLE))), ',') AS vector FROM embeddings""",
    "chunks_per_page": "SELECT source AS page_id, count(*) AS n FROM documents GROUP BY source",
    "exact_dups": "SELECT sha256(trim(text)) AS h, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "boilerplate": """SELECT sha256(body) AS body, count(DISTINCT source) AS pages, count(*) AS copies FROM (SELECT source, lower(trim(regexp_replace(regexp_replace(line, '^[^()]*\\([^)]*\\)', ''), '\\s+', ' ', 'g'))) AS body
      FROM documents, unnest(string_split(text, chr(10))) AS t(line)) WHERE body <> '' GROUP BY body HAVING count(DISTINCT source) >= 2""",
    "index_integrity": """SELECT count(*) AS rows, count(DISTINCT len(embedding)) AS dims, CAST(min(len(embedding)) AS INTEGER) AS dim, round(min(n), 4) AS norm_min, round(max(n), 4) AS norm_max, round(avg(n), 4) AS norm_mean,
      count_if(NOT n BETWEEN 0.99 AND 1.01) AS bad_norms FROM (SELECT embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""",
    "parse_ts": "SELECT event_id, date_trunc('second', ts) AS parsed, nullif(event_type, '') AS section FROM events",
    "latency_summary": "SELECT event_type, count(*) AS n, round(median(value), 1) AS median, round(max(value), 1) AS most FROM events WHERE value > 0 GROUP BY event_type",
}
