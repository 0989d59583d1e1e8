"""Text, chunking and page queries."""

from __future__ import annotations

from pyspark.sql import Window

from corpusforge.functions import text as T
from corpusforge.functions import vocabulary as V
from corpusforge.operators import chunking, ingest, pages, profiling
from corpusforge.plans.base import LINES_SQL, QUESTIONS, F, documents, lines, literal, matches, quoted, table, values

TOKENS = "regexp_extract_all(lower(text), '[₹a-z0-9]+(?:\\.[0-9]+)?%?')"
#: Sentences by two disjoint captures, as DuckDB has no lookaround.
SPLIT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z₹0-9\"''(])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '')"

NUMBERS = ["1,13,606.47", "₹ 500", "1.03%", "0.770", ".77", "12x", "abc", "", "%", "64.12", "2013", "$ 7", "7.", "00.50"]
ANSWERS = [
    "The expense ratio is 1.21%. It was Rs. 5 before! Is that all? Yes. More text follows.", "One sentence only", "", "First. Second (see note.) Third? Fourth.", "It costs 1.5. Then more. And more. And more.",
    "See https://example.org/a?b=1 , and http://x.example.net/y. Done.", "[S1] The load is 1% [S2] for units sold within 1 year.", "No figures here.", "₹ 1,000 minimum; 12.5% p.a. and 3x",
]
_ANSWERS_SQL = f"(SELECT column0 AS id, column1 AS text FROM {values(list(enumerate(ANSWERS)))})"


def _answers(spark):
    return literal(spark, list(enumerate(ANSWERS)), "id int, text string")


def tokenize(spark, d):
    tokens = T.tokenize(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


def norm_ws(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.norm_ws(F.col("text")), 256).alias("h"))


def sentence_split(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T._pieces(F.col("text"), T.SENTENCE_GAP)).alias("at", "sentence"))


def sentences(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.sentences(F.col("text")), "\n").alias("joined"))


def count_sentences(spark, d):
    return documents(spark, d).select("doc_id", T.count_sentences(F.col("text")).alias("n"))


def token_count(spark, d):
    return documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("n"))


def block_offsets(spark, d):
    return chunking.block_offsets(lines(spark, d)).select("page_id", "ordinal", "char_start", "char_end")


def compose_chunk(spark, d):
    rows = lines(spark, d).select("page_id", "ordinal", chunking.compose(F.col("source"), F.when(F.col("ordinal") % 3 == 0, F.col("text")).otherwise(F.col("kind")), F.col("text")).alias("t"))
    return rows.select("page_id", "ordinal", F.sha2("t", 256).alias("composed"))


def word_windows(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(chunking.word_windows(F.col("text"), 50, 10)).alias("at", "window"))


def pack_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(chunking.packed(F.col("text"), 200, 40)).alias("at", "piece"))


def _pages(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("page_id"), F.col("source").alias("scheme"), F.col("lang").alias("category"), F.concat(F.lit("https://corpus.example.org/"), "source").alias("source_url"))


def _blocks(spark, d):
    return lines(spark, d).withColumn("section", F.lit(None).cast("string"))


def chunks(spark, d):
    return chunking.chunk_blocks(_blocks(spark, d), _pages(spark, d))


def block_chunks(spark, d):
    """Chunks so large that none is packed: headings, sections, texts, offsets and numbers."""
    rows = chunking.chunk_blocks(_blocks(spark, d), _pages(spark, d), size=10**7)
    return rows.select("chunk_id", "ordinal", "page_id", "scheme", "category", "section", "token_count", "content_hash", "return_heavy", "char_start", "char_end")


def chunk_integrity(spark, d):
    return profiling.chunk_integrity(lines(spark, d).join(_pages(spark, d).select("page_id", "source_url"), "page_id"))


def heading_carry(spark, d):
    rows = lines(spark, d).withColumn("kind", F.when(F.length("text") < 40, "heading").otherwise("paragraph"))
    return chunking.heading_carry(rows).select("page_id", "ordinal", "kind", "heading")


def return_heavy(spark, d):
    own = documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text")
    more = _answers(spark).select(F.concat(F.lit("a"), "id").alias("id"), "text")
    extra = literal(spark, [("x1", "NAV today ₹ 64.12"), ("x2", "+ 2.42 % over a year"), ("x3", "1% 2% 3%"), ("x4", "1% 2%"), ("x5", "Return calculator | 3 years"), ("x6", "NAV: page")], "id string, text string")
    return own.unionByName(more).unionByName(extra).select("id", chunking.return_heavy(F.col("text")).alias("heavy"))


def chunk_ids(spark, d):
    return lines(spark, d).select("page_id", "ordinal", T.chunk_id(F.col("page_id"), F.col("ordinal")).alias("chunk_id"), T.content_hash(F.col("text")).alias("content_hash"))


def chunk_stats(spark, d):
    rows = lines(spark, d).select("source", T.token_count(F.col("text")).alias("token_count"), chunking.return_heavy(F.col("text")).alias("return_heavy"))
    return chunking.stats(rows, "source")


def question_ref(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.question_ref(F.col("text")).alias("ref"))


FIGURE_LIKE = "[₹$]?[0-9][0-9,.]*%?"


def norm_number(spark, d):
    """Everything in documents and conversations that begins like a figure, each once, and given tokens."""
    texts = documents(spark, d).select("text").unionAll(table(spark, d, "conversations").select("text"))
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"({FIGURE_LIKE})"), F.lit(1))).alias("token"))
    return found.unionAll(literal(spark, [(n,) for n in NUMBERS], "token string")).distinct().select("token", T.norm_number(F.col("token")).alias("n"))


def figures(spark, d):
    own = documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(_answers(spark).select(F.concat(F.lit("a"), "id").alias("id"), "text"))
    return own.select("id", F.array_join(T.figures(F.col("text")), "|").alias("figures"))


def _said(spark, d):
    """The battery of answers, and everything said in conversations; accented letters are folded, as word classes differ between engines."""
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("id"), F.regexp_replace("text", "[À-ɏ]", "Z").alias("text"))
    return _answers(spark).select(F.col("id").cast("long").alias("id"), "text").unionByName(said)


_SAID_SQL = f"(SELECT CAST(id AS BIGINT) AS id, text FROM {_ANSWERS_SQL} UNION ALL SELECT conv_id * 1000 + turn + 100, regexp_replace(text, '[À-ɏ]', 'Z', 'g') FROM conversations)"


def strip_urls(spark, d):
    return _said(spark, d).select("id", T.strip_urls(F.col("text")).alias("t"), F.array_join(T.urls(F.col("text")), " ").alias("urls"))


def trim_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.trim_sentences(F.col("text"), 3), 256).alias("h"))


def delimiters(spark, d):
    pieces = {"period": ".", "colon": ":", "pipe": "|", "newline": "\n", "percent": "%", "rupee": "₹"}
    return documents(spark, d).select("doc_id", *(T.occurrences(F.col("text"), p).alias(n) for n, p in pieces.items()))


def fact_coverage(spark, d):
    return profiling.fact_coverage(documents(spark, d))


def fact_snippets(spark, d):
    """The facts of documents, and of the batteries of answers and questions, which have keys below 0."""
    planted = literal(spark, [(-1 - i, t) for i, t in enumerate([*ANSWERS, *QUESTIONS])], "doc_id long, text string")
    return profiling.fact_snippets(documents(spark, d).select("doc_id", "text").unionByName(planted))


def perf_density(spark, d):
    return profiling.perf_density(documents(spark, d))


def flat_text(spark, d):
    return pages.flat_text(lines(spark, d)).select("page_id", F.length("flat_text").alias("chars"), F.sha2("flat_text", 256).alias("content_hash"))


def thin_pages(spark, d):
    return pages.flat_text(lines(spark, d)).select("page_id", F.length("flat_text").alias("chars")).where("chars < 400")


def block_dedup(spark, d):
    return pages.dedup_blocks(lines(spark, d)).select("page_id", "ordinal", F.sha2("text", 256).alias("h"))


def drop_text(spark, d):
    extra = literal(spark, [(-1, 0, "Log in to see"), (-1, 1, "Please download the app now"), (-1, 2, " share this"), (-1, 3, "Reviews (3)"), (-1, 4, "A review")], "page_id long, ordinal int, text string")
    rows = lines(spark, d).select("page_id", "ordinal", "text").unionByName(extra)
    return rows.select("page_id", "ordinal", T.any_match(F.col("text"), V.DROP_TEXT).alias("dropped"))


def html_blocks(spark, d):
    return pages.parse_pages(table(spark, d, "pages"))


def table_blocks(spark, d):
    """A page for each vendor, with a captioned table, a row of one cell, a label with its value and a text that stands in the table already."""
    name, money = F.coalesce("name", F.lit("none")), F.coalesce(F.col("balance").cast("decimal(12,2)").cast("string"), F.lit("none"))
    html = F.concat(
        F.lit("<main><h1>Vendor "), "vendor_id", F.lit("</h1><table><caption>Facts</caption><tr><th>Name</th><td>"), name, F.lit("</td></tr><tr><td>Balance of "), money, F.lit("</td></tr></table><div><span>Nation</span><span>number "),
        F.coalesce(F.col("nation_id").cast("string"), F.lit("none")), F.lit("</span></div><b>Balance of "), money, F.lit("</b><i>Seen last</i></main>"),
    )
    return pages.parse_pages(table(spark, d, "vendors").select(F.col("vendor_id").alias("page_id"), html.alias("html")))


def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(pages.strip_markup(F.col("html")), 256).alias("h"))


def html_chunks(spark, d):
    source = table(spark, d, "pages")
    return chunking.chunk_blocks(pages.parse_pages(source), source.select("page_id", F.col("url").alias("source_url")))


def too_long(spark, d):
    return documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens")).where("tokens > 256")


def hash_embed(spark, d):
    """Of every vector: its size, sums that see each place, and its last part."""
    rows = ingest.hash_embed(documents(spark, d).select("doc_id", "text"), dim=64)
    total = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("weighted"), F.round(F.element_at("embedding", -1).cast("double"), 5).alias("last"))


def dedup_first(spark, d):
    first = Window.partitionBy("text").orderBy("page_id", "ordinal")
    return lines(spark, d).where("text != ''").withColumn("place", F.row_number().over(first)).where("place = 1").select("page_id", "ordinal", "text")


QUERIES = {f.__name__: f for f in (
    tokenize, norm_ws, sentence_split, sentences, count_sentences, token_count, block_offsets, compose_chunk, word_windows, pack_sentences, chunks, block_chunks, chunk_integrity, heading_carry, return_heavy, chunk_ids,
    chunk_stats, question_ref, norm_number, figures, strip_urls, trim_sentences, delimiters, fact_coverage, fact_snippets, perf_density, flat_text, thin_pages, block_dedup, drop_text, html_blocks, table_blocks,
    html_strip, html_chunks, too_long, hash_embed, dedup_first,
)}

_COUNT_PARTS = "list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])[\"'')\\]]*\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '')"
_LATER = f"len(list_filter(parts[2:], lambda s: NOT list_contains({T.COUNT_ABBREVIATIONS}, lower(rtrim(regexp_extract(s, '[^ ]*$'), '.!?'))) AND NOT regexp_matches(right(s, 4), '\\d[.!?]\\d')))"
def _counted(rows: str) -> str:
    return f"(SELECT *, CASE WHEN len(parts) = 0 THEN 0 ELSE 1 + {_LATER} END AS n FROM (SELECT *, {_COUNT_PARTS} AS parts FROM {rows}))"


def trimmed(rows: str) -> str:
    """The rows with ``kept``: the first three sentences of their text."""
    return f"(SELECT *, CASE WHEN n <= 3 THEN text WHEN regexp_matches(k, '[.!?]$') THEN k ELSE k || '.' END AS kept FROM (SELECT *, array_to_string(parts[1:3], ' ') AS k FROM {_counted(rows)}))"


LINKS = "regexp_extract_all(text, '(?i)https?://[^\\s<>\\])\"'']+')"
STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s<>\\])\"'']+', '', 'gi'), '[ \\t]{2,}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g'))"
_SIMPLE = f"CAST(greatest(1, len(regexp_extract_all(text, '{T.SIMPLE_TOKEN[1:-1]}'))) AS INTEGER)"
_HEAVY = (
    "regexp_matches(text, '\\b(?:annuali[sz]ed|CAGR|absolute return|periodic return|fund returns?|returns and rankings|return calculator)\\b|\\bNAV\\b[^\\n]{0,24}(?:₹|Rs\\.?|\\d)', 'i')"
    " OR regexp_matches(text, '[+\\-−]\\s*\\d[\\d,]*\\.?\\d*\\s*%') OR len(regexp_extract_all(text, '[+\\-−]?\\s*\\d[\\d,]*\\.?\\d*\\s*%')) >= 3"
)
_FIGURES = "regexp_extract_all(regexp_replace(text, '\\[S\\d+\\]', ' ', 'gi'), '[₹$]?\\s?\\d[\\d,]*\\.?\\d*\\s?(?:%|x|X\\b)?')"
_EXTRA = values([("x1", "NAV today ₹ 64.12"), ("x2", "+ 2.42 % over a year"), ("x3", "1% 2% 3%"), ("x4", "1% 2%"), ("x5", "Return calculator | 3 years"), ("x6", "NAV: page")])
_SNIPPETS = " UNION ALL ".join(
    f"SELECT doc_id, {quoted(n)} AS fact, trim(regexp_replace(regexp_extract(text, {quoted('(.{0,60}(?:' + p + ').{0,100})')}, 1, 'is'), '\\s+', ' ', 'g')) AS snippet FROM t WHERE {matches('text', p)}" for n, p in V.FACTS
)
_FACTS = ", ".join(f"{matches('text', p)} AS {n}" for n, p in V.FACTS)
_STRIP = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), "
    "'<(?:script|style|noscript|template|svg|canvas|iframe|form|button|nav|aside)\\b[^>]*>.*?</(?:script|style|noscript|template|svg|canvas|iframe|form|button|nav|aside)>', ' ', 'gis'), "
    "'<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
)
_FLAT = f"(SELECT page_id, trim(regexp_replace(string_agg(text, chr(10) ORDER BY ordinal), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS flat_text FROM {LINES_SQL} GROUP BY page_id)"



def packed_sql(rows: str, size: int = 200, overlap: int = 40) -> str:
    """CTEs that end with packs (id, nth, piece): ``rows`` (id, text) packed, by prefix sums of tokens and a recursion from piece to piece."""
    abbreviation = "(?:Rs|Mr|Mrs|Ms|Dr|vs|etc|No|approx)\\.$"
    return f"""
whole AS MATERIALIZED (SELECT id, text, {_SIMPLE} AS n FROM {rows} WHERE regexp_matches(text, '\\S')),
sent AS MATERIALIZED (SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) AS si FROM (SELECT id, string_split(list_reduce({SPLIT}, lambda done, x: done || CASE WHEN regexp_matches(done, '{abbreviation}', 'i') THEN ' ' ELSE chr(31) END || x), chr(31)) AS s FROM whole WHERE n > {size})),
word AS MATERIALIZED (SELECT id, si, word, len(regexp_extract_all(word, '{T.SIMPLE_TOKEN[1:-1]}')) AS n, row_number() OVER (PARTITION BY id ORDER BY si, wi) - 1 AS i FROM (
  SELECT id, si, unnest(ws) AS word, generate_subscripts(ws, 1) AS wi FROM (SELECT id, si, list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '') AS ws FROM sent))),
text_ AS MATERIALIZED (SELECT id, list(word ORDER BY i) AS words, list_concat([0], list(CAST(upto AS BIGINT) ORDER BY i)) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY i) AS upto FROM word) GROUP BY id),
span AS MATERIALIZED (SELECT id, si, min(i) AS s, max(i) + 1 AS e, sum(n) AS n FROM word GROUP BY id, si),
cut AS MATERIALIZED (SELECT id, si, s, e FROM (WITH RECURSIVE r AS (
  SELECT id, si, s, s + greatest(1, len(list_filter(range(s + 1, e + 1), lambda i: b[i + 1] - b[s + 1] <= {size - overlap}))) AS e, e AS last FROM span JOIN text_ USING (id) WHERE n > {size}
  UNION ALL SELECT r.id, si, r.e, r.e + greatest(1, len(list_filter(range(r.e + 1, last + 1), lambda i: b[i + 1] - b[r.e + 1] <= {size - overlap}))), last FROM r JOIN text_ USING (id) WHERE r.e < last) SELECT * FROM r)),
unit AS MATERIALIZED (SELECT id, list(e ORDER BY e) AS ends FROM (SELECT id, e FROM span WHERE n <= {size} UNION ALL SELECT id, e FROM cut) GROUP BY id),
piece AS MATERIALIZED (SELECT id, a, ends[j] AS z, j FROM (WITH RECURSIVE r AS (
  SELECT id, 0 AS a, greatest(1, len(list_filter(ends, lambda e: b[e + 1] <= {size}))) AS j FROM unit JOIN text_ USING (id)
  UNION ALL SELECT id, a, greatest(j + 1, j + len(list_filter(ends[j + 1:], lambda e: b[e + 1] - b[a + 1] <= {size}))) FROM (
    SELECT id, j, ends, b, CASE WHEN b[z + 1] - b[t + 1] + b[ends[j + 1] + 1] - b[z + 1] <= {size} THEN t ELSE z END AS a FROM (
      SELECT id, j, ends, b, ends[j] AS z, ends[j] - len(list_filter(range(greatest(a, ends[j] - {overlap}), ends[j]), lambda i: b[ends[j] + 1] - b[i + 1] <= {overlap})) AS t
      FROM r JOIN unit USING (id) JOIN text_ USING (id) WHERE j < len(ends)))) SELECT * FROM r) JOIN unit USING (id)),
packs AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS INTEGER) AS nth, array_to_string(words[a + 1 : z], ' ') AS piece FROM piece JOIN text_ USING (id) UNION ALL SELECT id, 0, text FROM whole WHERE n <= {size})"""


_COMPOSED = f"""b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS own,
    sum(length(text) + 1) OVER (PARTITION BY page_id) - 1 AS page_end FROM {LINES_SQL}),
  n AS (SELECT *, lag(kind) OVER w AS before, lag(text) OVER w AS previous, max(ordinal) OVER (PARTITION BY page_id) AS last FROM b WHERE regexp_matches(text, '\\S') WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)),
  c AS (SELECT *, kind = 'heading' AS alone, CASE WHEN kind <> 'heading' AND before = 'heading' THEN previous END AS heading FROM n WHERE kind <> 'heading' OR ordinal = last),
  e AS (SELECT *, CASE WHEN alone THEN text ELSE heading END AS section, CASE WHEN heading IS NOT NULL AND strpos(text, trim(heading)) = 0 THEN heading || ': ' || text ELSE text END AS body FROM c),
  f AS MATERIALIZED (SELECT e.* EXCLUDE (text), lang, page_id || ':' || ordinal AS id, e.source || CASE WHEN section IS NOT NULL AND trim(section) <> '' AND section <> body THEN ' (' || section || ')' ELSE '' END || ' ' || body AS text FROM e JOIN documents ON doc_id = page_id)"""

SQL = {
    "tokenize": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "norm_ws": "SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\u00a0]+', ' ', 'g'))) AS h FROM documents",
    "sentence_split": f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS at, unnest(s) AS sentence FROM (SELECT doc_id, {SPLIT} AS s FROM documents)",
    "sentences": f"""SELECT doc_id, CASE WHEN len(s) = 0 THEN '' ELSE list_reduce(s, lambda done, x: done || CASE WHEN regexp_matches(done, '(?:Rs|Mr|Mrs|Ms|Dr|vs|etc|No|approx)\\.$', 'i') THEN ' ' ELSE chr(10) END || x) END AS joined
        FROM (SELECT doc_id, {SPLIT} AS s FROM documents)""",
    "hash_embed": """SELECT doc_id, 64 AS dim, round(list_sum(list_transform(range(0, 64), lambda i: CAST(CAST(v[i % 32 + 1] / norm AS FLOAT) AS DOUBLE) * (i + 1))), 4) AS weighted, round(CAST(CAST(v[32] / norm AS FLOAT) AS DOUBLE), 5) AS last
        FROM (SELECT *, sqrt(2 * list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (
        SELECT doc_id, list_transform(range(0, 32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) / 255) AS v FROM documents))""",
    "chunk_integrity": f"""SELECT count(*) AS chunks, count_if(NOT regexp_matches(text, '\\S')) AS empty, CAST(0 AS BIGINT) AS bad_urls, count(*) - count(DISTINCT sha256(trim(text))) AS redundant FROM {LINES_SQL}""",
    "block_chunks": f"""WITH b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS own,
          sum(length(text) + 1) OVER (PARTITION BY page_id) - 1 AS page_end FROM {LINES_SQL}),
        n AS (SELECT *, lag(kind) OVER w AS before, lag(text) OVER w AS previous, max(ordinal) OVER (PARTITION BY page_id) AS last FROM b WHERE regexp_matches(text, '\\S') WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)),
        c AS (SELECT *, kind = 'heading' AS alone, CASE WHEN kind <> 'heading' AND before = 'heading' THEN previous END AS heading FROM n WHERE kind <> 'heading' OR ordinal = last),
        e AS (SELECT *, CASE WHEN alone THEN text ELSE heading END AS section, CASE WHEN heading IS NOT NULL AND strpos(text, trim(heading)) = 0 THEN heading || ': ' || text ELSE text END AS body FROM c),
        f AS (SELECT e.* EXCLUDE (text), lang, e.source || CASE WHEN section IS NOT NULL AND trim(section) <> '' AND section <> body THEN ' (' || section || ')' ELSE '' END || ' ' || body AS text,
          CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal) - 1 AS INTEGER) AS k FROM e JOIN documents ON doc_id = page_id)
      SELECT substr(sha256(page_id || ':' || k), 1, 32) AS chunk_id, k AS ordinal, page_id, source AS scheme, lang AS category, section, {_SIMPLE} AS token_count, sha256(text) AS content_hash, {_HEAVY} AS return_heavy,
        CAST(CASE WHEN alone THEN 0 ELSE s END AS BIGINT) AS char_start, CAST(CASE WHEN alone THEN page_end ELSE s + own END AS BIGINT) AS char_end FROM f""",
    "pack_sentences": f"WITH {packed_sql('(SELECT doc_id AS id, text FROM documents)')} SELECT id AS doc_id, nth AS at, piece FROM packs",
    "chunks": f"""WITH {_COMPOSED}, {packed_sql('f')},
      g AS (SELECT f.* EXCLUDE (text), piece AS text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal, nth) - 1 AS INTEGER) AS k FROM f JOIN packs USING (id) JOIN whole USING (id) WHERE NOT (alone AND n > 200))
      SELECT substr(sha256(page_id || ':' || k), 1, 32) AS chunk_id, k AS ordinal, page_id, source AS scheme, lang AS category, 'https://corpus.example.org/' || source AS source_url, CAST(NULL AS TIMESTAMP) AS fetched_at, section, text,
        {_SIMPLE} AS token_count, sha256(text) AS content_hash, {_HEAVY} AS return_heavy, CAST(CASE WHEN alone THEN 0 ELSE s END AS BIGINT) AS char_start, CAST(CASE WHEN alone THEN page_end ELSE s + own END AS BIGINT) AS char_end FROM g""",
    "count_sentences": f"SELECT doc_id, CAST(n AS INTEGER) AS n FROM {_counted('documents')}",
    "token_count": f"SELECT doc_id, {_SIMPLE} AS n FROM documents",
    "block_offsets": f"""SELECT page_id, ordinal, CAST(s AS BIGINT) AS char_start, CAST(s + length(text) AS BIGINT) AS char_end FROM (SELECT *,
        coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {LINES_SQL})""",
    "compose_chunk": f"""SELECT page_id, ordinal, sha256(source || CASE WHEN trim(section) <> '' AND section <> text THEN ' (' || section || ')' ELSE '' END || ' ' || text) AS composed
        FROM (SELECT *, CASE WHEN ordinal % 3 = 0 THEN text ELSE kind END AS section FROM {LINES_SQL})""",
    "word_windows": """SELECT doc_id, CAST(i AS INTEGER) AS at, array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ') AS window FROM (
        SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents), unnest(range(0, greatest(1, CAST(ceil((len(w) - 10) / 40.0) AS INTEGER)))) AS t(i) WHERE len(w) > 0""",
    "heading_carry": f"""SELECT page_id, ordinal, kind, CASE WHEN kind <> 'heading' AND before = 'heading' THEN previous END AS heading FROM (
        SELECT *, lag(kind) OVER w AS before, lag(text) OVER w AS previous FROM (SELECT page_id, ordinal, text, CASE WHEN length(text) < 40 THEN 'heading' ELSE 'paragraph' END AS kind FROM {LINES_SQL})
        WINDOW w AS (PARTITION BY page_id ORDER BY ordinal))""",
    "return_heavy": f"""SELECT id, {_HEAVY} AS heavy FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'a' || id, text FROM {_ANSWERS_SQL}
        UNION ALL SELECT column0, column1 FROM {_EXTRA})""",
    "chunk_ids": f"SELECT page_id, ordinal, substr(sha256(page_id || ':' || ordinal), 1, 32) AS chunk_id, sha256(text) AS content_hash FROM {LINES_SQL}",
    "chunk_stats": f"""SELECT source, count(*) AS chunks, count_if(heavy) AS heavy, min(tokens) AS least, max(tokens) AS most, round(avg(tokens), 1) AS mean
        FROM (SELECT source, {_SIMPLE} AS tokens, {_HEAVY} AS heavy FROM {LINES_SQL}) GROUP BY source""",
    "question_ref": "SELECT item_id, 'q_' || substr(sha256(text), 1, 12) AS ref FROM benchmark",
    "norm_number": f"""SELECT token, coalesce(regexp_replace(printf('%.6f', v), '\\.?0+$', ''), '') AS n FROM (SELECT token, try_cast(replace(regexp_replace(trim(token), '[₹$% xX]', '', 'g'), ',', '') AS DOUBLE) AS v
        FROM (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '{FIGURE_LIKE}')) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) UNION ALL SELECT column0 FROM {values([(n,) for n in NUMBERS])})))""",
    "figures": f"""SELECT id, array_to_string({_FIGURES}, '|') AS figures FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'a' || id, text FROM {_ANSWERS_SQL})""",
    "strip_urls": f"SELECT id, {STRIPPED} AS t, array_to_string({LINKS}, ' ') AS urls FROM {_SAID_SQL}",
    "trim_sentences": f"SELECT doc_id, sha256(kept) AS h FROM {trimmed('documents')}",
    "delimiters": "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, {p}, '')) AS {n}" for n, p in [("period", "'.'"), ("colon", "':'"), ("pipe", "'|'"), ("newline", "chr(10)"), ("percent", "'%'"), ("rupee", "'₹'")]) + " FROM documents",
    "fact_coverage": f"SELECT doc_id, {_FACTS} FROM documents",
    "fact_snippets": f"WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - column0, column1 FROM {values(list(enumerate([*ANSWERS, *QUESTIONS])))}) SELECT * FROM ({_SNIPPETS}) WHERE snippet <> ''",
    "perf_density": f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(len(list_filter(s, lambda x: {matches('x', V.PERF_SENTENCE)})) AS INTEGER) AS hits,
        CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: {matches('x', V.PERF_SENTENCE)})) / len(s), 6) END AS density FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""",
    "flat_text": f"SELECT page_id, CAST(length(flat_text) AS INTEGER) AS chars, sha256(flat_text) AS content_hash FROM {_FLAT}",
    "thin_pages": f"SELECT page_id, CAST(length(flat_text) AS INTEGER) AS chars FROM {_FLAT} WHERE length(flat_text) < 400",
    "block_dedup": f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, sha256(text) AS h FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY ordinal) AS place FROM {LINES_SQL}) WHERE place = 1""",
    "drop_text": f"""SELECT page_id, ordinal, {' OR '.join(matches('text', p) for p in V.DROP_TEXT)} AS dropped FROM (SELECT page_id, ordinal, text FROM {LINES_SQL}
        UNION ALL SELECT column0, column1, column2 FROM {values([(-1, 0, "Log in to see"), (-1, 1, "Please download the app now"), (-1, 2, " share this"), (-1, 3, "Reviews (3)"), (-1, 4, "A review")])})""",
    "table_blocks": """WITH v AS (SELECT vendor_id, trim(regexp_replace(coalesce(name, 'none'), '\\s+', ' ', 'g')) AS name, coalesce(CAST(CAST(balance AS DECIMAL(12, 2)) AS VARCHAR), 'none') AS money, coalesce(CAST(nation_id AS VARCHAR), 'none') AS nation FROM vendors)
      SELECT vendor_id AS page_id, CAST(o AS INTEGER) AS ordinal, kind, text, 'Vendor ' || vendor_id AS section FROM v, LATERAL (VALUES (0, 'heading', 'Vendor ' || vendor_id), (1, 'table_row', 'Facts | Name | ' || name),
        (2, 'table_row', 'Facts | Facts | Balance of ' || money), (3, 'fact_row', 'Nation | number ' || nation), (4, 'text', 'Seen last')) AS t(o, kind, text)""",
    "html_strip": f"SELECT page_id, sha256({_STRIP}) AS h FROM pages",
    "too_long": f"SELECT doc_id, n AS tokens FROM (SELECT doc_id, {_SIMPLE} AS n FROM documents) WHERE n > 256",
    "dedup_first": f"""SELECT page_id, ordinal, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY page_id, ordinal) AS place FROM {LINES_SQL} WHERE text <> '') WHERE place = 1""",
}
