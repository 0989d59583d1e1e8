"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows of each text.
Then lines are normalised (lower case, white space runs to one space, trimmed) and hashed;
for each host the distinct documents that hold a line are counted (copies of one text are one
document); a line in more than ``max_docs`` documents of its host is boilerplate.  A document that would keep less than ``min_left``
percent of its words without boilerplate lines is depleted and rejected.  ``judge`` counts the
boilerplate lines found and ``without_boilerplate`` gives the texts without the same lines.

Shuffles: one row for each distinct line of a text, folded before it moves and once more
after it, and one row
for each line to be looked up.  The looked-up side is salted, and the boilerplate lines, of
which there are at most all lines / max_docs, are repeated for each salt.  For texts, also
the documents once, to meet the places of their boilerplate lines.

Edges: a null text has no words and fails the base rules; a null host is a host of its own;
rows that repeat are judged each by itself; texts are told apart by 64-bit hashes, which only
counts documents; lines without a word are ignored and stay; other columns are ignored by ``judge`` and pass through ``without_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words; the characters that count as symbols.
GAP, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def window_hashes(column: str) -> Column:
    """64-bit hashes of the 3-word windows of the words in ``column``."""
    return F.expr(f"""if(size({column}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({column}) - 3),
        i -> xxhash64({column}[i], {column}[i + 1], {column}[i + 2])))""")


def repeated_window_words(column: str) -> Column:
    """How many words lie in 3-word windows that occur twice or more, from the windows' hashes in ``column``.

    Among n windows of a text the odds of a false match are n**2 / 2**65.  Most texts repeat none,
    which a count of distinct hashes tells."""
    return F.expr(f"""if(size(array_distinct({column})) = size({column}), 0, size(array_distinct(flatten(transform(
        aggregate(array(sort_array(transform({column}, (h, i) -> named_struct('h', h, 'i', i)))), cast(array() as array<struct<h: bigint, i: int>>), (none, s) ->
            filter(s, (w, k) -> coalesce(get(s, k - 1).h = w.h, false) or coalesce(get(s, k + 1).h = w.h, false))),
        w -> array(w.i, w.i + 1, w.i + 2))))))""")


def _lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(F.col(host).cast("string").alias("host"), F.xxhash64(body).alias("x"), lines.alias("lines"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def boilerplate(docs: DataFrame, max_docs: int, text: str = "text", host: str = "source") -> DataFrame:
    """(host, line): hashes of normalised lines that more than max_docs documents of a host hold."""
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(_normal(x))))
    rows = _lines(docs, text, host).select("host", "x", F.explode(hashes).alias("line"))
    return rows.groupBy("host", "line").agg(F.count_distinct("x").alias("docs")).where(F.col("docs") > max_docs).select("host", "line")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _looked_up(docs: DataFrame, max_docs: int, min_left: int, text: str, host: str, key: str) -> DataFrame:
    """(key, host, x, counts, copies, gone, gone_at, base_failed, kept) of each key, host and text hash; gone_at array<int>:
    the boilerplate lines among the lines with a word, from 0; gone: their words."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), body.alias("text"))
    rows = rows.select("key", "host", "text", F.xxhash64("text").alias("x"), words(F.col("text")).alias("words"))
    rows = rows.withColumn("windows", window_hashes("words"))
    rows = rows.select(
        "key", "host", "x",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_window_words("windows").cast("long").alias("n_repeat_words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counts = COUNTS
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    parts = F.transform("lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.size(words(x)).alias("size")))
    parted = rows.select("key", "host", "x", *counts, F.posexplode_outer(parts).alias("at", "part"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    # A document's counts travel with its first line only.
    parted = parted.select(
        "key", "host", "x", "at", *(F.when(first, F.col(c)).alias(c) for c in counts), first.cast("int").alias("first"),
        F.col("part.line").alias("line"), F.col("part.size").alias("size"), F.pmod(F.xxhash64("x", "at"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    common = boilerplate(docs, max_docs, text, host).select(
        F.col("host").alias("chost"), F.col("line").alias("cline"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("csalt")
    )
    met = parted.join(common, (F.col("line") == F.col("cline")) & F.col("host").eqNullSafe(F.col("chost")) & (F.col("salt") == F.col("csalt")), "left")
    out = met.groupBy("key", "host", "x").agg(
        *(F.max(c).alias(c) for c in counts), F.sum("first").cast("int").alias("copies"), F.sum(F.when(F.col("cline").isNotNull(), F.col("size")).otherwise(0)).alias("gone"),
        F.collect_set(F.when(F.col("cline").isNotNull(), F.col("at"))).alias("gone_at"),
    )
    # Rows that repeat key, host and text were counted together.
    out = out.withColumn("gone", F.expr("gone div copies"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("gone")) >= min_left * F.col("n_words")
    return out.select("key", "host", "x", *counts, "copies", "gone", "gone_at", failed.alias("base_failed"), (~failed & left).alias("kept"))


def judge(docs: DataFrame, max_docs: int = 20, min_left: int = 50, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_boilerplate_words)."""
    out = _looked_up(docs, max_docs, min_left, text, host, key).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(F.col("key").alias(key), *COUNTS, "base_failed", "kept", F.col("gone").alias("n_boilerplate_words"))


def without_boilerplate(
    docs: DataFrame, max_docs: int = 20, min_left: int = 50, text: str = "text", host: str = "source", key: str = "doc_id", keep_rejected: bool = True
) -> DataFrame:
    """All rows and columns of docs, with ``text`` without its boilerplate lines; or without the rows that judge rejects."""
    found = _looked_up(docs, max_docs, min_left, text, host, key).select(F.col("key").alias("fkey"), F.col("host").alias("fhost"), F.col("x").alias("fx"), "gone_at", "kept")
    body = F.col(text).cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("doc"), F.col(key).alias("key"), F.col(host).cast("string").alias("host"), body.alias("body"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("x")
    )
    met = rows.join(found, (F.col("x") == F.col("fx")) & F.col("key").eqNullSafe(F.col("fkey")) & F.col("host").eqNullSafe(F.col("fhost")))
    if not keep_rejected:
        met = met.where("kept")
    # The lines are bound to a name inside the expression, so that they are split once.
    left = F.expr("""element_at(transform(array(split(body, '\n', -1)), lines -> element_at(transform(
        array(filter(sequence(0, size(lines) - 1), i -> lines[i] rlike '[^\\\\x20\\\\x09-\\\\x0D]')),
        worded -> array_join(transform(array_except(sequence(0, size(lines) - 1), transform(gone_at, a -> worded[a])), i -> lines[i]), '\n')), 1)), 1)""")
    cleaned = F.when(F.size("gone_at") > 0, left).otherwise(F.col("body"))
    return met.select(*(cleaned.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS x FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), tri AS (
  SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS t(i)
), dup AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri
), rep AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) AS v(o) WHERE c >= 2 GROUP BY rid
), l AS (
  SELECT rid, x, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size
  FROM d, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dl AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid
), common AS (
  SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT x) > 20
), gone AS (
  SELECT rid, sum(size) AS gone FROM l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY rid
), s AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS n_boilerplate_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN gone USING (rid)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - n_boilerplate_words) >= 50 * n_words AS kept, CAST(n_boilerplate_words AS BIGINT) AS n_boilerplate_words
FROM j
"""
