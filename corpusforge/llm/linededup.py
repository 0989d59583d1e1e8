"""Line dedup by content-defined line chunks, in DataFrame functions only.

A text's lines are hashed; a rolling hash over each two neighbouring line hashes decides
whether a chunk ends after a line, so that the same lines are cut the same way wherever they
stand.  Chunks of two lines or more with a word in them that occur more than once anywhere
are candidates; their texts are compared byte by byte; of equal chunks the first one (by key,
then place) stays and the others are removed.  Chunks are found by 128 bits of a hash; should
different ones share it, none of them is removed.

Shuffles: hashes of chunks; texts once, to meet the candidates' places and then the verdicts
(one exchange, read twice, where there are no other columns); the candidate chunks' own texts, folded
by hash before they move.  A common chunk is ``SALTS`` keys of joins without texts, whose large side
Spark can split.

Edges: a null text is an empty one; lines are what "\n" separates, the empty ones, too;
single-line chunks always stay; rows that repeat key and text count as one document and
have one fate; a null key sorts first; other columns pass through.

``dedup_runs``, which the query and the pipeline use, takes every run of two lines or more that stands
earlier (by key, then place), from its first line to its last, at two densities.  First come the chunks
above, each of which begins with the line that the one before it ends with, so that every pair of
neighbouring lines lies in one: of three lines or more, all but the first place go.  What is left, as short
passages seldom hold a whole chunk, is cut after every line, so that each pair of lines with a word
is a chunk.  The first place of each line's text stays: a line only goes where a pair equal to its own
stands earlier.  Repeated chunks of both densities are compared byte by byte; where different ones share
a hash, all of them stay, with the pairs in the longer ones.  A pair isn't a repeat of the one that starts a line
before it in the same text.

Shuffles: as above, once for both densities, whose places are made in one reading of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.scratch import discard, written

#: Of 16 values of a hash's first hex digit, those at which a chunk ends: one line in four.
ENDS = "'0', '1', '2', '3'"
MIN_LINES = 2
WORD = r"[^\x20\x09-\x0D]"
#: Places of a common chunk are dealt to so many keys; Spark can split these further.
SALTS = 8
#: The columns that say how many lines a text had and lost.
COUNTS = ("n_lines", "n_removed")


def _chunked(rows: DataFrame, column: str, shared: bool = False) -> DataFrame:
    """Adds lines, and chunks array<bigint>: first line << 32 | last line, from 0.  ``shared``: a chunk begins with the line that the one before it ends with."""
    rows = rows.withColumn("lines", F.split(F.coalesce(F.col(column), F.lit("")), "\n", -1))
    rows = rows.withColumn("codes", F.transform("lines", F.md5))
    rows = rows.withColumn("ends", F.expr(f"""filter(sequence(0, size(codes) - 1), i -> i = size(codes) - 1 or
        substring(md5(concat(coalesce(get(codes, i - 1), ''), codes[i])), 1, 1) in ({ENDS}))"""))  # fmt: skip
    begins = "coalesce(get(ends, k - 1), 0)" if shared else "coalesce(get(ends, k - 1), -1) + 1"
    chunks = F.expr(f"transform(ends, (e, k) -> shiftleft(cast({begins} as bigint), 32) | cast(e as bigint))")
    return rows.withColumn("chunks", chunks).drop("codes", "ends")


_FIRST, _SIZE = "cast(shiftright({0}, 32) as int)", "cast(({0} & 4294967295) - shiftright({0}, 32) + 1 as int)"
_TEXT = f"array_join(slice(lines, {_FIRST} + 1, {_SIZE}), '\n')"


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(at, of, text, rest): key and text hash; the text; all other columns, safe from any of ours, if there are any."""
    body = F.col(_quoted(text)).cast("string")
    others = [_quoted(c) for c in docs.columns if c not in (key, text)]
    rest = [F.struct(*others).alias("rest")] if others else []
    return docs.select(F.col(_quoted(key)).cast("long").alias("at"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("of"), body.alias("text"), *rest)


def _with(rows: DataFrame, found: DataFrame, column: str, how: str) -> DataFrame:
    """rows with a column of found (at, of, column); keys may be null."""
    found = found.select(F.col("at").alias("fat"), F.col("of").alias("fof"), column)
    # Sorted and merged at every size: rows of found are short on disk and long in memory.
    return rows.join(found.hint("merge"), (F.col("of") == F.col("fof")) & F.col("at").eqNullSafe(F.col("fat")), how).drop("fat", "fof")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def removed_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(at, of, gone array<bigint>): the chunks to remove from each document that loses any."""
    keyed = _keyed(docs, text, key).select("at", "of", "text")
    chunked = _chunked(keyed, "text")
    found = _repeated(written(chunked.select("at", "of", F.explode(F.transform(_wide(MIN_LINES), lambda c: _place_of(c, _first(c)))).alias("p")).select("at", "of", "p.*")))
    marks = written(found.groupBy("at", "of").agg(F.collect_set(F.struct("chunk", "code", "later")).alias("marks")))
    discard(found)
    return _verified(keyed, marks).groupBy("at", "of").agg(F.collect_set("chunk").alias("gone"))


def _first(chunk: Column) -> Column:
    return F.shiftright(chunk, 32).cast("int")


def _last(chunk: Column) -> Column:
    return chunk.bitwiseAND(4294967295).cast("int")


def _text_of(chunk: Column) -> Column:
    return F.array_join(F.slice("lines", _first(chunk) + 1, _last(chunk) - _first(chunk) + 1), "\n")


def _place_of(chunk: Column, within: Column) -> Column:
    """struct(chunk, within, code): ``within`` is the first line of the rolling hash's chunk that holds it."""
    return F.struct(chunk.alias("chunk"), within.alias("within"), chunk_code(_text_of(chunk)).alias("code"))


def _wide(least: int) -> Column:
    """Those of ``chunks`` with so many lines and a word."""
    return F.filter("chunks", lambda c: (_last(c) - _first(c) + 1 >= least) & _text_of(c).rlike(WORD))


def _each_salt() -> Column:
    return F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")


def _own_salt() -> Column:
    return F.pmod(F.xxhash64("at", "of"), F.lit(SALTS)).cast("int").alias("salt")


def _repeated(places: DataFrame) -> DataFrame:
    """(at, of, within, chunk, code, later): the places of codes that stand at two or more, and whether the code's first one is another
    (for a pair: that doesn't start a line before it in the same text); places (a written table) is used up."""
    place, chunk, stays = F.struct("at", "of", "chunk"), F.col("chunk"), F.col("stays.chunk")
    often = places.groupBy("code").agg(F.min(place).alias("stays"), F.max(place).alias("last")).where("stays != last")
    often, salted = written(often.select("code", "stays", _each_salt())), places.withColumn("salt", _own_salt())
    overlaps = F.col("at").eqNullSafe(F.col("stays.at")) & (F.col("of") == F.col("stays.of")) & (_last(chunk) == _first(chunk) + 1) & (_first(chunk) == _first(stays) + 1)
    later = (place != F.col("stays")) & ~overlaps
    found = written(salted.join(often, ["code", "salt"]).select("at", "of", "within", "chunk", "code", later.alias("later")))
    discard(places, often)
    return found


def _verified(keyed: DataFrame, marks: DataFrame) -> DataFrame:
    """(at, of, chunk): the later places in marks (at, of, marks array<struct<chunk, code, later>>), without codes whose texts differ."""
    # The lines are bound to a name inside the expression; a column of them would be put into the inner function and split anew for each chunk.
    pieces = F.expr(f"""flatten(transform(array(split(coalesce(text, ''), '\n', -1)), lines ->
        transform(marks, w -> named_struct('code', w.code, 'piece', {_TEXT.format('w.chunk')}))))""")
    met = _with(keyed, marks, "marks", "inner").select(F.explode(pieces).alias("p")).select("p.*")
    # The bytes of a code's pieces are compared in its fold: if the least and the greatest are the same, all are.
    differ = met.groupBy("code").agg((F.min("piece") != F.max("piece")).alias("differ")).where("differ").select("code", _each_salt())
    later = marks.select("at", "of", F.explode(F.filter("marks", lambda w: w["later"])).alias("w")).select("at", "of", "w.chunk", "w.code", _own_salt())
    return later.join(differ, ["code", "salt"], "left_anti").select("at", "of", "chunk")


def chunk_code(piece: Column) -> Column:
    """What equal chunks are found by.  Chunks that share it and differ all stay."""
    return F.unhex(F.substring(F.sha2(piece, 256), 1, 32))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_emptied: bool = False) -> DataFrame:
    """All columns of docs with ``text`` replaced, and n_lines, n_removed in place of columns of these names.

    ``drop_emptied``: without the documents that had chunks removed and have no word left."""
    out = _chunked(_with(_keyed(docs, text, key), removed_chunks(docs, text, key), "gone", "left"), "text")
    out = out.withColumn("stay", F.coalesce(F.array_except("chunks", "gone"), "chunks"))
    left = F.expr(f"array_join(transform(stay, c -> {_TEXT.format('c')}), '\n')")
    lost = F.expr(f"aggregate(coalesce(gone, array()), 0L, (a, c) -> a + {_SIZE.format('c')})")
    return _finished(docs, out, text, key, left, F.size("lines").cast("long"), lost, drop_emptied)


def repeated_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(at, of, gone array<int>): first lines, from 0, of the pairs of lines that stand earlier, for each document that has any; those of later chunks with or without a word."""
    keyed = _keyed(docs, text, key).select("at", "of", "text")
    rows = _chunked(keyed, "text", shared=True).withColumn("wordy", F.transform("lines", lambda line: line.rlike(WORD)))

    def pairs(c: Column) -> Column:
        starts = F.when(_last(c) > _first(c), F.sequence(_first(c), _last(c) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: F.get("wordy", i) | F.get("wordy", i + 1))
        return F.transform(starts, lambda i: _place_of(F.shiftleft(i.cast("long"), 32).bitwiseOR((i + 1).cast("long")), _first(c)))

    # Both densities in one reading: the chunks between the ends that the rolling hash chooses, of three lines or more (so a copy lies
    # two lines off at least), and the pairs of all chunks.
    both = F.concat(F.transform(_wide(MIN_LINES + 1), lambda c: _place_of(c, _first(c))), F.flatten(F.transform("chunks", pairs)))
    found = _repeated(written(rows.select("at", "of", F.explode(both).alias("p")).select("at", "of", "p.*")))
    # A later chunk goes as a whole; what it leaves is cut after every line.
    mark, is_pair = F.struct("chunk", "code", "later"), _last(F.col("chunk")) == _first(F.col("chunk")) + 1
    by_chunk = found.groupBy("at", "of", "within").agg(F.max(F.when(~is_pair, F.struct("later", "chunk", "code"))).alias("whole"), F.collect_set(F.when(is_pair, mark)).alias("pairs"))
    whole = F.array(F.struct("whole.chunk", "whole.code", "whole.later"))
    marks = F.when(F.col("whole").isNull(), F.col("pairs")).when(F.col("whole.later"), whole).otherwise(F.concat(whole, "pairs"))
    marks = written(by_chunk.groupBy("at", "of").agg(F.flatten(F.collect_list(marks)).alias("marks")))
    discard(found)
    starts = F.sequence(_first(F.col("chunk")), _last(F.col("chunk")) - 1)
    return _verified(keyed, marks).groupBy("at", "of").agg(F.flatten(F.collect_list(starts)).alias("gone"))


def dedup_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_emptied: bool = False, counts: tuple[str, str] = COUNTS) -> DataFrame:
    """As dedup_lines, but without every line that lies in a repeated pair of lines.  ``counts``: how n_lines and n_removed are named."""
    out = _with(_keyed(docs, text, key), repeated_pairs(docs, text, key), "gone", "left")
    out = out.withColumn("done", F.expr("""element_at(transform(array(split(coalesce(text, ''), '\n', -1)), lines -> element_at(transform(
        array(array_except(sequence(0, size(lines) - 1), flatten(transform(filter(coalesce(gone, cast(array() as array<int>)), i -> lines[i] rlike '[^\\\\x20\\\\x09-\\\\x0D]' or lines[i + 1] rlike '[^\\\\x20\\\\x09-\\\\x0D]'), i -> array(i, i + 1))))),
        stay -> named_struct('left', array_join(transform(stay, i -> lines[i]), '\n'), 'n', size(lines), 'lost', size(lines) - size(stay))), 1)), 1)"""))  # fmt: skip
    return _finished(docs, out, text, key, F.col("done.left"), F.col("done.n").cast("long"), F.col("done.lost").cast("long"), drop_emptied, counts)


def _finished(docs: DataFrame, out: DataFrame, text: str, key: str, left: Column, size: Column, lost: Column, drop_emptied: bool, counts: tuple[str, str] = COUNTS) -> DataFrame:
    columns = [c for c in docs.columns if c.lower() not in {c.lower() for c in counts}]
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    own = {key: F.col("at").cast(docs.schema[key].dataType), text: cleaned}
    kept = [own.get(c, F.col(f"rest.{_quoted(c)}")).alias(c) for c in columns]
    out = out.select(*kept, size.alias(counts[0]), lost.alias(counts[1]))
    if not drop_emptied:
        return out
    # A filter on the new text would be moved below the projections with their expressions put
    # into each other, and run each line's hash for each line; it isn't moved past a generator.
    rows = out.select(F.explode(F.array(F.struct(*map(_quoted, out.columns)))).alias("row"))
    return rows.where((F.col(f"row.{_quoted(counts[1])}") == 0) | F.col(f"row.{_quoted(text)}").rlike(r"[^\x20\x09-\x0D]")).select("row.*")


#: Of ``dedup_runs``.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), p AS (
  SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] AS pair FROM d, unnest(range(1, len(lines))) AS t(i)
), f AS (
  SELECT doc_id, i, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i
  FROM p WHERE regexp_matches(pair, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY pair ORDER BY doc_id, i)
), g AS (
  SELECT DISTINCT doc_id, i + o AS i, true AS gone FROM f, (VALUES (0), (1)) AS v(o) WHERE doc_id <> first_doc OR i > first_i + 1
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id
"""
