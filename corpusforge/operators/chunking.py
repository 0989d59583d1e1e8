"""Blocks to chunks: offsets, headings, packing to a token budget, ids, return-heavy tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions.text import chunk_id, content_hash, token_count

# What marks a chunk as mostly returns.
RETURN_WORDS = r"\b(?:annuali[sz]ed|CAGR|absolute return|periodic return|fund returns?|returns and rankings|return calculator)\b"
NAV_VALUE = r"\bNAV\b[^\n]{0,24}(?:₹|Rs\.?|\d)"
PERCENT, SIGNED_PERCENT = r"([+\-−]?\s*\d[\d,]*\.?\d*\s*%)", r"[+\-−]\s*\d[\d,]*\.?\d*\s*%"
SENTENCE, ABBREVIATION, TOKEN = re.compile(r"(?<=[.!?])\s+(?=[A-Z₹0-9\"'(])"), re.compile(r"(?:Rs|Mr|Mrs|Ms|Dr|vs|etc|No|approx)\.$", re.I), re.compile(r"\w+|[^\w\s]")

WORD_GAP = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"


def return_heavy(text: Column) -> Column:
    return text.rlike(f"(?i){RETURN_WORDS}|{NAV_VALUE}") | text.rlike(SIGNED_PERCENT) | (F.size(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1))) >= 3)


def checked(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap at least 0 and below it")


def block_offsets(blocks: DataFrame, page: str = "page_id", ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """Adds char_start and char_end in the page's joined text."""
    before = Window.partitionBy(page).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def heading_carry(blocks: DataFrame, page: str = "page_id", ordinal: str = "ordinal") -> DataFrame:
    """Adds ``heading``: the text of a heading directly before a block of another kind."""
    window = Window.partitionBy(page).orderBy(ordinal)
    before = F.lag(F.struct("kind", "text")).over(window)
    return blocks.withColumn("heading", F.when((F.col("kind") != "heading") & (before["kind"] == "heading"), before["text"]))


def compose(scheme: Column, section: Column, body: Column) -> Column:
    """``scheme (section) body``, without a section that is blank or the body itself."""
    shown = F.when((F.trim(section) != "") & (section != body), F.concat(F.lit("("), section, F.lit(")")))
    return F.concat_ws(" ", scheme, shown, body)


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that share ``overlap`` words, as an array of strings."""
    checked(size, overlap)
    step = size - overlap

    def windows(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - overlap) / step).cast("int") - 1)
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
        return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))

    # Bound to a name: a text would be split anew for each of its windows, in the square of its length.
    return _bound(F.array_remove(F.split(F.trim(text), r"\s+"), ""), windows)


def split_sentences(text: str) -> list[str]:
    done: list[str] = []
    for piece in filter(None, map(str.strip, SENTENCE.split(text))):
        if done and ABBREVIATION.search(done[-1]):
            done[-1] += " " + piece
        else:
            done.append(piece)
    return done


def _tail(counted: list[tuple[str, int]], overlap: int) -> list[tuple[str, int]]:
    """The longest run of last words within ``overlap`` tokens."""
    used, first = 0, len(counted)
    while first and used + counted[first - 1][1] <= overlap:
        first -= 1
        used += counted[first][1]
    return counted[first:]


def pack(text: str, size: int, overlap: int) -> list[str]:
    """The packing of one text in plain Python.  Sentences packed to at most ``size`` tokens; each piece starts with the last one's tail;
    a sentence over the budget is cut between words.  A text within the budget stays as it is.

    Tokens don't cross white space, so that a piece's count is the sum of its words'."""
    units: list[list[tuple[str, int]]] = []
    total = 0
    for sentence in split_sentences(text):
        counted = [(w, len(TOKEN.findall(w))) for w in sentence.split()]
        count = sum(n for _, n in counted)
        total += count
        if count <= size:
            units.append(counted)
            continue
        part, used = [], 0
        for word in counted:
            if part and used + word[1] > size - overlap:
                units.append(part)
                part, used = [], 0
            part.append(word)
            used += word[1]
        units += [part] if part else []
    if total <= size:
        return [text] if text.strip() else []
    out, held, used = [], [], 0
    for unit in units:
        count = sum(n for _, n in unit)
        if held and used + count > size:
            out.append(held)
            tail = _tail(held, overlap)
            held, used = [], sum(n for _, n in tail)
            held, used = (list(tail), used) if used + count <= size else ([], 0)
        held, used = [*held, *unit], used + count
    return [" ".join(w for w, _ in piece) for piece in ([*out, held] if held else out)]


def _bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _units(sentences: Column, size: int, overlap: int) -> Column:
    """array<struct<words,tokens>>: what is packed as a whole, of sentences given as arrays of their words' token counts: a sentence
    within the budget, or stretches of one that is over it."""
    unit = "array<struct<words:int,tokens:int>>"
    one = lambda words, tokens: F.array(F.struct(words.cast("int").alias("words"), tokens.cast("int").alias("tokens")))

    def cut(counts: Column) -> Column:
        def step(done: Column, n: Column) -> Column:
            over = (done["words"] > 0) & (done["tokens"] + n > size - overlap)
            return F.struct(
                F.when(over, F.concat(done["out"], one(done["words"], done["tokens"]))).otherwise(done["out"]).alias("out"),
                F.when(over, 1).otherwise(done["words"] + 1).alias("words"), F.when(over, n).otherwise(done["tokens"] + n).alias("tokens"),
            )

        zero = F.struct(F.array().cast(unit).alias("out"), F.lit(0).alias("words"), F.lit(0).alias("tokens"))
        return F.aggregate(counts, zero, step, lambda done: F.concat(done["out"], one(done["words"], done["tokens"])))

    total = lambda counts: F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    return F.flatten(F.transform(sentences, lambda c: _bound(total(c), lambda n: F.when(n <= size, one(F.size(c), n)).otherwise(cut(c)))))


def _places(units: Column, counts: Column, size: int, overlap: int) -> Column:
    """array<struct<from,to>>: the stretches of words that make the pieces, from 0."""

    def tail(first: Column, end: Column) -> Column:
        """struct(words, tokens): the longest run of words before ``end`` within the overlap, not beyond ``first``."""
        back = F.sequence(F.lit(1), F.least(end - first, F.lit(max(1, overlap))))

        def step(done: Column, i: Column) -> Column:
            n = done["tokens"] + F.get(counts, end - i)
            fits = ~done["full"] & (n <= overlap)
            return F.struct(F.when(fits, i).otherwise(done["words"]).alias("words"), F.when(fits, n).otherwise(done["tokens"]).alias("tokens"), (~fits).alias("full"))

        return F.aggregate(back, F.struct(F.lit(0).alias("words"), F.lit(0).alias("tokens"), F.lit(False).alias("full")), step)

    def step(done: Column, unit: Column) -> Column:
        full = (done["to"] > done["from"]) & (done["tokens"] + unit["tokens"] > size)
        closed = F.concat(done["out"], F.array(F.struct(done["from"].alias("from"), done["to"].alias("to"))))

        def begun(t: Column) -> Column:
            kept = t["tokens"] + unit["tokens"] <= size
            return F.struct(
                closed.alias("out"), (done["to"] - F.when(kept, t["words"]).otherwise(0)).alias("from"), (done["to"] + unit["words"]).alias("to"),
                (F.when(kept, t["tokens"]).otherwise(0) + unit["tokens"]).alias("tokens"),
            )

        going = F.struct(done["out"].alias("out"), done["from"].alias("from"), (done["to"] + unit["words"]).alias("to"), (done["tokens"] + unit["tokens"]).alias("tokens"))
        return F.when(full, _bound(tail(done["from"], done["to"]), begun)).otherwise(going)

    zero = F.struct(F.array().cast("array<struct<from:int,to:int>>").alias("out"), F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("tokens"))
    last = lambda done: F.concat(done["out"], F.array(F.struct(done["from"].alias("from"), done["to"].alias("to"))))
    return F.aggregate(units, zero, step, lambda done: F.when(done["to"] > done["from"], last(done)).otherwise(done["out"]))


def packed(text: Column, size: int, overlap: int) -> Column:
    """The pieces of a text, as ``pack`` gives them: folds over its sentences with the words' token counts; no Python."""
    checked(size, overlap)
    blank = text.isNull() | ~text.rlike(r"[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]")
    words_of = F.transform(T.sentences(text), lambda s: F.filter(F.split(s, WORD_GAP), lambda w: w != ""))
    tokens = lambda w: F.size(F.regexp_extract_all(w, F.lit(T.SIMPLE_TOKEN), F.lit(1)))

    def pieces(sentences: Column) -> Column:
        counted = F.transform(sentences, lambda ws: F.transform(ws, tokens))
        made = lambda words, counts, by: F.transform(_places(_units(by, size, overlap), counts, size, overlap), lambda p: F.array_join(F.slice(words, p["from"] + 1, p["to"] - p["from"]), " "))
        return _bound(counted, lambda by: _bound(F.flatten(by), lambda counts: _bound(F.flatten(sentences), lambda words: made(words, counts, by))))

    none = F.array().cast("array<string>")
    return F.when(blank, none).when(token_count(text) <= size, F.array(text)).otherwise(_bound(words_of, pieces))


def _described(rows: DataFrame) -> list[Column]:
    return [token_count(F.col("text")).alias("token_count"), content_hash(F.col("text")).alias("content_hash"), return_heavy(F.col("text")).alias("return_heavy")]


def chunk_documents(docs: DataFrame, size: int = 200, overlap: int = 40, page: str = "page_id", text: str = "text") -> DataFrame:
    """(page_id, ordinal, chunk_id, text, token_count, content_hash, return_heavy) of plain texts."""
    rows = docs.select(page, F.posexplode(packed(F.col(text), size, overlap)).alias("ordinal", "text"))
    return rows.select(page, "ordinal", chunk_id(F.col(page), F.col("ordinal")).alias("chunk_id"), "text", *_described(rows))


#: What a chunk knows of its page, where the page table has it.
PROVENANCE = {"scheme": "string", "category": "string", "source_url": "string", "fetched_at": "timestamp"}


def chunk_blocks(blocks: DataFrame, pages: DataFrame, size: int = 200, overlap: int = 40, drop_return_heavy: bool = False) -> DataFrame:
    """Chunks with provenance from blocks (page_id, ordinal, kind, text, section) and pages (page_id and any of PROVENANCE).

    A heading is held and put before the block after it, unless that holds its text; a heading with
    nothing after it is a chunk of its own, over the whole page, if it fits.  Each text starts with the
    page's scheme and its section; what is over ``size`` tokens is packed sentence by sentence.
    Chunks are numbered by block and piece; character offsets are those of the block."""
    checked(size, overlap)
    told = pages.select("page_id", *(F.col(c).cast(t).alias(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in PROVENANCE.items()))
    placed = block_offsets(blocks.select("page_id", "ordinal", "kind", "text", F.nullif(F.col("section"), F.lit("")).alias("section")))
    whole = Window.partitionBy("page_id")
    placed = placed.withColumn("page_end", F.max("char_end").over(whole)).where(F.col("text").rlike(r"\S"))
    rows = heading_carry(placed).withColumn("last", F.max("ordinal").over(whole))
    alone = F.col("kind") == "heading"
    rows = rows.where(~alone | (F.col("ordinal") == F.col("last"))).join(told, "page_id")
    body = F.when(F.col("heading").isNotNull() & (F.instr(F.col("text"), F.trim("heading")) == 0), F.concat_ws(": ", "heading", "text")).otherwise(F.col("text"))
    section = F.when(alone, F.col("text")).otherwise(F.coalesce("section", "heading"))
    rows = rows.select(
        "page_id", "ordinal", *PROVENANCE, alone.alias("alone"), section.alias("section"), compose(F.col("scheme"), section, body).alias("composed"),
        F.when(alone, 0).otherwise(F.col("char_start")).cast("long").alias("char_start"), F.when(alone, F.col("page_end")).otherwise(F.col("char_end")).cast("long").alias("char_end"),
    )
    fits = token_count(F.col("composed")) <= size
    rows = rows.withColumn("fits", fits).where("fits or not alone")
    rows = rows.select("*", F.posexplode(F.when(F.col("fits"), F.array("composed")).otherwise(packed(F.col("composed"), size, overlap))).alias("piece", "text")).drop("composed", "fits", "alone")
    if drop_return_heavy:
        rows = rows.where(~return_heavy(F.col("text")))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal", "piece")) - 1)
    return rows.select(
        chunk_id(F.col("page_id"), F.col("number")).alias("chunk_id"), F.col("number").alias("ordinal"), "page_id", *PROVENANCE, "section", "text", *_described(rows), "char_start", "char_end"
    )


def stats(chunks: DataFrame, group: str | None = None) -> DataFrame:
    """Number, return-heavy number, and least, most and mean tokens, of all chunks or by a column."""
    rows = chunks.groupBy(group) if group else chunks.groupBy()
    return rows.agg(
        F.count("*").alias("chunks"), F.count_if("return_heavy").alias("heavy"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 1).alias("mean"),
    )
