"""Text expressions: all are Spark columns over built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, sentence, figure and link shapes, and abbreviations that end no sentence.
TOKEN = r"([₹a-z0-9]+(?:\.[0-9]+)?%?)"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z₹0-9\"'(])"
COUNT_GAP = r"(?<=[.!?])[\"')\]]*\s+"
ABBREVIATION = r"(?i)(?:Rs|Mr|Mrs|Ms|Dr|vs|etc|No|approx)\.$"
COUNT_ABBREVIATIONS = "mr mrs ms dr prof vs etc e.g i.e approx no fig rs inr min max incl excl cf ca".split()
DECIMAL = r"\d[.!?]\d"
FIGURE = r"([₹$]?[ \t\n\f\r]?\d[\d,]*\.?\d*[ \t\n\f\r]?(?:%|x|X\b)?)"
HALF = 1 << 53
MARKER = r"(?i)\[S\d+\]"
URL = r"(?i)(https?://[^\s<>\])\"']+)"
#: Words of letters, digits and underscores of any script, or single marks; the same in Java, Python and RE2.
SIMPLE_TOKEN = r"([\p{L}\p{N}_]+|[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}\p{L}\p{N}_])"


def tokenize(text: Column) -> Column:
    """Lower-case index tokens; a decimal or percentage is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def norm_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\u00a0]+", " "))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _pieces(text: Column, gap: str) -> Column:
    return F.filter(F.transform(F.split(text, gap), lambda s: F.trim(s)), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences, with a piece that ends in an abbreviation joined to what follows."""
    return F.aggregate(
        _pieces(text, SENTENCE_GAP),
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & F.element_at(done, -1).rlike(ABBREVIATION),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), s))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def count_sentences(text: Column) -> Column:
    """How many sentences an answer has: a later piece counts unless its last word is an abbreviation or its end a decimal."""
    parts = _pieces(F.trim(text), COUNT_GAP)
    last = lambda s: F.lower(F.regexp_replace(F.regexp_extract(s, "([^ ]*)$", 1), "[.!?]+$", ""))
    later = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: ~(last(s).isin(COUNT_ABBREVIATIONS) | F.right(s, F.lit(4)).rlike(DECIMAL)))
    return F.when(F.size(parts) == 0, 0).otherwise(1 + F.size(later)).cast("int")


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(SIMPLE_TOKEN), F.lit(1)))).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(page_id: Column, ordinal: Column) -> Column:
    return F.substring(F.sha2(F.concat(page_id.cast("string"), F.lit(":"), ordinal.cast("string")), 256), 1, 32)


def question_ref(text: Column) -> Column:
    return F.concat(F.lit("q_"), F.substring(F.sha2(text, 256), 1, 12))


def _number(token: Column) -> Column:
    """A figure without currency, grouping, suffix and the white space around it, as a double; null if it isn't a number."""
    bare = F.regexp_replace(F.regexp_replace(token, "[₹$% xX,]", ""), r"^\s+|\s+$", "")
    return F.when(bare.rlike(r"^\d*\.?\d+$|^\d+\.$"), bare.cast("double"))


def _fixed(number: Column) -> Column:
    """A number to six decimals, by its exact binary value: halves of 53 bits and the fraction are exact, the decimals are rounded
    alone.  From 2**116 on the shortest digits that tell it from other doubles, then zeros."""
    high = F.floor(number / F.lit(float(HALF)))
    rest = number - high.cast("double") * F.lit(float(HALF))
    part = F.format_number(rest - F.floor(rest), 6)
    whole = high.cast("decimal(20,0)") * F.lit(HALF).cast("decimal(16,0)") + (F.floor(rest) + F.when(part.startswith("1"), 1).otherwise(0)).cast("decimal(20,0)")
    exact = F.concat(whole.cast("string"), F.lit("."), F.substring(part, 3, 6))
    return F.when(number == float("inf"), "inf").when(number < float(HALF << 63), exact).otherwise(F.regexp_replace(F.format_number(number, 6), ",", ""))


def norm_number(token: Column) -> Column:
    """A figure without currency, grouping and suffix, to six decimals without trailing zeros; empty if it isn't a number."""
    # The number is bound to a name, as it is used several times.
    fixed = F.element_at(F.transform(F.array(_number(token)), lambda n: F.regexp_replace(_fixed(n), r"\.?0+$", "")), 1)
    return F.coalesce(fixed, F.lit(""))


def figures(text: Column) -> Column:
    """The figures of a text; citation markers aren't figures."""
    found = F.regexp_extract_all(F.regexp_replace(text, MARKER, " "), F.lit(FIGURE), F.lit(1))
    return F.filter(found, lambda f: _number(f).isNotNull())


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(1))


def strip_urls(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, URL, ""), r"[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(bare, r"\s+([.,;:])", "$1"))


def trim_sentences(text: Column, limit: int) -> Column:
    """The first sentences up to the limit; a text within it stays as it is."""
    parts = _pieces(F.trim(text), COUNT_GAP)
    kept = F.concat_ws(" ", F.slice(parts, 1, limit))
    closed = F.when(kept.rlike(r"[.!?]$"), kept).otherwise(F.concat(kept, F.lit(".")))
    return F.when(count_sentences(text) <= limit, text).otherwise(closed)


def occurrences(text: Column, piece: str) -> Column:
    """How often a one-character piece occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))).cast("long")


def any_match(text: Column, patterns) -> Column:
    """Whether any of the patterns is found."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))
