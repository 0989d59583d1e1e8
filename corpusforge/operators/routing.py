"""Question routing: ordered rules as one CASE chain, so that filters on the result reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions import vocabulary as V
from corpusforge.functions.text import collapse_ws

FACTUAL, OPINION, OUT, SOURCES = "factual", "opinion", "out_of_scope", "corpus_sources"


def _hit(q: Column, pattern: str) -> Column:
    return q.rlike("(?i)" + pattern)


def scheme_words(schemes: list[str]) -> list[str]:
    return sorted({w.lower() for s in schemes for w in "".join(c if c.isalnum() else " " for c in s).split()})


def scheme_candidates(q: Column) -> Column:
    """Every phrase that names a scheme, as an array of its lower-case words: the words that lead up to a noun, as far as they are
    capitalised, or from the company's name on.  Other marks than those of names end a phrase."""
    none = F.array().cast("array<string>")

    def led(tokens: Column, i: Column, most: int) -> Column:
        """The words before place i, back to the last mark or noun."""
        before = F.slice(tokens, F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most)))
        return F.aggregate(before, none, lambda done, t: F.when((t == "|") | (t == V.FUND_NOUN.capitalize()), none).otherwise(F.concat(done, F.array(t))))

    def capitalised(words: Column) -> Column:
        return F.aggregate(words, none, lambda done, t: F.when(t.rlike("^[A-Z]"), F.concat(done, F.array(t))).otherwise(none))

    def company(words: Column, least: int) -> Column:
        """From the company's name on, if at least so many words follow it."""
        at = F.array_position(F.transform(words, F.lower), V.AMC).cast("int")
        return F.when((at > 0) & (F.size(words) - at >= least), F.slice(words, F.greatest(at, F.lit(1)), F.size(words))).otherwise(none)

    def named(tokens: Column, i: Column) -> Column:
        noun = F.regexp_extract(F.element_at(tokens, i + 1), "^[A-Za-z0-9]+", 0)
        lower = company(led(tokens, i, V.FUND_WORDS + 1), 1)
        phrase = (
            F.when(noun == V.FUND_NOUN.capitalize(), capitalised(led(tokens, i, V.FUND_WORDS)))
            .when(noun == V.FUND_NOUN, F.when(F.exists(lower, lambda t: t.rlike("[A-Z]")), none).otherwise(lower))
            .otherwise(company(led(tokens, i, V.ETF_WORDS), 0))
        )
        return F.when(F.size(phrase) > 0, F.concat(phrase, F.array(noun))).otherwise(phrase)

    def found(tokens: Column) -> Column:
        nouns = "(?i)^(?:" + "|".join([V.FUND_NOUN, *V.ETF_NOUNS]) + r")\b"
        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.element_at(tokens, i + 1).rlike(nouns))
        words = F.transform(places, lambda i: F.array_remove(F.split(F.lower(F.array_join(named(tokens, i), " ")), "[^a-z0-9]+"), ""))
        return F.filter(words, lambda w: F.size(w) > 0)

    # The words are bound to a name, so that the question is cut once; most questions have no noun of a scheme.
    tokens = F.split(F.regexp_replace(q, r"[^A-Za-z0-9&. -]+", " | "), " +")
    return F.when(q.rlike(f"(?i){V.FUND_NOUN}|etf"), F.get(F.transform(F.array(tokens), found), F.lit(0))).otherwise(F.array().cast("array<array<string>>"))


def _named(q: Column, schemes: list[str], covered: bool) -> Column:
    """Whether a phrase with the company's name and a distinctive word is (not) made of corpus scheme words."""
    known = F.array(*map(F.lit, scheme_words(schemes)))
    plain = F.array(*map(F.lit, V.NOT_DISTINCTIVE))

    def test(words: Column) -> Column:
        own = F.array_except(words, plain)
        unknown = F.size(F.array_except(own, known))
        return F.array_contains(words, V.AMC) & (F.size(own) > 0) & ((unknown == 0) if covered else (unknown > 0))

    return F.exists(scheme_candidates(q), test)


def non_corpus_scheme(q: Column, schemes: list[str] = V.SCHEMES) -> Column:
    return _named(q, schemes, covered=False)


def names_corpus_scheme(q: Column, schemes: list[str] = V.SCHEMES) -> Column:
    return _named(q, schemes, covered=True)


def is_source_list_question(question: Column, schemes: list[str] = V.SCHEMES) -> Column:
    q = collapse_ws(question)
    found = F.lit(False)
    for pattern in V.SOURCE_LIST:
        found = found | _hit(q, pattern)
    return found & ~_hit(q, V.FUND_FIELD) & ~names_corpus_scheme(q, schemes)


def explain(question: Column, schemes: list[str] = V.SCHEMES) -> Column:
    """struct(intent, rule, needs_fallback); the first rule that fits decides."""
    q = collapse_ws(F.coalesce(question, F.lit("")))
    steps: list[tuple[Column, str, str]] = [(_hit(q, V.STATEMENT_REQUEST), FACTUAL, "statement_request")]
    steps += [(_hit(q, p), OUT, name) for name, p in V.DOMAINS]
    steps += [(_hit(q, p), OPINION, name) for name, p in V.OPINION]
    steps += [(_hit(q, V.OTHER_AMC), OUT, "other_amc"), (non_corpus_scheme(q, schemes), OUT, "non_corpus_scheme")]
    steps += [(is_source_list_question(q, schemes), SOURCES, "source_list")]
    steps += [(_hit(q, p), FACTUAL, name) for name, p in V.FACTUAL]

    def match(intent: str, rule: str, fallback: bool = False) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(rule).alias("rule"), F.lit(fallback).alias("needs_fallback"))

    chain = F.when(q == "", match(OUT, "empty", True))
    for test, intent, rule in steps:
        chain = chain.when(test, match(intent, rule))
    return chain.otherwise(match(FACTUAL, "default:unmatched", True))


def is_performance_claim(question: Column) -> Column:
    q = collapse_ws(question)
    period = _hit(q, V.PERF_PERIOD) & ~_hit(q, V.PERF_FEE)
    return _hit(q, V.PERF_NUMBER) | _hit(q, V.PERF_RANKING) | _hit(q, V.PERF_NAV) | period | _hit(q, V.PERF_WORDS) | _hit(F.regexp_replace(q, "(?i)" + V.PERF_MEASURES, " "), V.PERF_NOUN)
