"""Answer screens, citation and grounding, refusals, and the staged validation of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions import vocabulary as V

# The wording of refusals.
REFUSALS = {
    "opinion": "I can only state facts from the listed pages and can't give advice.",
    "performance": "I can't state returns or other performance figures.",
    "not_in_corpus": "I couldn't find this in the listed pages.",
    "pii": "Please ask again without personal details.",
}
PLAN_SUFFIX = r"(?i)\s*[-–]?\s*direct(\s+plan)?\s*[-–]?\s*growth\s*$"


def _hit(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def advice_term(text: Column) -> Column:
    """The first advice term in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(text, f"(?i)({V.ADVICE})", 1)), F.lit(""))


#: (pattern, replacement) steps that set aside what ends no clause, and leave a break where one ends.
HELD, BREAK = "\x1e", "\x1f"
_MARKS = f"[{V.CLAUSE_MARKS}]+"
CLAUSE_STEPS = [
    (r"([0-9])\.([0-9])", rf"$1{HELD}$2"), (rf"([0-9]){_MARKS}", "$1 "), (rf"{_MARKS}([0-9])", " $1"),
    (rf"(?i)\b({'|'.join(V.CLAUSE_ABBREVIATIONS)})\.", rf"$1{HELD}"), (rf"(?i){_MARKS}|{V.words(*V.CLAUSE_WORDS)}", BREAK), (HELD, "."),
]
#: The evaluation's: marks after letters and digits end nothing there.
EVAL_STEPS = [(r"(^|[^0-9A-Za-z])[.!?;]+\s+", rf"$1{BREAK}"), (rf"(?i)\s+(?:{'|'.join(V.EVAL_CLAUSE_WORDS)})\s+", BREAK)]


def split_clauses(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.transform(F.split(text, BREAK), lambda c: F.trim(c)), lambda c: c != "")


def clause_verdict(clause: Column) -> Column:
    """Why one clause states performance, or null: the first test that fits decides."""
    screened = F.regexp_replace(clause, "(?i)" + V.PLAN_NAMES, " ")
    figures = F.size(T.figures(clause)) > 0
    fee, returns = _hit(screened, V.FEES), _hit(screened, V.RETURNS)
    nothing = F.lit(None).cast("string")
    bare = F.when(returns & ~fee, "return language without a fee").otherwise(nothing)
    return (
        F.when(_hit(clause, V.INDEX_NAMES), nothing)
        .when(~figures, bare)
        .when(_hit(screened, V.NAV) & ~_hit(screened, V.DATEISH), "NAV value")
        .when(fee, nothing)
        .when(returns, "return figure")
        .when(_hit(screened, V.PERIODS), "period-attached figure")
        .when(clause.rlike(r"\d\s*%"), "unattributed percentage")
    )


def performance_violations(text: Column) -> Column:
    """The reasons, clause by clause."""
    return F.filter(F.transform(split_clauses(text, CLAUSE_STEPS), clause_verdict), lambda r: r.isNotNull())


def eval_verdict(clause: Column) -> Column:
    """The evaluation's own reading of a clause."""
    screened = F.regexp_replace(clause, "(?i)" + V.PLAN_NAMES, " ")
    returns, percent = _hit(screened, V.EVAL_RETURNS), screened.rlike(V.BARE_PERCENT)
    return (
        F.when(_hit(screened, V.EVAL_INDEX) | _hit(screened, V.EVAL_FEES), F.lit(None).cast("string"))
        .when(_hit(screened, V.EVAL_NAV), "NAV value")
        .when(_hit(screened, V.PERIOD_PERCENT), "period-attached figure")
        .when(returns & percent, "return figure")
        .when(returns, "return language without a figure")
        .when(percent, "unattributed percentage")
    )


def performance_leaks(text: Column) -> Column:
    return F.filter(F.transform(split_clauses(text, EVAL_STEPS), eval_verdict), lambda r: r.isNotNull())


def advice_leaks(text: Column) -> Column:
    clauses = split_clauses(text, EVAL_STEPS)
    both = F.transform(clauses, lambda c: F.array(F.when(_hit(c, V.DIRECTIVES), "directive"), F.when(_hit(c, V.BARE_SHOULD), "recommendation")))
    return F.filter(F.flatten(both), lambda r: r.isNotNull())


def markers(draft: Column) -> Column:
    """Cited block numbers in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(draft, F.lit(r"(?i)\[S(\d{1,6})\]"), F.lit(1)), lambda m: m.cast("int")))


def resolve_citation(draft: Column, candidates: Column) -> Column:
    """The cited candidate: by marker, else by a link that a candidate has, else the best one.

    candidates: array of structs with source_url and fused_rank, in rank order."""
    # A full stop after a link is no part of it.
    links = F.transform(T.urls(draft), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
    by_marker = F.element_at(F.filter(F.transform(markers(draft), lambda m: F.get(candidates, m - 1)), lambda c: c.isNotNull()), 1)
    by_link = F.element_at(F.filter(candidates, lambda c: F.array_contains(links, c["source_url"])), 1)
    in_bounds = F.size(F.filter(markers(draft), lambda m: (m >= 1) & (m <= F.size(candidates)))) > 0
    has_link = F.exists(candidates, lambda c: F.array_contains(links, c["source_url"]))
    return F.when(in_bounds, by_marker).when(has_link, by_link).otherwise(F.get(candidates, F.lit(0)))


def ungrounded(draft: Column, evidence: Column) -> Column:
    """Figures of a draft that aren't a piece of the evidence's figures joined by spaces."""
    haystack = F.array_join(F.transform(T.figures(evidence), lambda f: T.norm_number(f)), " ")
    return F.filter(T.figures(draft), lambda f: F.instr(haystack, T.norm_number(f)) == 0)


def ungrounded_exact(draft: Column, evidence: Column) -> Column:
    """The same with whole figures: a 5 isn't found in 500."""
    known = F.transform(T.figures(evidence), lambda f: T.norm_number(f))
    return F.filter(T.figures(draft), lambda f: ~F.array_contains(known, T.norm_number(f)))


def validate(drafts: DataFrame, limit: int = 3, regenerated: str | None = None) -> DataFrame:
    """(id, refused, reason, answer, source_url, notes) of (id, draft, candidates).

    candidates: array<struct<chunk_id, source_url, text, fused_rank>> in rank order;
    ``regenerated``: a column with a second draft, taken once where the first is too long."""
    rows = drafts.withColumn("clean", T.strip_urls(F.col("draft"))).withColumn("links", T.urls(F.col("draft")))
    if regenerated:
        rows = rows.withColumn("clean", F.when(T.count_sentences(F.col("clean")) > limit, T.strip_urls(F.col(regenerated))).otherwise(F.col("clean")))
    rows = rows.withColumn("kept", T.trim_sentences(F.col("clean"), limit))
    rows = rows.withColumn("cited", resolve_citation(F.col("draft"), F.col("candidates")))
    evidence = F.array_join(F.transform("candidates", lambda c: c["text"]), " ")
    rows = rows.withColumns({"advice": advice_term(F.col("kept")), "performance": performance_violations(F.col("kept")), "loose": ungrounded(F.col("kept"), evidence)})
    reason = (
        F.when(F.col("advice").isNotNull(), "opinion")
        .when(F.size("performance") > 0, "performance")
        .when(F.size("candidates") == 0, "not_in_corpus")
        .when(F.size("loose") > 0, "not_in_corpus")
    )
    answer = F.trim(F.regexp_replace(F.regexp_replace(F.col("kept"), r"\s*" + T.MARKER.replace("(?i)", "(?i)"), ""), r"\s+([.,;:])", "$1"))
    told = F.create_map(*(F.lit(x) for pair in REFUSALS.items() for x in pair))
    notes = F.concat_ws("; ", F.when(F.size("links") > 0, "links removed"), F.when(F.col("kept") != F.col("clean"), "sentences trimmed"), F.when(F.size("loose") > 0, "figures not in evidence"))
    rows = rows.withColumn("reason", reason)
    return rows.select(
        "id", F.col("reason").isNotNull().alias("refused"), "reason", F.when(F.col("reason").isNull(), answer).otherwise(F.element_at(told, F.col("reason"))).alias("answer"),
        F.when(F.col("reason").isNull(), F.col("cited.source_url")).alias("source_url"), notes.alias("notes"),
    )


def refusal(kind: Column, link: Column | None = None) -> Column:
    """The fixed text of a refusal, with a link after an opinion refusal where there is one."""
    told = F.create_map(*(F.lit(x) for pair in REFUSALS.items() for x in pair))
    text = F.element_at(told, kind)
    return text if link is None else F.when((kind == "opinion") & link.isNotNull(), F.concat_ws(" ", text, link)).otherwise(text)


def display_scheme(scheme: Column) -> Column:
    return F.regexp_replace(scheme, PLAN_SUFFIX, "")


def source_list_answer(pages: DataFrame, ordinal: str = "page_id", scheme: str = "scheme") -> DataFrame:
    """One row: all schemes in page order, with commas and a final and."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(ordinal), display_scheme(F.col(scheme)).alias("s")))), lambda p: p["s"])
    rows = pages.agg(F.array_distinct(listed).alias("names"))
    n = F.size("names")
    text = F.when(n <= 2, F.array_join("names", " and ")).otherwise(F.concat(F.array_join(F.slice("names", 1, n - 1), ", "), F.lit(", and "), F.element_at("names", -1)))
    return rows.select(F.when(n > 0, F.concat(F.lit("I answer from these pages: "), text, F.lit("."))).alias("answer"))
