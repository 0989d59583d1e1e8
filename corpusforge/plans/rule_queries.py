"""Routing, personal data, screens, answers and evaluation queries."""

from __future__ import annotations

from corpusforge.functions import text as T
from corpusforge.functions import vocabulary as V
from corpusforge.operators import answers, evaluation, pii, routing, screens
from corpusforge.plans import retrieval_queries as R
from corpusforge.plans import text_queries as X
from corpusforge.plans.base import QUESTIONS_SQL, F, documents, literal, matches, questions, quoted, table, values

STATEMENTS = [
    "The expense ratio is 1.21%.", "The fund returned 18% in 3 years.", "The expense ratio is 1.21% and it returned 18% in 3 years.", "The NAV is Rs. 64.12.", "NAV date: 25 Sep 2026.",
    "The benchmark is the NIFTY 50 Total Return Index.", "Direct Growth option has a minimum of 100.", "Returns have been strong.", "It delivered 12.5% p.a. for years.", "Exit load is 1% within 1 year.",
    "You should buy this now.", "We recommend holding it.", "The lock-in is 3 years.", "12% is the number.", "Nothing to see here", "It gained 4% but the fee is low.", "The CAGR was 11%.",
    "Consider investing more while it lasts.", "The benchmark rose and the fund earned 7%.", "Fund size is 5,000.", "", "The index is there; the yield is 5%.",
]
_STATEMENTS_SQL = f"(SELECT column0 AS id, column1 AS text FROM {values(list(enumerate(STATEMENTS)))})"

DIGITS = ["2363", "2364", "236", "", "12a", "123456789010", "0", "84736430954837284567892", "999941057058", "234567890124", "4 5"]
PANS = ["ABCPE1234F", "abcpe1234f", "ABCXE1234F", "AAAAA1234A", "ABCPE0000F", "ABCPE1111F", "ABCP1234F", "ZZZPZ1234Z", "BBBPB1234B", "ABCTE9876K", "PPPPP1234P"]
PERSONAL = [
    "write to a.b+c@mail.example.org please", "my pan is ABCPE1234F ok", "otp is 482913", "PIN: 1234", "call +91 98765 43210", "a/c no: 123456789012", "number 123456789012345 here", "in 2013 the NAV was 64.12",
    "aadhaar 2345 6789 0124", "nothing", "token = abc123 and password: hunter2", "IFSC HDFC0001234", "card 4111 1111 1111 1111", "folio 98765",
]
_PERSONAL_SQL = f"(SELECT column0 AS id, column1 AS text FROM {values(list(enumerate(PERSONAL)))})"


def intent_route(spark, d):
    return questions(spark, d).withColumn("m", routing.explain(F.col("question"))).select("qid", "m.intent", "m.rule", "m.needs_fallback")


def scheme_scope(spark, d):
    q = T.collapse_ws(F.col("question"))
    return questions(spark, d).select("qid", routing.non_corpus_scheme(q).alias("outside"), routing.names_corpus_scheme(q).alias("inside"))


def source_list_q(spark, d):
    return questions(spark, d).select("qid", routing.is_source_list_question(F.col("question")).alias("asked"))


def perf_claim(spark, d):
    return questions(spark, d).select("qid", routing.is_performance_claim(F.col("question")).alias("claim"))


def _runs(spark, d, shape, given):
    """(run): the stretches of this shape in all documents and conversations, each once, and the given ones."""
    texts = documents(spark, d).select("text").unionAll(table(spark, d, "conversations").select("text"))
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"({shape})"), F.lit(1))).alias("run"))
    return found.unionAll(literal(spark, [(g,) for g in given], "run string")).distinct()


def verhoeff(spark, d):
    return _runs(spark, d, "[0-9]+", DIGITS).select("run", pii.verhoeff_valid(F.col("run")).alias("valid"), pii.verhoeff_digit(F.col("run")).alias("digit"))


def pii_pan(spark, d):
    return _runs(spark, d, "[A-Za-z0-9]+", PANS).where("length(run) between 9 and 11").select("run", pii.is_pan(F.col("run")).alias("valid"))


def pii_aadhaar(spark, d):
    return _runs(spark, d, "[0-9][0-9 -]*[0-9]", DIGITS).select("run", pii.is_aadhaar(F.col("run")).alias("valid"))


def pii_email(spark, d):
    rows = pii.scan(_personal(spark, d))
    return rows.select("id", F.size(F.filter("pii_spans", lambda s: s["kind"] == "email")).alias("n"))


def pii_account(spark, d):
    return documents(spark, d).select("doc_id", F.col("text").rlike(pii.ACCOUNT_BARE).alias("found"))


def redact_email(spark, d):
    rows = pii.scan(_personal(spark, d))
    return rows.select("id", F.sha2(pii.redact(F.col("text"), F.filter("pii_spans", lambda s: s["kind"] == "email")), 256).alias("h"))


def _personal(spark, d):
    return literal(spark, list(enumerate(PERSONAL)), "id long, text string").unionByName(documents(spark, d).select((F.col("doc_id") + 1000).alias("id"), "text"))


def pii_spans(spark, d):
    rows = pii.scan(_personal(spark, d))
    return rows.where("pii_found").select("id", F.array_join("pii_kinds", ",").alias("kinds"), F.size("pii_spans").alias("n"), F.sha2("redacted", 256).alias("redacted"))


def pii_gate(spark, d):
    """What becomes of questions, planted texts and documents under each policy."""
    asked = questions(spark, d).select(F.col("qid").alias("id"), F.col("question").alias("text"))
    rows = pii.scan(asked.unionByName(_personal(spark, d).select(F.concat(F.lit("p"), "id").alias("id"), "text")))
    found = F.col("pii_found")
    return rows.select("id", found.alias("found"), pii.policy(found).alias("action"), pii.policy(found, dry_run=True).alias("dry"), pii.policy(found, block=False).alias("open"))


def log_redact(spark, d):
    # Accented letters are folded, as DuckDB's word boundaries know ASCII only.
    plain = F.regexp_replace("text", "[À-ɏ]", "Z")
    return _personal(spark, d).select("id", F.sha2(pii.log_redact(plain), 256).alias("h"))


def _statements(spark):
    return literal(spark, list(enumerate(STATEMENTS)), "id int, text string")


def advice_screen(spark, d):
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("id"), "text")
    return _statements(spark).select(F.col("id").cast("long"), "text").unionByName(said).select("id", screens.advice_term(F.col("text")).alias("term"))


def _screened(spark, d):
    """The statements, and everything said in conversations; accented letters are folded, as DuckDB's word boundaries know ASCII only."""
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("id"), F.regexp_replace("text", "[À-ɏ]", "Z").alias("text"))
    return _statements(spark).select(F.col("id").cast("long").alias("id"), "text").unionByName(said)


def perf_screen(spark, d):
    return _screened(spark, d).select("id", F.array_join(screens.performance_violations(F.col("text")), "|").alias("reasons"))


def eval_leaks(spark, d):
    return _screened(spark, d).select("id", F.array_join(screens.performance_leaks(F.col("text")), "|").alias("performance"), F.array_join(screens.advice_leaks(F.col("text")), "|").alias("advice"))


def _drafts(spark, d):
    """One draft for each question: an answer that quotes the best candidate, cites by turns, and links."""
    texts = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("https://corpus.example.org/"), "source").alias("source_url"), "text")
    c = F.struct("fused_rank", "chunk_id", "source_url", "text")
    found = R.rrf_fusion(spark, d).join(texts, "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_list(c)).alias("candidates"))
    first = F.substring_index(F.element_at("candidates", 1)["text"], ".", 1)
    kind = F.col("qid") % 4
    draft = (
        F.when(kind == 0, F.concat(first, F.lit(" [S2].")))
        .when(kind == 1, F.concat(first, F.lit(". See https://corpus.example.org/src1 for 77777 more.")))
        .when(kind == 2, F.concat(F.lit("You should buy it. "), first))
        .otherwise(F.concat(first, F.lit(". It returned 18% in 3 years. More. And more. And more.")))
    )
    return found.select(F.col("qid").alias("id"), draft.alias("draft"), "candidates")


def resolve_citation(spark, d):
    return _drafts(spark, d).select("id", screens.resolve_citation(F.col("draft"), F.col("candidates"))["chunk_id"].alias("chunk_id"))


def grounding(spark, d):
    evidence = F.array_join(F.transform("candidates", lambda c: c["text"]), " ")
    return _drafts(spark, d).select("id", F.array_join(screens.ungrounded(F.col("draft"), evidence), "|").alias("loose"))


def validate_answer(spark, d):
    return screens.validate(_drafts(spark, d))


def refusals(spark, d):
    kind = F.when(F.col("qid") % 4 == 0, "opinion").when(F.col("qid") % 4 == 1, "performance").when(F.col("qid") % 4 == 2, "not_in_corpus").otherwise("pii")
    link = F.when(F.col("qid") % 8 == 0, F.lit("https://example.org/learn"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).select("qid", screens.refusal(kind, link).alias("text"))


def source_list_answer(spark, d):
    pages = documents(spark, d).groupBy(F.col("source").alias("page_id")).agg(F.concat(F.lit("Scheme "), F.max("source"), F.lit(" Direct Plan - Growth")).alias("scheme"))
    return screens.source_list_answer(pages)


def answer_batch(spark, d):
    return answers.answer(questions(spark, d), documents(spark, d), table(spark, d, "embeddings"), threshold=0.3, index=R.index_of(spark, d))


def citation_retrieved(spark, d):
    """Labelled pages that some question's candidates hold."""
    got = R.rrf_fusion(spark, d).select(F.col("chunk_id").alias("doc_id"))
    return table(spark, d, "labels").select("doc_id", "quality").join(got, "doc_id", "left_semi")


def _observations(spark, d):
    """Labelled documents as observations: quality as answerable, the first component of the vector as its score."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.abs(F.get("embedding", F.lit(0))).cast("double").alias("s"))
    rows = table(spark, d, "labels").join(vectors, "doc_id", "left")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("answerable"), F.round(F.coalesce("s", F.lit(-1.0)), 4).alias("raw_dense_max"), (F.col("toxic") == 0).alias("gate_routed"),
        (F.col("doc_id") % 3 != 0).alias("facts_in_context"),
    )


def observations(spark, d):
    """One retrieval for each benchmark item, whose first three words are the expected facts."""
    dense, _, fused = R._fused(spark, d)
    asked = R._questions(spark, d).select("qid", "question", (F.col("qid") % 3 != 0).alias("answerable"), F.slice(F.split("question", r"\s+"), 1, 3).alias("facts"))
    texts = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_id"), "text")
    rows = evaluation.observe(asked, dense, fused, texts)
    return rows.select("qid", "answerable", "raw_dense_max", "facts_in_context", F.array_join("missing_facts", " ").alias("missing"), F.array_join("page_ids", " ").alias("pages"))


def obs_union(spark, d):
    probes = table(spark, d, "benchmark").select(F.concat(F.lit("p"), "item_id").alias("id"), F.lit("probe").alias("origin"))
    return _observations(spark, d).select("id", F.lit("sample").alias("origin")).unionByName(probes)


def threshold_sweep(spark, d):
    return evaluation.sweep(_observations(spark, d))


def choose_threshold(spark, d):
    return evaluation.choose(_observations(spark, d))


def composition(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


def _answered(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    text = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("doc_id") % len(STATEMENTS) + 1).cast("int"))
    return rows.select(
        F.col("doc_id").alias("id"), text.alias("answer"), (F.col("doc_id") % 3 == 0).alias("refused"), (F.col("quality") == 0).alias("must_refuse"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("https://corpus.example.org/p")).alias("source_url"), (F.col("doc_id") % 5 != 0).alias("known_url"), (F.col("doc_id") % 7 != 0).alias("retrieved"),
        F.when(F.col("doc_id") % 11 != 0, F.lit("2026-01-01")).alias("last_updated"), (F.col("toxic") == 1).alias("pii_found"),
    )


def run_checks(spark, d):
    return evaluation.run_checks(_answered(spark, d))


def metrics(spark, d):
    return evaluation.metrics(run_checks(spark, d))


def metrics_judged(spark, d):
    """With a score for every label: two for one that is good and not toxic, one for one that is either."""
    scores = table(spark, d, "labels").select((F.col("quality") + 1 - F.col("toxic")).alias("score"))
    return evaluation.metrics(run_checks(spark, d), scores)


#: Replies of a judge, well and badly formed.
REPLIES = ['{"score": 2, "reason": "ok"}', '```json\n{"score": 0, "reason": "bad"}\n```', '{"score": 3, "reason": "x"}', '{"score": true, "reason": "x"}', "no json", '{"score": 1, "reason": "part", "missing": ["a"]}', '{"score": 1}', '{"score": 2, "reason": "x", "missing": "a"}', '{"score": 2, "reason": "x", "unsupported": [1]}', '{"score": 0, "reason": "y", "missing": [], "unsupported": ["b", "c"]}']


def judge_verdicts(spark, d):
    """The battery, and a reply for each label."""
    more = table(spark, d, "labels").select((F.col("doc_id") + 100).alias("id"), F.concat(F.lit('{"score": '), F.col("quality") + 2 * F.col("toxic"), F.lit(', "reason": "r'), "doc_id", F.lit('"}')).alias("reply"))
    return evaluation.parse_verdicts(literal(spark, list(enumerate(REPLIES)), "id long, reply string").unionByName(more)).select("id", "score", "reason")


def judge_mean(spark, d):
    return evaluation.judge_mean(table(spark, d, "labels").select((F.col("quality") + F.col("toxic")).alias("score")))


def non_answer(spark, d):
    more = literal(spark, [(-1, "This is not available here."), (-2, "The page does not mention it"), (-3, "It is 5.")], "id long, text string")
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").unionByName(more)
    return rows.select("id", T.any_match(F.col("text"), V.NON_ANSWERS).alias("non_answer"))


QUERIES = {f.__name__: f for f in (
    intent_route, scheme_scope, source_list_q, perf_claim, verhoeff, pii_pan, pii_aadhaar, pii_email, pii_account, redact_email, pii_spans, pii_gate, log_redact, advice_screen, perf_screen,
    eval_leaks, resolve_citation, grounding, validate_answer, refusals, source_list_answer, answer_batch, citation_retrieved, observations, obs_union, threshold_sweep, choose_threshold,
    composition, run_checks, metrics, metrics_judged, judge_verdicts, judge_mean, non_answer,
)}

_EMAIL = pii.EMAIL
_PERSONAL_ALL = f"(SELECT CAST(id AS BIGINT) AS id, text FROM {_PERSONAL_SQL} UNION ALL SELECT doc_id + 1000, text FROM documents)"
_KNOWN, _PLAIN = values([(w,) for w in routing.scheme_words(V.SCHEMES)]), "[" + ", ".join(map(quoted, V.NOT_DISTINCTIVE)) + "]"
_KNOWN = "[" + ", ".join(map(quoted, routing.scheme_words(V.SCHEMES))) + "]"
#: Phrases in one expression each, as an engine without token rules finds them.
_NAME = "[A-Za-z0-9&.\\-]*"
_CAPITALS, _LOWER, _ETF = rf"\b(?:[A-Z]{_NAME} ){{1,4}}Fund\b", rf"\b{V.AMC}(?: [a-z0-9&.\-]+){{1,4}} fund\b", rf"(?i)\b{V.AMC}(?: {_NAME}){{0,5}} etfs?\b"
_PHRASES = f"list_concat(list_concat(regexp_extract_all(q, {quoted(_CAPITALS)}), regexp_extract_all(q, {quoted(_LOWER)})), regexp_extract_all(q, {quoted(_ETF)}))"
_SCOPED = f"""(SELECT *, len(list_filter(own, lambda o: len(o) > 0 AND len(list_filter(o, lambda w: NOT list_contains({_KNOWN}, w))) > 0)) > 0 AS outside,
  len(list_filter(own, lambda o: len(o) > 0 AND len(list_filter(o, lambda w: NOT list_contains({_KNOWN}, w))) = 0)) > 0 AS inside FROM (
  SELECT *, list_transform(list_filter(list_transform({_PHRASES}, lambda p: string_split_regex(lower(p), '[^a-z0-9]+')), lambda ws: list_contains(ws, 'hdfc')),
    lambda ws: list_filter(ws, lambda w: w <> '' AND NOT list_contains({_PLAIN}, w))) AS own FROM {QUESTIONS_SQL}))"""
_ASKED = "(" + " OR ".join(matches("q", p) for p in V.SOURCE_LIST) + f") AND NOT {matches('q', V.FUND_FIELD)} AND NOT inside"
_STEPS = [(matches("q", V.STATEMENT_REQUEST), "factual", "statement_request")]
_STEPS += [(matches("q", p), "out_of_scope", n) for n, p in V.DOMAINS] + [(matches("q", p), "opinion", n) for n, p in V.OPINION]
_STEPS += [(matches("q", V.OTHER_AMC), "out_of_scope", "other_amc"), ("outside", "out_of_scope", "non_corpus_scheme"), (_ASKED, "corpus_sources", "source_list")]
_STEPS += [(matches("q", p), "factual", n) for n, p in V.FACTUAL]
_ROUTE = " ".join(f"WHEN {test} THEN {quoted(intent + '/' + rule)}" for test, intent, rule in _STEPS)
_FIGURES = "len(list_filter(regexp_extract_all(regexp_replace({c}, '\\[S\\d+\\]', ' ', 'gi'), '\\d'), lambda f: true)) > 0"


def _clause_list(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
    return f"list_filter(list_transform(string_split({column}, chr(31)), lambda c: trim(c)), lambda c: c <> '')"


_PLAN = f"regexp_replace(c, {quoted(V.PLAN_NAMES)}, ' ', 'gi')"
_CLAUSE = f"""CASE WHEN {matches('c', V.INDEX_NAMES)} THEN NULL
  WHEN NOT regexp_matches(regexp_replace(c, '\\[S\\d+\\]', ' ', 'gi'), '\\d') THEN CASE WHEN {matches(_PLAN, V.RETURNS)} AND NOT {matches(_PLAN, V.FEES)} THEN 'return language without a fee' END
  WHEN {matches(_PLAN, V.NAV)} AND NOT {matches(_PLAN, V.DATEISH)} THEN 'NAV value' WHEN {matches(_PLAN, V.FEES)} THEN NULL WHEN {matches(_PLAN, V.RETURNS)} THEN 'return figure'
  WHEN {matches(_PLAN, V.PERIODS)} THEN 'period-attached figure' WHEN regexp_matches(c, '\\d\\s*%') THEN 'unattributed percentage' END"""
_LEAK = f"""CASE WHEN {matches(_PLAN, V.EVAL_INDEX)} OR {matches(_PLAN, V.EVAL_FEES)} THEN NULL WHEN {matches(_PLAN, V.EVAL_NAV)} THEN 'NAV value' WHEN {matches(_PLAN, V.PERIOD_PERCENT)} THEN 'period-attached figure'
  WHEN {matches(_PLAN, V.EVAL_RETURNS)} AND regexp_matches({_PLAN}, {quoted(V.BARE_PERCENT)}) THEN 'return figure' WHEN {matches(_PLAN, V.EVAL_RETURNS)} THEN 'return language without a figure'
  WHEN regexp_matches({_PLAN}, {quoted(V.BARE_PERCENT)}) THEN 'unattributed percentage' END"""
_SCREENED_SQL = f"(SELECT CAST(id AS BIGINT) AS id, text FROM {_STATEMENTS_SQL} UNION ALL SELECT conv_id * 1000 + turn + 100, regexp_replace(text, '[À-ɏ]', 'Z', 'g') FROM conversations)"
_DRAFTS = f"""{R._FUSED}, cand AS (SELECT qid, list(struct_pack(chunk_id := chunk_id, url := 'https://corpus.example.org/' || source, text := text) ORDER BY fused_rank) AS c FROM fused JOIN documents ON doc_id = chunk_id GROUP BY qid),
  drafts AS (SELECT qid AS id, c, CASE qid % 4 WHEN 0 THEN first || ' [S2].' WHEN 1 THEN first || '. See https://corpus.example.org/src1 for 77777 more.' WHEN 2 THEN 'You should buy it. ' || first
    ELSE first || '. It returned 18% in 3 years. More. And more. And more.' END AS text FROM (SELECT *, split_part(c[1].text, '.', 1) AS first FROM cand))"""
_NORM = "coalesce(regexp_replace(printf('%.6f', try_cast(replace(regexp_replace(trim({0}), '[₹$% xX]', '', 'g'), ',', '') AS DOUBLE)), '\\.?0+$', ''), '')"
_FIGURE_LIST = "list_filter(regexp_extract_all(regexp_replace({0}, '\\[S\\d+\\]', ' ', 'gi'), '[₹$]?\\s?\\d[\\d,]*\\.?\\d*\\s?(?:%|x|X\\b)?'), lambda f: " + _NORM.format("f") + " <> '')"
_VIOLATIONS = f"list_filter(list_transform({_clause_list('text', screens.CLAUSE_STEPS)}, lambda c: {_CLAUSE}), lambda r: r IS NOT NULL)"
_CITED = f"""{_DRAFTS}, m AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '(?i)\\[S(\\d{{1,6}})\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND len(c)) AS marks,
    list_transform({X.LINKS}, lambda u: regexp_replace(u, '[.,;:!?]+$', '')) AS links FROM drafts),
  cited AS (SELECT id, c, text, CASE WHEN len(marks) > 0 THEN c[marks[1]] ELSE coalesce((list_filter(c, lambda x: list_contains(links, x.url)))[1], c[1]) END AS cited FROM m)"""
_HAYSTACK = f"""array_to_string(list_transform({_FIGURE_LIST.format("array_to_string(list_transform(c, lambda x: x.text), ' ')")}, lambda f: {_NORM.format('f')}), ' ')"""
_LOOSE = f"list_filter({_FIGURE_LIST.format('text')}, lambda f: NOT contains(haystack, {_NORM.format('f')}))"
_BARE_REPLY = "trim(regexp_replace(regexp_replace(reply, '^\\s*```(?:json)?\\s*', ''), '\\s*```\\s*$', ''))"
_OBS = """(SELECT CAST(l.doc_id AS VARCHAR) AS id, quality = 1 AS answerable, round(coalesce(abs(CAST(embedding[1] AS DOUBLE)), -1.0), 4) AS raw_dense_max, toxic = 0 AS gate_routed, l.doc_id % 3 <> 0 AS facts_in_context
  FROM labels l LEFT JOIN embeddings e ON vec_id = l.doc_id)"""
_TEXTS = "[" + ", ".join(map(quoted, STATEMENTS)) + "]"
_EVAL_LIST = _clause_list("text", screens.EVAL_STEPS)
_REASONS = f"list_filter(list_transform({_EVAL_LIST}, lambda c: {_LEAK}), lambda r: r IS NOT NULL)"
_ADVICE = f"list_filter(flatten(list_transform({_EVAL_LIST}, lambda c: [CASE WHEN {matches('c', V.DIRECTIVES)} THEN 'directive' END, CASE WHEN {matches('c', V.BARE_SHOULD)} THEN 'recommendation' END])), lambda r: r IS NOT NULL)"
_SENTENCES = "len(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])[\"'')\\]]*\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> ''))"
_CHECKS = f"""(WITH a AS (SELECT doc_id AS id, ({_TEXTS})[doc_id % {len(STATEMENTS)} + 1] AS text, doc_id % 3 = 0 AS refused, quality = 0 AS must_refuse, doc_id % 2 = 0 AS cited,
    doc_id % 5 <> 0 AS known_url, doc_id % 7 <> 0 AS retrieved, doc_id % 11 <> 0 AS dated, toxic = 1 AS pii_found FROM labels)
  SELECT id, 'M-4' AS metric, 'advice' AS name, len({_ADVICE}) = 0 AS passed FROM a UNION ALL SELECT id, 'M-5', 'performance', len({_REASONS}) = 0 FROM a UNION ALL SELECT id, 'PII', 'absent', NOT pii_found FROM a
  UNION ALL SELECT id, 'M-3', 'refusal_correct', must_refuse FROM a WHERE refused UNION ALL SELECT id, 'M-3', 'leaks_nothing', NOT cited FROM a WHERE refused
  UNION ALL SELECT id, 'M-2', 'citation_in_corpus', known_url FROM a WHERE NOT refused UNION ALL SELECT id, 'M-2', 'citation_retrieved', retrieved FROM a WHERE NOT refused
  UNION ALL SELECT id, 'M-6', 'sentence_limit', {_SENTENCES} <= 3 FROM a WHERE NOT refused UNION ALL SELECT id, 'M-7', 'one_link', cited FROM a WHERE NOT refused
  UNION ALL SELECT id, 'M-7', 'last_updated', dated FROM a WHERE NOT refused UNION ALL SELECT id, 'M-3', 'refusal_correct', false FROM a WHERE NOT refused AND must_refuse)"""
def _runs_sql(shape: str, given: list[str]) -> str:
    return f"""(SELECT DISTINCT run, run AS digits, [{', '.join(map(str, pii._FLAT_TIMES))}] AS d, [{', '.join(map(str, pii._FLAT_MOVES))}] AS p FROM (
      SELECT unnest(regexp_extract_all(text, '{shape}')) AS run FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) UNION ALL SELECT column0 FROM {values([(g,) for g in given])}))"""


def _sum(offset: int) -> str:
    steps = f"list_transform(range(0, length(digits)), lambda i: p[((i + {offset}) % 8) * 10 + CAST(reverse(digits)[i + 1] AS INTEGER) + 1])"
    return f"list_reduce(list_concat([0], {steps}), lambda c, x: d[c * 10 + x + 1])"


#: What each kind's detector finds; an Aadhaar candidate counts if its check digit is right.
_FOUND = [
    f"regexp_matches(text, {quoted(pii.EMAIL)})", f"regexp_matches(text, {quoted(pii.ACCOUNT_LABELLED)})", "regexp_matches(text, '(^|[^\\d.,\\-/])\\d{12,18}($|[^\\d.,\\-/])')",
    "regexp_matches(text, '(^|\\D)(?:\\+?91[\\s-]?)?0?[6-9]\\d{4}[\\s-]?\\d{5}($|\\D)')", f"regexp_matches(text, {quoted(pii.OTP_CUED)})", f"regexp_matches(text, '(?i)\\b[A-Z]{{3}}[{pii.ENTITY_LETTERS}][A-Z]\\d{{4}}[A-Z]\\b')",
    f"len(list_filter(list_transform(regexp_extract_all(text, {quoted(pii.AADHAAR)}), lambda x: regexp_replace(x, '\\D', '', 'g')), lambda n: {_sum(0).replace('digits', 'n').replace('lambda i: p[', f'lambda i: {pii._FLAT_MOVES}[').replace('lambda c, x: d[', f'lambda c, x: {pii._FLAT_TIMES}[')} = 0)) > 0",
]


def _span_rows(kind: str, pattern: str, marked: str, valid: str = "true") -> str:
    """(id, rank, start, size, kind): the pieces between marks that a replacement puts around matches."""
    return f"""SELECT id, {pii.PRIORITY.index(kind)} AS rank, start, size, '{kind}' AS kind FROM (SELECT *, length(piece) AS size, sum(length(piece)) OVER (PARTITION BY id ORDER BY i) - length(piece) AS start FROM (
      SELECT id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT id, string_split(regexp_replace(folded, {quoted(pattern)}, {marked}, 'g'), chr(1)) AS pieces FROM texts))) WHERE i % 2 = 0 AND {valid}"""


_WHOLE, _SECOND = "chr(1) || '\\0' || chr(1)", "'\\1' || chr(1) || '\\2' || chr(1)"
_DIGIT_RUN = "regexp_replace(piece, '\\D', '', 'g')"
_VERHOEFF_OK = f"{_sum(0).replace('digits', _DIGIT_RUN).replace('lambda i: p[', f'lambda i: {pii._FLAT_MOVES}[').replace('lambda c, x: d[', f'lambda c, x: {pii._FLAT_TIMES}[')} = 0"
_PAN_OK = "regexp_matches(upper(piece), '^[A-Z]{3}[PCAHBGLJFT]') AND substr(upper(piece), 1, 5) NOT IN ('AAAAA', 'XXXXX', 'ZZZZZ') AND substr(piece, 6, 4) NOT IN ('0000', '1111') AND len(list_distinct(string_split(upper(substr(piece, 1, 5) || substr(piece, 10, 1)), ''))) > 1"
#: An account number without a label is a whole stretch of digits and their marks; a phone number takes the marks around it along.
_SPAN_SETS = " UNION ALL ".join((
    _span_rows("email", pii.EMAIL, _WHOLE), _span_rows("aadhaar", pii.AADHAAR, _WHOLE, f"len(list_distinct(string_split({_DIGIT_RUN}, ''))) > 1 AND {_VERHOEFF_OK}"), _span_rows("pan", pii.PAN, _WHOLE, _PAN_OK),
    _span_rows("account", pii.ACCOUNT_LABELLED, _SECOND), _span_rows("account", "[\\d.,\\-/]+", _WHOLE, "regexp_full_match(piece, '\\d{12,18}')"),
    _span_rows("phone", "(^|\\D)((?:\\+?91[\\s-]?)?0?[6-9]\\d{4}[\\s-]?\\d{5})($|\\D)", "'\\1' || chr(1) || '\\2' || chr(1) || '\\3'"), _span_rows("otp", pii.OTP_CUED, _SECOND),
))
_SPANS = f"""WITH texts AS (SELECT id, text, regexp_replace(text, '[À-ɏ]', 'Z', 'g') AS folded FROM {_PERSONAL_ALL}), found AS ({_SPAN_SETS}),
listed AS (SELECT id, list([struct_pack(start := start, stop := start + size, kind := kind)] ORDER BY rank, size DESC, start) AS all_ FROM found GROUP BY id),
kept AS (SELECT id, list_sort(list_reduce(all_, lambda done, x: CASE WHEN len(list_filter(done, lambda k: k.start < x[1].stop AND x[1].start < k.stop)) > 0 THEN done ELSE list_concat(done, x) END)) AS spans FROM listed),
named AS (SELECT id, spans, list_transform(spans, lambda s: s.kind) AS kinds, list_transform(spans, lambda s: s.start || ':' || (s.stop - s.start)) AS cuts FROM kept)
SELECT id, array_to_string(list_filter(kinds, lambda k, i: list_position(kinds, k) = i), ',') AS kinds, CAST(len(spans) AS INTEGER) AS n,
  sha256(list_reduce(list_concat([text], cuts), lambda t, c: substr(t, 1, CAST(split_part(c, ':', 1) AS INTEGER)) || repeat('*', CAST(split_part(c, ':', 2) AS INTEGER)) || substr(t, CAST(split_part(c, ':', 1) AS INTEGER) + CAST(split_part(c, ':', 2) AS INTEGER) + 1))) AS redacted
FROM named JOIN texts USING (id)"""
_LOG = "regexp_replace(text, '[À-ɏ]', 'Z', 'g')"
for _p, _m in pii.LOG_SHAPES:
    _LOG = f"regexp_replace({_LOG}, {quoted(_p)}, {quoted(_m.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
_ENDS_WITH = lambda labels, fillers: f"regexp_matches(before, {quoted(f'(?i){pii.label(labels, fillers)}$')})"
_LOG_KIND = f"""CASE WHEN i % 2 = 1 OR regexp_matches(before, '[0-9A-Za-z_]$') OR regexp_matches(after, '^[0-9A-Za-z_]') THEN NULL
  WHEN length(run) = n AND n BETWEEN 4 AND 6 AND {_ENDS_WITH(pii.OTP_LABELS, pii.OTP_FILLERS)} THEN 'OTP' WHEN length(run) = n AND n BETWEEN 9 AND 18 AND {_ENDS_WITH(pii.ACCOUNT_LABELS, pii.ACCOUNT_FILLERS)} THEN 'ACCOUNT'
  WHEN n = 12 AND regexp_matches(run, '^....[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}$') THEN 'AADHAAR' WHEN regexp_matches(run, {quoted(pii.PHONE_GROUPS)}) THEN 'PHONE' WHEN n IN (15, 16) OR (n > 16 AND length(run) > n) THEN 'CARD'
  WHEN length(run) = n AND n BETWEEN 9 AND 18 AND right(before, 1) <> '.' AND left(after, 1) <> '.' THEN 'NUMBER' END"""
_LOGGED = f"""SELECT id, sha256(string_agg(coalesce('[REDACTED_' || kind || ']', run), '' ORDER BY i)) AS h FROM (SELECT *, {_LOG_KIND} AS kind FROM (
  SELECT *, length(regexp_replace(run, '[ -]', '', 'g')) AS n, coalesce(lag(run) OVER w, '') AS before, coalesce(lead(run) OVER w, '') AS after FROM (
    SELECT id, unnest(pieces) AS run, generate_subscripts(pieces, 1) AS i FROM (SELECT id, string_split(regexp_replace({_LOG}, {quoted(pii.DIGITS)}, {_WHOLE}, 'g'), chr(1)) AS pieces FROM {_PERSONAL_ALL}))
  WINDOW w AS (PARTITION BY id ORDER BY i))) GROUP BY id"""

SQL = {
    "intent_route": f"""SELECT qid, split_part(r, '/', 1) AS intent, split_part(r, '/', 2) AS rule, split_part(r, '/', 2) IN ('empty', 'default:unmatched') AS needs_fallback
      FROM (SELECT qid, CASE WHEN q = '' THEN 'out_of_scope/empty' {_ROUTE} ELSE 'factual/default:unmatched' END AS r FROM {_SCOPED})""",
    "scheme_scope": f"SELECT qid, outside, inside FROM {_SCOPED}",
    "source_list_q": f"SELECT qid, {_ASKED} AS asked FROM {_SCOPED}",
    "perf_claim": f"""SELECT qid, {matches('q', V.PERF_NUMBER)} OR {matches('q', V.PERF_RANKING)} OR {matches('q', V.PERF_NAV)} OR ({matches('q', V.PERF_PERIOD)} AND NOT {matches('q', V.PERF_FEE)}) OR {matches('q', V.PERF_WORDS)}
      OR {matches(f"regexp_replace(q, {quoted(V.PERF_MEASURES)}, ' ', 'gi')", V.PERF_NOUN)} AS claim FROM {QUESTIONS_SQL}""",
    "verhoeff": f"""SELECT run, CASE WHEN regexp_matches(digits, '^[0-9]+$') THEN {_sum(0)} = 0 ELSE false END AS valid,
      CASE WHEN regexp_matches(digits, '^[0-9]+$') THEN ([{', '.join(map(str, pii.INVERSE))}])[{_sum(1)} + 1] END AS digit FROM {_runs_sql('[0-9]+', DIGITS)}""",
    "pii_pan": f"""SELECT run, regexp_matches(c, '^[A-Z]{{3}}[PCAHBGLJFT][A-Z]\\d{{4}}[A-Z]$') AND substr(c, 1, 5) NOT IN ('AAAAA', 'XXXXX', 'ZZZZZ') AND substr(c, 6, 4) NOT IN ('0000', '1111')
      AND NOT (len(list_distinct(string_split(substr(c, 1, 5) || substr(c, 10, 1), ''))) = 1) AS valid FROM (SELECT run, upper(run) AS c FROM {_runs_sql('[A-Za-z0-9]+', PANS)} WHERE length(run) BETWEEN 9 AND 11)""",
    "pii_aadhaar": f"""SELECT run, length(n) = 12 AND NOT regexp_matches(n, '^[01]') AND len(list_distinct(string_split(n, ''))) > 1 AND {_sum(0).replace('digits', 'n')} = 0 AS valid
      FROM (SELECT *, regexp_replace(digits, '\\D', '', 'g') AS n FROM {_runs_sql('[0-9][0-9 -]*[0-9]', DIGITS)})""",
    "pii_email": f"SELECT id, CAST(len(regexp_extract_all(text, '{_EMAIL}')) AS INTEGER) AS n FROM {_PERSONAL_ALL}",
    "pii_spans": _SPANS,
    "pii_account": "SELECT doc_id, regexp_matches(text, '(^|[^\\d.,\\-/])\\d{12,18}($|[^\\d.,\\-/])') AS found FROM documents",
    "redact_email": f"SELECT id, sha256(list_reduce(list_concat([text], regexp_extract_all(text, '{_EMAIL}')), lambda t, e: replace(t, e, repeat('*', length(e))))) AS h FROM {_PERSONAL_ALL}",
    "pii_gate": f"""SELECT id, found, CASE WHEN found THEN 'block' ELSE 'pass' END AS action, CASE WHEN found THEN 'mark' ELSE 'pass' END AS dry, 'pass' AS open FROM (SELECT id, {' OR '.join(_FOUND)} AS found FROM (
      SELECT qid AS id, question AS text FROM {QUESTIONS_SQL} UNION ALL SELECT 'p' || id, text FROM {_PERSONAL_ALL}))""",
    "log_redact": _LOGGED,
    "advice_screen": f"""SELECT id, nullif(lower(regexp_extract(regexp_replace(text, '[À-ɏ]', 'Z', 'g'), {quoted('(?i)' + V.ADVICE)})), '') AS term FROM (
      SELECT CAST(id AS BIGINT) AS id, text FROM {_STATEMENTS_SQL} UNION ALL SELECT conv_id * 1000 + turn + 100, text FROM conversations)""",
    "perf_screen": f"SELECT id, array_to_string({_VIOLATIONS}, '|') AS reasons FROM {_SCREENED_SQL}",
    "eval_leaks": f"SELECT id, array_to_string({_REASONS}, '|') AS performance, array_to_string({_ADVICE}, '|') AS advice FROM {_SCREENED_SQL}",
    "refusals": f"""SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN {quoted(screens.REFUSALS['opinion'])} || CASE WHEN item_id % 8 = 0 THEN ' https://example.org/learn' ELSE '' END
      WHEN 1 THEN {quoted(screens.REFUSALS['performance'])} WHEN 2 THEN {quoted(screens.REFUSALS['not_in_corpus'])} ELSE {quoted(screens.REFUSALS['pii'])} END AS text FROM benchmark""",
    "source_list_answer": """WITH s AS (SELECT DISTINCT source FROM documents), n AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS back, count(*) OVER () AS n FROM s)
      SELECT 'I answer from these pages: ' || string_agg(CASE WHEN back = 1 AND n > 2 THEN 'and ' ELSE '' END || 'Scheme ' || source, ', ' ORDER BY source) || '.' AS answer FROM n GROUP BY n""",
    "citation_retrieved": f"WITH {R._FUSED} SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT chunk_id FROM fused)",
    "observations": f"""WITH {R._FUSED}, held AS (SELECT qid, string_agg(text, chr(10) ORDER BY fused_rank) AS context, array_to_string(list_sort(list(DISTINCT source)), ' ') AS pages FROM fused JOIN documents ON doc_id = chunk_id GROUP BY qid),
      m AS (SELECT q.qid, top, pages, list_filter((string_split_regex(question, '\\s+'))[1:3], lambda f: NOT contains(coalesce(context, ''), f)) AS missing FROM q
        LEFT JOIN (SELECT qid, max(dense_score) AS top FROM dense GROUP BY qid) t ON t.qid = q.qid LEFT JOIN held h ON h.qid = q.qid)
      SELECT qid, qid % 3 <> 0 AS answerable, coalesce(top, -1.0) AS raw_dense_max, len(missing) = 0 AS facts_in_context, array_to_string(missing, ' ') AS missing, coalesce(pages, '') AS pages FROM m""",
    "resolve_citation": f"WITH {_CITED} SELECT id, cited.chunk_id AS chunk_id FROM cited",
    "grounding": f"""WITH {_DRAFTS}, h AS (SELECT *, {_HAYSTACK} AS haystack FROM drafts)
      SELECT id, array_to_string({_LOOSE}, '|') AS loose FROM h""",
    "validate_answer": f"""WITH {_CITED}, s AS (SELECT id, len(c) AS n_candidates, cited, {_HAYSTACK} AS haystack, len({X.LINKS}) > 0 AS linked, {X.STRIPPED} AS text FROM cited),
      k AS (SELECT id, n_candidates, cited, haystack, linked, kept <> text AS cut, kept AS text FROM {X.trimmed('s')}),
      v AS (SELECT *, len({_LOOSE}) > 0 AS loose, CASE WHEN regexp_matches(text, {quoted('(?i)' + V.ADVICE)}) THEN 'opinion' WHEN len({_VIOLATIONS}) > 0 THEN 'performance'
        WHEN n_candidates = 0 OR len({_LOOSE}) > 0 THEN 'not_in_corpus' END AS reason FROM k)
      SELECT id, reason IS NOT NULL AS refused, reason, CASE reason {' '.join(f"WHEN {quoted(k)} THEN {quoted(t)}" for k, t in screens.REFUSALS.items())}
        ELSE trim(regexp_replace(regexp_replace(text, '\\s*\\[S\\d+\\]', '', 'gi'), '\\s+([.,;:])', '\\1', 'g')) END AS answer, CASE WHEN reason IS NULL THEN cited.url END AS source_url,
        concat_ws('; ', CASE WHEN linked THEN 'links removed' END, CASE WHEN cut THEN 'sentences trimmed' END, CASE WHEN loose THEN 'figures not in evidence' END) AS notes FROM v""",
    "judge_verdicts": f"""WITH r AS (SELECT CAST(column0 AS BIGINT) AS id, column1 AS reply FROM {values(list(enumerate(REPLIES)))} UNION ALL SELECT doc_id + 100, '{{"score": ' || (quality + 2 * toxic) || ', "reason": "r' || doc_id || '"}}' FROM labels),
      b AS (SELECT id, {_BARE_REPLY} AS bare FROM r), p AS (SELECT *, regexp_extract(bare, '"score"\\s*:\\s*(-?[0-9]+)\\s*[,}}]', 1) AS whole, CASE WHEN json_valid(bare) THEN bare END AS j FROM b),
      g AS (SELECT *, coalesce(whole IN ('0', '1', '2') AND json_extract_string(j, '$.reason') IS NOT NULL
        AND coalesce(regexp_matches(CAST(json_extract(j, '$.missing') AS VARCHAR), {quoted(evaluation.STRING_LIST)}), true) AND coalesce(regexp_matches(CAST(json_extract(j, '$.unsupported') AS VARCHAR), {quoted(evaluation.STRING_LIST)}), true), false) AS good FROM p)
      SELECT id, CASE WHEN good THEN CAST(whole AS INTEGER) END AS score, CASE WHEN good THEN json_extract_string(j, '$.reason') END AS reason FROM g""",
    "obs_union": f"SELECT id, 'sample' AS origin FROM {_OBS} UNION ALL SELECT 'p' || item_id, 'probe' FROM benchmark",
    "threshold_sweep": f"""WITH t AS (SELECT CAST(round(i * 0.01, 2) AS DOUBLE) AS threshold FROM range(96) AS g(i)), o AS (SELECT * FROM {_OBS}), c AS (SELECT threshold,
        count(*) FILTER (WHERE answerable AND raw_dense_max >= threshold) AS factual_passed, count(*) FILTER (WHERE answerable AND raw_dense_max >= threshold AND facts_in_context) AS facts_passed,
        count(*) FILTER (WHERE NOT answerable AND raw_dense_max >= threshold) AS negatives_passed, count(*) FILTER (WHERE answerable) AS f, count(*) FILTER (WHERE NOT answerable) AS n FROM t, o GROUP BY threshold)
      SELECT threshold, factual_passed, facts_passed, negatives_passed, round(facts_passed / nullif(f, 0), 6) AS m1_proxy, round(1 - negatives_passed / nullif(n, 0), 6) AS m3, round(negatives_passed / nullif(n, 0), 6) AS false_answer_rate FROM c""",
    "choose_threshold": f"""SELECT CASE WHEN lower < upper THEN round((lower + upper) / 2, 4) END AS threshold, CASE WHEN lower IS NULL OR upper IS NULL THEN 'missing_class' WHEN lower >= upper THEN 'overlap' ELSE 'midpoint' END AS rule,
      coalesce(lower < upper, false) AS feasible, lower, upper FROM (SELECT max(raw_dense_max) FILTER (WHERE gate_routed AND NOT answerable) AS lower, min(raw_dense_max) FILTER (WHERE gate_routed AND answerable) AS upper FROM {_OBS})""",
    "composition": "SELECT quality, toxic, count(*) AS n, count(DISTINCT doc_id) AS ids FROM labels GROUP BY quality, toxic",
    "run_checks": f"SELECT * FROM {_CHECKS}",
    "metrics": f"""SELECT m AS metric, coalesce(n, 0) AS numerator, coalesce(d, 0) AS denominator, CASE WHEN coalesce(d, 0) = 0 THEN 'unavailable' WHEN n = d THEN 'pass' ELSE 'fail' END AS status FROM unnest({evaluation.METRICS}) AS u(m)
      LEFT JOIN (SELECT metric, count_if(passed) AS n, count(*) AS d FROM {_CHECKS} GROUP BY metric) c ON c.metric = m""",
    "metrics_judged": f"""WITH c AS (SELECT metric, count_if(passed) AS n, count(*) AS d FROM {_CHECKS} GROUP BY metric),
      j AS (SELECT CAST(sum(quality + 1 - toxic) AS BIGINT) AS n, 2 * count(*) AS d, avg(quality + 1 - toxic) AS mean FROM labels)
      SELECT 'M-1' AS metric, n AS numerator, d AS denominator, CASE WHEN mean >= {evaluation.JUDGED} THEN 'pass' ELSE 'fail' END AS status FROM j
      UNION ALL SELECT m, CAST(coalesce(n, 0) AS BIGINT), CAST(coalesce(d, 0) AS BIGINT), CASE WHEN coalesce(d, 0) = 0 THEN 'unavailable' WHEN n = d THEN 'pass' ELSE 'fail' END FROM unnest({evaluation.METRICS[1:]}) AS u(m) LEFT JOIN c ON c.metric = m""",
    "judge_mean": "SELECT CASE WHEN count(*) > 0 AND count(quality + toxic) = count(*) THEN round(avg(quality + toxic), 2) END AS mean, count(*) AS n FROM labels",
    "non_answer": f"""SELECT id, {' OR '.join(matches('text', p) for p in V.NON_ANSWERS)} AS non_answer FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations
      UNION ALL SELECT column0, column1 FROM {values([(-1, "This is not available here."), (-2, "The page does not mention it"), (-3, "It is 5.")])})""",
}
