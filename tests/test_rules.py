import pytest
from pyspark.sql import functions as F

from corpusforge.operators import answers, evaluation, pii, routing, screens


def applied(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.select(F.col("i"), expr(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


ROUTES = [
    ("What is the exit load on HDFC Equity Fund?", "factual", "exit_load"), ("What is the asset allocation?", "factual", "asset_allocation"), ("What are the top 10 holdings?", "factual", "holdings"),
    ("Can I redeem after 3 years?", "factual", "default:unmatched"), ("Should I invest?", "opinion", "should_i"), ("how to download my capital gains statement", "factual", "statement_request"),
    ("income tax return help", "out_of_scope", "tax"), ("best fd rate", "out_of_scope", "banking"), ("is SBI bluechip good fund to buy", "opinion", "buy"), ("expense ratio of SBI Bluechip", "out_of_scope", "other_amc"),
    ("NAV of HDFC Mid Cap Opportunities Fund", "out_of_scope", "non_corpus_scheme"), ("charges of hdfc nifty 50 etf", "out_of_scope", "non_corpus_scheme"), ("minimum for HDFC Large Cap Fund", "factual", "minimum"),
    ("Which funds do you cover?", "corpus_sources", "source_list"), ("How many schemes are covered?", "corpus_sources", "source_list"), ("expense ratios of the funds you cover", "factual", "default:unmatched"),
    ("What do you know about HDFC Large Cap Fund?", "factual", "corpus_scheme"), ("", "out_of_scope", "empty"), (None, "out_of_scope", "empty"), ("why to invest", "factual", "reasons_to_invest"),
]


def test_routes(spark):
    got = applied(spark, [q for q, _, _ in ROUTES], routing.explain)
    assert [(r.intent, r.rule) for r in got] == [(i, r) for _, i, r in ROUTES]
    assert [r.needs_fallback for r in got] == [rule in ("empty", "default:unmatched") for _, _, rule in ROUTES]


CLAIMS = [("18% in 3 years", True), ("What is the CAGR?", True), ("latest NAV today", True), ("exit load after 3 years", False), ("performance risk", False), ("past performance", True), ("expense ratio?", False), ("over 5 years", True)]


def test_performance_claims(spark):
    assert applied(spark, [q for q, _ in CLAIMS], routing.is_performance_claim) == [c for _, c in CLAIMS]


def test_verhoeff(spark):
    assert applied(spark, ["236"], pii.verhoeff_digit) == [3]
    assert applied(spark, ["2363", "2364", "", "12a", "2363 "], pii.verhoeff_valid) == [True, False, False, False, False]
    good = "2363"
    changed = [good[:i] + d + good[i + 1 :] for i in range(4) for d in "0123456789" if d != good[i]]
    swapped = [good[:i] + good[i + 1] + good[i] + good[i + 2 :] for i in range(3) if good[i] != good[i + 1]]
    assert not any(applied(spark, changed + swapped, pii.verhoeff_valid))


def test_pan(spark):
    cases = {"ABCPE1234F": True, "abcpe1234f": True, "ABCXE1234F": False, "AAAAA1234A": False, "ABCPE0000F": False, "ABCPE1111F": False, "PPPPP1234P": False}
    assert applied(spark, list(cases), pii.is_pan) == list(cases.values())
    assert [bool(pii._pan(c)) for c in cases] == list(cases.values())


SPANS = [
    ("mail a.b@x.org now", ["email"]), ("otp is 482913", ["otp"]), ("call +91 98765 43210", ["phone"]), ("a/c no: 123456789012", ["account"]), ("in 2013 it was 64.12 and 1.03%", []),
    ("pan ABCPE1234F", ["pan"]), ("order 123456", []), ("", []), (None, []), ("123456789012345", ["account"]),
]


def test_spans_and_redaction(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPANS)], "i int, text string")
    rows = pii.scan(df).orderBy("i").collect()
    assert [r.pii_kinds for r in rows] == [k for _, k in SPANS]
    for r in rows:
        assert r.redacted is None or len(r.redacted) == len(r.text)
    again = pii.scan(spark.createDataFrame([(r.i, r.redacted) for r in rows], "i int, text string"))
    assert again.where("pii_found").count() == 0
    assert rows[1].redacted == "otp is ******"


def test_log_redaction(spark):
    got = applied(spark, ["token = abc", "mail a@b.org", "otp is 1234", "card 4111 1111 1111 1111 x", "n 123456789 m"], pii.log_redact)
    assert got[0] == "token = [REDACTED]" and got[1] == "mail [REDACTED_EMAIL]" and "1234" not in got[2] and "4111" not in got[3] and got[4] == "n [REDACTED_NUMBER] m"
    row = spark.sql("select map('api_key', 'x', 'note', 'a@b.org') m").select(pii.redact_mapping(F.col("m"))).first()[0]
    assert row == {"api_key": "[REDACTED]", "note": "[REDACTED_EMAIL]"}


PERFORMANCE = [
    ("The expense ratio is 1.21%.", 0), ("The fund returned 18% in 3 years.", 1), ("The expense ratio is 1.21% and it returned 18% in 3 years.", 1), ("The NAV is Rs. 64.12.", 1), ("NAV: 25 Sep '26", 0),
    ("The benchmark is the NIFTY 50 Total Return Index.", 0), ("The Direct Growth option has a minimum of 100.", 0), ("Returns have been strong.", 1), ("12% is it.", 1), ("The benchmark rose and the fund earned 7%.", 1),
]


def test_both_screens(spark):
    texts = [t for t, _ in PERFORMANCE]
    assert [min(1, len(r)) for r in applied(spark, texts, screens.performance_violations)] == [n for _, n in PERFORMANCE]
    assert [min(1, len(r)) for r in applied(spark, texts[:4], screens.performance_leaks)] == [0, 1, 1, 1]
    assert applied(spark, ["You should buy", "It is plain", "Switch to it"], screens.advice_term) == ["should", None, "switch to"]
    assert [len(r) for r in applied(spark, ["You should go. It is fine.", "Nothing here"], screens.advice_leaks)] == [2, 0]


@pytest.fixture(scope="module")
def drafts(spark):
    c = [{"fused_rank": 1, "chunk_id": "a", "source_url": "https://x.org/1", "text": "The load is 1% for 500 units."}, {"fused_rank": 2, "chunk_id": "b", "source_url": "https://x.org/2", "text": "Minimum is 100."}]
    rows = [
        (0, "The minimum is 100 [S2].", c), (1, "The load is 1%. See https://x.org/2.", c), (2, "The load is 1%. See https://evil.org/9.", c), (3, "You should buy.", c), (4, "It returned 9% in 3 years.", c),
        (5, "The minimum is 777.", c), (6, "A load is 1%. B is it. C is it. D is it. E. F.", c), (7, "Anything.", []), (8, "Load 1% [S9].", c),
    ]
    return spark.createDataFrame(rows, "id int, draft string, candidates array<struct<fused_rank:int,chunk_id:string,source_url:string,text:string>>")


def test_validate(drafts):
    rows = {r.id: r for r in screens.validate(drafts).collect()}
    assert rows[0].source_url == "https://x.org/2" and rows[0].answer == "The minimum is 100."
    assert rows[1].source_url == "https://x.org/2" and "http" not in rows[1].answer
    assert rows[2].source_url == "https://x.org/1" and rows[2].notes == "links removed"
    assert [rows[i].reason for i in (3, 4, 5, 7)] == ["opinion", "performance", "not_in_corpus", "not_in_corpus"] and rows[3].answer == screens.REFUSALS["opinion"]
    assert rows[6].answer.count(".") == 3 and "sentences trimmed" in rows[6].notes and rows[8].source_url == "https://x.org/1"


def test_grounding_variants(spark):
    row = spark.sql("select 'It is 5.' d, 'It is 500.' e").select(screens.ungrounded(F.col("d"), F.col("e")).alias("a"), screens.ungrounded_exact(F.col("d"), F.col("e")).alias("b")).first()
    assert len(row.a) == 0 and len(row.b) == 1


def test_bare_otp():
    cases = {"here 482913 ok": 1, "in 2013": 0, "goal is 500000": 0, "₹ 50000": 0, "ORD 50231": 0, "45000 % up": 0, "code 1234": 0, "x48291": 0}
    assert [len(pii.find_spans(t, bare=True)) for t in cases] == list(cases.values())
    assert pii.find_spans("here 482913 ok") == []


MORE_ROUTES = [
    ("How do I obtain the yearly statement of my holdings?", "factual", "statement_request"), ("Where can I see statements?", "factual", "statement_request"), ("How is the statement? Can I download it", "factual", "nav_statement"),
    ("On which documents are you trained?", "corpus_sources", "source_list"), ("Does this chatbot have other sources", "corpus_sources", "source_list"), ("how many pages, please?", "corpus_sources", "source_list"),
    ("Which schemes does it support?", "corpus_sources", "source_list"), ("your documents please", "corpus_sources", "source_list"), ("which funds hold gold", "factual", "default:unmatched"),
    ("how many funds does the fund manager have", "factual", "fund_manager"), ("What is the minimum of the schemes you list?", "factual", "minimum"), ("information about this mutual fund", "factual", "scheme_details"),
    ("fund full details", "factual", "scheme_details"), ("details of exit", "factual", "default:unmatched"), ("tax return and statement", "out_of_scope", "tax"), ("Is a term plan worth it", "out_of_scope", "insurance"),
]


def test_more_routes(spark):
    got = applied(spark, [q for q, _, _ in MORE_ROUTES], routing.explain)
    assert [(q, r.intent, r.rule) for (q, _, _), r in zip(MORE_ROUTES, got)] == MORE_ROUTES


def test_more_performance_claims(spark):
    cases = {"12.5% annualised": True, "10 % over a decade": True, "5% fee": False, "NAV price of units": True, "NAV?": False, "lowest return": True, "performance rating": False, "6 month lock-in": False, "7% for 2 yrs": True}
    assert dict(zip(cases, applied(spark, list(cases), routing.is_performance_claim))) == cases


def test_more_screens(spark):
    cases = {
        "NAV of Rs. 64 on 5 March 2024": [], "NAV of 64.1 units": ["NAV value"], "NAV was 12 in 2024.": [], "It is up 3.5% since launch": ["period-attached figure"], "Rs. 500 is the minimum; it is due": [],
        "The fee is 1% while gains came": ["return language without a fee"], "Version 1.2.3: nothing": [],
    }
    assert dict(zip(cases, applied(spark, list(cases), screens.performance_violations))) == cases
    leaks = {"It made 12% per annum": ["period-attached figure"], "NAV as on Friday is Rs. 64": ["NAV value"], "(up 3%). The fee fell": ["unattributed percentage"], "It earned well but the fee is low": ["return language without a figure"]}
    assert dict(zip(leaks, applied(spark, list(leaks), screens.performance_leaks))) == leaks
    advice = {"This is a better pick": 1, "it is worth investing in": 1, "consider adding units": 1, "I would  recommend it": 1, "It is a good fund house": 0, "we go for it": 1}
    assert {t: min(1, n) for t, n in zip(advice, map(len, applied(spark, list(advice), screens.advice_leaks)))} == {**advice, "It is a good fund house": 1}


def test_more_personal_data():
    cases = {
        "acct number: 987654321": ["account"], "account no 98765432": [], "one-time password is 4821": ["otp"], "verification code: 99001": ["otp"], "pin code 560001": [], "A/C #123456789": ["account"],
        "accounts 123456789": [], "passcode was 1234567": [], "otp482913": [],
    }
    assert {t: [k for _, _, k in pii.find_spans(t)] for t in cases} == cases


def test_policy_and_both_log_layers(spark):
    row = spark.sql("select true t, false f").select(*(pii.policy(F.col(c), **k).alias(f"{c}{i}") for c in "tf" for i, k in enumerate(({}, {"dry_run": True}, {"block": False})))).first()
    assert tuple(row) == ("block", "mark", "pass", "pass", "pass", "pass")
    assert applied(spark, ["otp is 482913 for x@y.org", None], pii.log_safe) == ["otp is [REDACTED_OTP] for [REDACTED_EMAIL]", None]


def test_evidence_and_drafts(spark):
    rows = spark.createDataFrame([(0, "a", 1, "s1", "x" * 20), (0, "b", 2, "s2", "y" * 30), (0, "c", 3, "s3", "z")], "qid long, chunk_id string, fused_rank int, source string, text string")
    header = len("[S1] s1\n")
    assert [(r.chunk_id, r.total) for r in answers.evidence(rows, 2 * header + 51).collect()] == [("a", header + 20)]
    kept = answers.evidence(rows, 2 * header + 52)
    assert [r.chunk_id for r in kept.orderBy("fused_rank").collect()] == ["a", "b"]
    user = answers.messages(spark.createDataFrame([(0, "Q?"), (1, "R?")], "qid long, question string"), kept).orderBy("qid").collect()
    assert user[0].user == "[S1] s1\n" + "x" * 20 + "\n\n[S2] s2\n" + "y" * 30 + "\n\nQuestion: Q?" and user[1].user == "\n\nQuestion: R?"
    asked = spark.createDataFrame([(0, "Q?", [{"text": "It is Rs. 5. More."}]), (1, "R?", [])], "qid long, question string, candidates array<struct<text:string>>")
    assert [r.draft for r in answers.drafts(asked).orderBy("qid").collect()] == ["It is Rs. 5 [S1].", ""]
    assert [r.draft for r in answers.drafts(asked, lambda q, c: f"{q}{len(c)}").orderBy("qid").collect()] == ["Q?1", "R?0"]
    assert list(answers.stream_draft("a b  c")) == ["a", " b", "  c"]


def test_observe(spark):
    asked = spark.createDataFrame([(0, "What is the exit load?", True, ["1%", "zz"]), (1, "Should I buy?", False, [])], "qid long, question string, answerable boolean, facts array<string>")
    dense = spark.createDataFrame([(0, 0.4), (0, 0.9)], "qid long, dense_score double")
    candidates = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "qid long, chunk_id string, fused_rank int")
    texts = spark.createDataFrame([("a", "p", "It is 1%"), ("b", "q", "x")], "chunk_id string, page_id string, text string")
    rows = {r.qid: r for r in evaluation.observe(asked, dense, candidates, texts).collect()}
    assert (rows[0].raw_dense_max, rows[0].gate_routed, rows[0].facts_in_context, rows[0].missing_facts, rows[0].page_ids) == (0.9, True, False, ["zz"], ["p", "q"])
    assert (rows[1].raw_dense_max, rows[1].gate_routed, rows[1].facts_in_context, rows[1].page_ids) == (-1.0, False, True, [])


def test_judge_prompt(spark):
    row = evaluation.judge_prompts(spark.createDataFrame([(1, "Q", ["f", "g"], "A", "E")], "id int, question string, facts array<string>, answer string, evidence string")).first()
    assert row.user == "Question: Q\n\nExpected facts: f; g\n\nAnswer: A\n\nEvidence: E" and "JSON" in row.system


def test_spans_of_both_kinds_agree(spark):
    """The expression against the plain detector, on texts put together from what may go wrong."""
    import random

    rng = random.Random(4)
    parts = ["a.b@x.org", "x@y", "ABCPE1234F", "ABCXE1234F", "2345 6789 0124", "234567890124", "otp is 482913", "pin: 4821", "a/c no: 123456789012", "123456789012345", "12,345", "+91 98765 43210", "098765-43210",
             "9876543210", "1.5", "é", "中文", "\x01", "code", "(", "1234", "order 1234567890123", "account 987654321", "2026-01-01", "_", ""]
    texts = [rng.choice(["", " ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.spans(F.col("text")).alias("s")).collect()
    assert all([tuple(s) for s in r.s] == pii.find_spans(texts[r.i].replace("\x01", "\x02")) for r in rows) and sum(len(r.s) for r in rows) > 300


def test_log_runs(spark):
    cases = {
        "4111 1111 1111 1111": "[REDACTED_CARD]", "2345 6789 0124": "[REDACTED_AADHAAR]", "call 98765-43210 or +91 9876543210": "call [REDACTED_PHONE] or +[REDACTED_PHONE]", "acct no: 123456789": "acct no: [REDACTED_ACCOUNT]",
        "pin 4821 and 4821": "pin [REDACTED_OTP] and 4821", "SBIN0001234": "[REDACTED_IFSC]", "12 3 4": "12 3 4", "v1.123456789": "v1.123456789", "a1234567890": "a1234567890", "": "",
    }
    assert dict(zip(cases, applied(spark, list(cases), pii.log_redact))) == cases
