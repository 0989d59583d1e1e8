import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import chunking


def len_of(text):
    return len(chunking.TOKEN.findall(text))


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,wanted", [("Exit load 1.25% of ₹500", ["exit", "load", "1.25%", "of", "₹500"]), ("", []), ("a-b", ["a", "b"])])
def test_tokenize(spark, text, wanted):
    assert one(spark, text, T.tokenize) == wanted


@pytest.mark.parametrize("text,wanted", [("It is 1.21%. Next one.", ["It is 1.21%.", "Next one."]), ("Pay Rs. 500 now. Then go.", ["Pay Rs. 500 now.", "Then go."]), ("", []), ("no end", ["no end"])])
def test_sentences(spark, text, wanted):
    assert one(spark, text, T.sentences) == wanted == chunking.split_sentences(text)


@pytest.mark.parametrize("text,n", [("The ratio is 0.77%. The minimum is Rs. 100.", 2), ("", 0), ("One", 1), ("A. B? C!", 3), ("He said (x.) Then", 2)])
def test_count_sentences(spark, text, n):
    assert one(spark, text, T.count_sentences) == n


@pytest.mark.parametrize("token,wanted", [("1,13,606.47", "113606.47"), ("₹ 500", "500"), ("0.770", "0.77"), (".77", "0.77"), ("abc", ""), ("%", ""), ("12x", "12"), ("100", "100")])
def test_norm_number(spark, token, wanted):
    assert one(spark, token, T.norm_number) == wanted


def test_figures_skip_markers(spark):
    assert [f.strip() for f in one(spark, "It is 1.2% [S1] and ₹ 500 [s12].", T.figures)] == ["1.2%", "₹ 500"]


def test_strip_urls(spark):
    assert one(spark, "See https://x.org/a , ok https://y.org", T.strip_urls) == "See, ok"


def test_trim_sentences(spark):
    assert one(spark, "A. B. C. D. E. F", lambda c: T.trim_sentences(c, 3)) == "A. B. C."
    assert one(spark, "A. B.", lambda c: T.trim_sentences(c, 3)) == "A. B."


def test_ids(spark):
    row = spark.sql("select 'p' p, 0 o, 'x' t").select(T.chunk_id(F.col("p"), F.col("o")), T.question_ref(F.col("t"))).first()
    assert len(row[0]) == 32 and row[1].startswith("q_") and len(row[1]) == 14


def test_pack_keeps_budget_and_words():
    text = " ".join(f"Sentence {i} has some words in it." for i in range(60)) + " " + " ".join(f"w{i}" for i in range(400))
    for size, overlap in ((50, 10), (20, 5), (7, 0)):
        pieces = chunking.pack(text, size, overlap)
        assert all(len_of(p) <= size for p in pieces)
        assert [w for w in text.split() if w not in " ".join(pieces).split()] == []
    assert chunking.pack("", 10, 2) == []
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.checked(size, overlap)


def test_chunks(spark):
    df = spark.createDataFrame([("a", "One two. " * 40), ("b", None), ("c", "")], "page_id string, text string")
    rows = chunking.chunk_documents(df, 30, 5).collect()
    assert {r.page_id for r in rows} == {"a"} and all(r.token_count <= 30 for r in rows) and len({r.chunk_id for r in rows}) == len(rows)


@pytest.mark.parametrize("token", ["909955422195631329054", "9223372036854775807", "12345678901234567", "8796093022208.0078125", "1234567890123.4567895", "99999999999.9999996", "1" * 34, "0.0000005", "7"])
def test_norm_number_is_exact(spark, token):
    wanted = f"{float(token):.6f}"
    assert one(spark, token, T.norm_number) == wanted.rstrip("0").rstrip(".")


def test_figures_with_white_space(spark):
    assert one(spark, "to\n48 and 5\t% but\r7", T.figures) == ["\n48 ", " 5\t%", "\r7"]
    assert one(spark, "\n48 ", T.norm_number) == "48" and one(spark, "₹\t5\t%", T.norm_number) == "5"


@pytest.mark.parametrize("text,heavy", [("NAV today ₹ 64", True), ("+ 2.42 %", True), ("1% 2% 3%", True), ("Expense ratio 1.03% yield 1.10%", False), ("Return calculator", True), ("plain", False)])
def test_return_heavy(spark, text, heavy):
    assert one(spark, text, chunking.return_heavy) is heavy


def test_compose(spark):
    df = spark.createDataFrame([("s", "sec", "b"), ("s", " ", "b"), ("s", "b", "b"), ("s", None, "b")], "s string, c string, b string")
    assert [r[0] for r in df.select(chunking.compose(F.col("s"), F.col("c"), F.col("b"))).collect()] == ["s (sec) b", "s b", "s b", "s b"]


def test_word_windows(spark):
    assert one(spark, "a b c d e f g", lambda c: chunking.word_windows(c, 3, 1)) == ["a b c", "c d e", "e f g"]
    assert one(spark, " ", lambda c: chunking.word_windows(c, 3, 1)) == []


def test_word_windows_split_a_text_once(spark):
    """Not once for each window."""
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20000)),), (None,), ("",)], "t string").select(chunking.word_windows(F.col("t"), 50, 10).alias("w"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    long, *none = (r.w for r in df.collect())
    assert none == [[], []] and long == [" ".join(f"w{i}" for i in range(k, min(k + 50, 20000))) for k in range(0, 19990, 40)]


@pytest.mark.parametrize("size,overlap", [(20, 5), (20, 0), (7, 6), (1, 0), (50, 30)])
def test_packing_by_expression_and_by_hand_agree(spark, size, overlap):
    import random

    rng = random.Random(size)
    word = ["a", "b1", "c-d", "x.y", "é", "Rs.", "No.", "$5.0", "中文"]
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n "]).join(" ".join(rng.choice(word) for _ in range(rng.randrange(1, 60))).capitalize() + rng.choice([".", "!", "", "?"]) for _ in range(rng.randrange(9))) for _ in range(120)]
    texts += [None, "", " \n", "x " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunking.packed(F.col("text"), size, overlap).alias("p")).collect()
    assert all(r.p == (chunking.pack(texts[r.i], size, overlap) if texts[r.i] else []) for r in rows)
