import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lines string, t int, row string, at string, n int, key int, ids string, host string"


def words(n: int, seed: int, stock: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(stock)}x" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with everything that may go wrong: nulls, blanks, copies, near copies, ties, repeats, long ones."""
    base, shared = words(120, 1), words(60, 2)
    near = base.split()
    near[50] = "changed"
    block = "\n".join(words(6, 300 + i) for i in range(24))
    texts = [
        base, base, " ".join(near), words(30, 3) + "\n" + shared + "\n" + words(30, 4), words(25, 5) + " " + shared, None, "", "  \n\t ", "one", "one two", "One  TWO", "a b c", "é ñ 中文 😀 \x1c x\x85y",
        block, "x\n" + block + "\ny", "the the the the the the the the", words(20000, 6, 10**6), "it's a 'test' we'll see\n\n\n  end  ", "#$%&|<>*" * 10,
        " ".join(f"r{i}" for i in range(50)) + " " + " ".join(f"r{i}" for i in range(50)), "x" * 5000,
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t) if t is not None else None, "l", i, "r", "z", 1, 2, "i", "h") for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base, None, None, None, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
