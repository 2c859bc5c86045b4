import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lines int, node string, content string"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}{rng.choice('abcdef')}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared lines and passages, and one long text."""
    rng = random.Random(5)
    base = ["\n".join(words(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    shared = "\n".join(words(rng, 30) for _ in range(5))
    out = list(base)
    for t in base[:12]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out += [t, " ".join(w)]
    out += [f"{words(rng, 25)}\n{words(rng, 9)}\n{shared}\n{words(rng, 12)}" for _ in range(8)]
    out.append(words(rng, 30_000, 5000))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with nulls in every column, empty and odd texts, repeated rows and columns that clash with inner names."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t), 0.5, 3, "n", "c") for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, None, None, None, None, None, None, None), (None, texts[0], "en", "s1", 1, 1.0, 1, "x", "y"), (None, None, None, None, None, None, None, None, None)]
    rows += [(n + 1, "", "en", "s1", 0, 0.0, 0, "", ""), (n + 2, "", "en", "s1", 0, 0.0, 0, "", ""), (n + 3, " \n\t  ", "en", "s2", 4, 0.0, 0, "", ""), (n + 4, "\n\n\n", "fr", "s2", 3, 0.0, 0, "", ""), (n + 5, "... !!! 123 \U0001f600", "fr", "s2", 3, 0.0, 0, "", "")]
    rows += [rows[3], rows[3], rows[20]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
