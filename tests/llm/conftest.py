import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta", "vi", "zo", "shi", "the") for b in ("n", "ra", "sto", "m", "lle", "d", "ping", "x")]


def prose(rnd, n, line=12):
    w = [rnd.choice(WORDS) + rnd.choice(["", "", "s", "r", "t"]) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]).capitalize() + "." for i in range(0, n, line))


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(10**6))
    return " ".join(w)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, draws string, kept string, key string, size string"


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, ties, nulls in every column, an empty and a very long text, and clashing extra columns."""
    rnd = random.Random(11)
    out = []
    for i in range(60):
        out.append(prose(rnd, rnd.randrange(60, 300)))
    base = prose(rnd, 250)
    out += [base] * 6 + [edited(rnd, base, 2) for _ in range(40)] + [edited(rnd, base, 25) for _ in range(10)]
    out += ["", " \n\t", "one", "two words", "Two  words", prose(rnd, 20_000, 40), "x" * 5000, "word %%% ### $$$ " * 40, "again and again " * 60]
    data = [[i, t, rnd.choice(["en", "fr"]), rnd.choice(["a", "b", "b", "b"]), len(t), "d", "k", "y", "z"] for i, t in enumerate(out)]
    data.append([len(data), None, "en", "a", None, None, None, None, None])
    data.append([len(data), out[3], None, None, None, None, None, None, None])
    data.append([None, out[4], "en", "a", None, None, None, None, None])
    data.append(list(data[5]))
    rnd.shuffle(data)
    return [tuple(r) for r in data]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
