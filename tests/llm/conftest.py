"""Documents with every oddity the operators have to bear."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " n_words string, KEPT int, tilings double, `a.b` int"
)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts with shared passages, copies, near copies, repeats, odd spaces and long words."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 90, 5000))
    base = [" ".join(words(rng, rng.randrange(1, 260), 5000)) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        kind = i % 10
        if kind == 1:
            t = t + "\n" + passage + "\n" + " ".join(words(rng, 20))
        elif kind == 2:
            t = base[i - 1]
        elif kind == 3:
            t = (t + "  \t") * 4
        elif kind == 4:
            t = base[i - 4].replace(" ", "  ", 1) + " é日本 ☃"
        elif kind == 5:
            t = "a" * rng.randrange(900, 1300) + " " + t
        elif kind == 6:
            t = passage.upper()
        elif kind == 7:
            t = "\n".join([t[:40]] * 5) + "\r\n#$%"
        out.append(t)
    return out


def odd_rows():
    texts = corpus()
    rows = [(i, t, "en", f"src{i % 3}", len(t), "x", i, 0.5, i) for i, t in enumerate(texts)]
    rows += [
        (1000, None, None, None, None, None, None, None, None),
        (1001, "", "de", "src0", 0, "x", 1, 1.0, 1),
        (1002, " \n\t ", "de", "src0", 4, "x", 1, 1.0, 1),
        (None, texts[1], None, None, None, None, None, None, None),
        (None, texts[1], None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
    ]
    rows += [rows[1], rows[1], rows[11]]  # repeated rows
    rows.append((1003, " ".join(words(random.Random(9), 30_000, 50_000)), "en", "src1", 1, "x", 1, 1.0, 1))
    rows.append((1004, "x" * 300_000, "en", "src1", 1, "x", 1, 1.0, 1))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
