import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, id long, bucket long, body string, y int, part int, row long, key long, c0 string, twin long"


def edge_rows():
    """Nulls in any column, empty and very long texts, repeated rows, ties, text of odd characters."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(prose(40) for _ in range(700))
    base = prose(120)
    texts = [None, "", " \t\n", long, long, base, base.replace(words[3], "zz", 1), base + " tail", "Ünïcödé ▁ ﬁ 漢字 🧿 \x00 <s>", "a", "| # | $ " * 30, "same " * 200, "x\n\nx\n \nX", prose(15)]
    out = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts, 1)]
    out += [out[5], out[5], (None, base, "en", "a", 5), (None, None, None, None, None), (60, base, "de", None, None)]
    return [r + (1, 2, 3, "b", 1, 0, 7, 8, "c", None) for r in out]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
