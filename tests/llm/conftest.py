import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, fp string, score string, line string"


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long and odd texts, and near copies of one."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(120))
    out = [None, "", " \n\t ", "a", "don't", "x <|endoftext|> y", "É ü ß ñ 日本 \U0001f600 ́  ", base, base, base.replace("e", "E", 1), base + " end", base[:300]]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    out += ["\n".join(base if k == 3 else " ".join(rng.choice(words) for _ in range(12)) for k in range(6)), " ".join(rng.choice(words) for _ in range(9000)), "z" * 5000]
    return out


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    """Odd texts with columns whose names the operators use themselves; null and repeated ids."""
    rows = [(i, t, "en", "s", 0, 1, "x", "y", "z", "w") for i, t in enumerate(odd_texts)]
    rows += [(None, "no id", *rows[0][2:]), (None, None, *rows[0][2:]), rows[7], rows[1]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
