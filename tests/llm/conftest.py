import random

import pytest

WORDS = "the of and river stone idiot cloud garden winter machine paper light north copper window salt ember field marble thread".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out string, id long, node long, rank int, score double, of string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "er", "ing", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages and lines, edge cases; (id, text) with a repeated row and null ids."""
    rng = random.Random(4)
    passage, line = prose(rng, 60), "A Line that MANY share"
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    long = prose(rng, 150).split()
    for i in range(12):
        near = list(long)
        for _ in range(i):
            near[rng.randrange(150)] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(300 + i, f"{prose(rng, 20)}\n{line}\n{passage}\n  {line.upper()} \t\n{prose(rng, 5)}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t\r\n"), (403, "x"), (404, "two words"), (405, "é É ß ﷺ 😀 naïve K İ"), (406, "a" * 30_000), (407, prose(rng, 20_000)), (408, "=" * 3000 + "\n" * 50)]
    rows += [(0, rows[0][1]), (None, prose(rng, 30)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z", 7, 7, 7, 0.5, "q") for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
