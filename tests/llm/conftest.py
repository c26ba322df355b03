import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, md5 string, key int, sig int, score string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with further columns whose names the operators use themselves."""

    def made(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, "y") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return made


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, runs, nulls, empties and one very long text."""
    rng = random.Random(5)
    passage = words(rng, 120)
    base = [words(rng, rng.randint(1, 220)) for _ in range(40)]
    near = base[3].split()
    for _ in range(6):
        t = list(near)
        t[rng.randrange(len(t))] = "changed"
        base.append(" ".join(t))
    base += [base[0], base[0], base[1], "", "", None, None, "a" * 1500, "ab" * 700, "x " * 900, passage, f"{words(rng, 30)} {passage} {words(rng, 30)}", f"{words(rng, 9)} {passage}", "é" * 900, words(rng, 6000), "one two three", "One  two\nthree", "日本 語" * 150]
    return base
