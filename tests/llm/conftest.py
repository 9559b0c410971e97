import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "ve", "ru") for b in ("n", "s", "rt", "l") for c in ("a", "e", "io", "u", "y")]


@pytest.fixture
def prose():
    """prose(seed, n): n random words."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def edited():
    """edited(text, seed, n): text with n words replaced."""

    def make(text, seed, n):
        rng, words = random.Random(seed), text.split(" ")
        for i in rng.sample(range(len(words)), n):
            words[i] = f"edit{rng.randrange(10**6)}"
        return " ".join(words)

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents([(doc_id, text)]): a table of documents, with columns of names that operators use inside."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCUMENTS)
        if clash:
            for c in ("ids", "key", "score", "component", "part", "w", "h", "_key", "rep", "n", "class", "_cut", "at", "t", "rank", "begin", "first", "place", "_row", "_text", "id", "row", "_cut_doc", "_cut_at"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
