import random

import pytest

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()
#: Extra columns with names that operators use themselves.
CLASHES = "shard string, slot string, n_words string, kept string, fp string, bin string, anchor string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "yo"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, blanks, odd white space, nulls and one very long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    near = base[3].split()
    near[7:8] = ["edited"]
    passage = prose(rng, 60)
    out = [*base, base[3], base[3], " ".join(near), base[1] + "\n" + passage, passage + " " + base[2], "", None, "   ", "one", "One", "Und " * 500, "!!! ### " * 30, "a\tb\x0bc\x0cd\r\ne f g", "世界 é " * 60, "line one here\nline one here\n\nline two", None, ""]
    return [*out, prose(rng, 20_000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "s", "s", "w", "k", "f", "b", "a", ["en", "de", None][i % 3], "src", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASHES}").repartition(5).cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, "null id text of some words here"), (None, None), (7, "seven words are in this text now"), (7, "seven words are in this text now"), (7, "another text with the same id"), (8, None), (8, ""), (None, "null id text of some words here")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
