import random

import pytest

WORDS = "the of and to in on that is was for with as by from this be are it or an tion ing er re ly en st nd ha".split()


def text(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null, empty, blank, short, very long, repeated and near-equal texts."""
    rng = random.Random(5)
    base = text(rng, 120)
    near = base.split(" ")
    out = [
        (0, None, "s0"), (1, "", "s0"), (2, " \n\t ", None), (3, "One", "s1"), (4, "one", "s1"), (5, base, "s0"), (5, base, "s0"),
        (6, base.upper(), "s2"), (7, " ".join(["x1", *near[1:]]), "s2"), (8, " ".join([*near[:60], "y", *near[61:]]), "s0"),
        (9, text(rng, 9000), "s1"), (10, "a b " * 40, "s1"), (11, "é ñ ü ß Σας don't <|endoftext|> 12 !!", None), (None, base, "s0"),
        (12, "All rights reserved.\nLicensed under the Apache License, version 2.0.", "s0"),
    ]
    return out + [(20 + k, text(rng, rng.randint(1, 60)), f"s{k % 4}") for k in range(60)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.0, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size double, node string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
