import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, marks string"


def prose(rng, n, words="the of and stone river lantern quiet amber harbour winter paper signal velvet copper meadow".split()):
    return " ".join(rng.choice(words) + (rng.choice(["", "", "", ",", "."])) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, wordless, short, very long, repeated, near and partly copied texts; ids with gaps."""
    rng = random.Random(5)
    passage = prose(rng, 90, [f"w{k}" for k in range(400)])
    base = [prose(rng, rng.randint(1, 120), [f"v{k}" for k in range(300)]) for _ in range(14)]
    rows = [None, "", " \t\n", "a", "two words", "Ärger im Büro heute\x1fnicht"]
    rows += base + [base[0], base[0].upper(), base[1] + " tail", "x " * 700, "same line here\n" * 60]
    rows += [prose(rng, 30) + " " + passage + " " + prose(rng, 25), prose(rng, 5) + "\n" + passage, passage + " " + passage]
    rows += [" ".join(f"u{k}" for k in range(6000)), "é" * 900, "Licensed under CC BY-NC 4.0.\nbody text follows here", "🙂 emoji  double\n \n end "]
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, "k", "m") for d, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
