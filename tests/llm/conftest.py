import random

import pytest

#: Columns that the operators use inside; tables that already have them must do no harm.
CLASHES = ["digest", "fp", "h", "spans", "size", "shard", "score", "pid", "idx", "row", "lang", "block", "h1", "doc", "e", "term", "words", "__digest", "__group", "__t", "__spans", "of_id", "found", "t", "place", "component", "y"]
SCHEMA = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def make(spark):
    def of(rows):
        return spark.createDataFrame([(i, t, "s", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows], SCHEMA).repartition(3)

    return of


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeghiklmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    return lambda n, seed: [random.Random(seed).choice(vocabulary) for _ in range(1)] + random.Random(seed + 1).choices(vocabulary, k=max(0, n - 1))


@pytest.fixture(scope="session")
def odd(words):
    """Null, empty, blank, one word, non-ASCII, repeated rows, a very long text, a null id, a long run of one sign."""
    long = " ".join(words(60_000, 9))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "ÄÖ é  \U0001f600 <turn x>\n\\b \\l"), (6, "same text here now ok"), (7, "same text here now ok"), (7, "same text here now ok"), (8, long), (None, "no id at all"), (9, "a" * 30_000), (10, "x=1\r\n\r\ny"), (11, "0" * 5000 + "@" + "b" * 5000 + ".c")]
