import random

import pytest

#: Columns of documents, and some whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, tokens array<string>, kept string"


@pytest.fixture(scope="session")
def make(spark):
    """(doc_id, text[, lang]) rows as a documents table with columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", "y", ["z"], "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words that look like a text; equal seeds give equal words."""
    stems = "the of and to in is that it for was river stone window garden letter seven quiet market yellow running under people".split()

    def words(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ed", "ing", str(rng.randrange(9))]) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def odd(prose):
    """Rows every operator must take: null and empty texts, null ids, repeated rows, white space, one very long text."""
    long = prose(99, 40_000)
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "word"), (4, "word"), (None, None), (None, "no id here"), (5, long), (6, "ünï çödé 😀 " * 30),
            (7, "\x00 zero \x1c and \xa0 spaces"), (8, prose(1, 120)), (9, prose(1, 120))]
