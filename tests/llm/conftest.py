import random

import pytest

#: Columns that operators use as names of their own.
CLASHES = ("id", "key", "kept", "line", "n", "pos", "score", "size", "taken", "text_a", "toxic", "keys", "sequence_id", "digest", "n_lines", "doc", "site", "quality")


def syllables(rng, n):
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ter", "an", "us")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Builds documents (doc_id, text[, source[, lang]]) with further columns named like those of the operators."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else "en", *["x"] * len(CLASHES)) for r in rows]
        schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null, empty, blank, very long and repeated texts, repeated rows, null sources and languages."""
    rng = random.Random(4)
    long = syllables(rng, 30_000)
    base = syllables(rng, 200)
    return [
        (1, base, "a", "en"), (2, base, "b", "de"), (2, base, "b", "de"), (3, base.upper(), None, None), (4, None, "a", "en"), (5, "", "a", None),
        (6, " \n\t ", "b", "fr"), (7, long, "a", "en"), (8, long + " tail", "c", "en"), (None, base, "a", "en"), (None, None, None, None), (9, "one", "c", "xx"),
        (10, "é ü\x1f \U0001f600 <|endoftext|>", "c", "en"), (11, base + "\n" + base, "a", "en"),
    ]
