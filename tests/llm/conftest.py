import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs, with null languages where not given."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}x" for _ in range(n))


ODD_TEXTS = [None, "", " ", "\n\n", "a", "é ß\t漢字 \x0b\x0c end", "x" * 5000, "a " * 3000, "#*$%&|<> ok\nline\nline\n\nline", "\x1c \x85\xa0  z", "AKIA", "ſecret: abcdefgh1"]


@pytest.fixture(scope="session")
def odd_rows():
    return [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, prose(i % 7, 60 + 10 * (i % 7))) for i in range(20)]
