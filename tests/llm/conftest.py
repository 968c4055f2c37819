import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "ne", "sol", "mar", "vin") for b in ("la", "mo", "ster", "ing", "ta", "x", "pre", "q")]


@pytest.fixture(scope="session")
def make_text():
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with clashing extra columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "extra", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, h int")

    return make
