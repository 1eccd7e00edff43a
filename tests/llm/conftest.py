import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with columns
    whose names clash with what the operators use inside."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None, 1, "x", 0) for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", size int, key string, label int").repartition(partitions)

    return build


@pytest.fixture
def prose():
    """Seeded invented prose."""

    def make(seed, words, vocabulary=400):
        r = random.Random(seed)
        names = ["".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
        return " ".join(r.choice(names) + ("." if r.random() < 0.1 else "") for _ in range(words))

    return make
