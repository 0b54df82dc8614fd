import pytest


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, source, lang]) rows, with extra columns whose names clash with the operators' own."""

    def build(rows, extra=True):
        full = [(r[0], r[1], *(r[2:3] or ("s0",)), *(r[3:4] or ("en",)), 7, 8, "z") for r in rows]
        schema = "doc_id long, text string, source string, lang string, size long, n long, kind string"
        df = spark.createDataFrame(full, schema)
        return df if extra else df.drop("size", "n", "kind")

    return build


@pytest.fixture
def words():
    """A seeded text of ``n`` words."""
    import random

    def text(n, seed, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return text
