import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def sentences(rng, n, size=9):
    return " ".join(words(rng, size).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text)."""

    def make(texts, extra=()):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOC)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("mine"))
        return df

    return make


@pytest.fixture()
def rng():
    return random.Random(7)
