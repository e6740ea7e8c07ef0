import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use themselves, and one that differs by case alone.
CLASHES = ["__dq_id", "__dq_h", "__id", "__h", "__text", "__row", "keep_id", "Text", "piece", "length", "block", "slot", "toxicity", "a.b"]


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """docs from (doc_id, text) or (doc_id, text, source) rows; clash adds columns whose names clash."""
    from pyspark.sql import types as T

    def build(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        if clash:
            full = [(*r, *(f"{c}-{r[0]}" for c in CLASHES)) for r in full]
            fields += [T.StructField(c, T.StringType()) for c in CLASHES]
        return spark.createDataFrame(full, T.StructType(fields)).repartition(3)

    return build


@pytest.fixture
def rng():
    return random.Random(5)
