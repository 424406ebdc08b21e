import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use themselves
                     T.StructField("key", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("h", T.StringType()),
                     T.StructField("words", T.StringType()), T.StructField("node", T.StringType()),
                     T.StructField("label", T.StringType()), T.StructField("a.b", T.StringType())])


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with clashing extra columns."""
    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = [*r, None, None][:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text or ""), *["x"] * 8))
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture()
def prose():
    """Seeded invented text of so many words."""
    import numpy as np

    def make(n, seed=0, vocab=400):
        r = np.random.default_rng(seed)
        parts = ["ta", "ri", "mo", "lek", "su", "vor", "ni", "pe", "dra", "shi"]
        words = ["".join(r.choice(parts, r.integers(1, 4))) for _ in range(vocab)]
        return " ".join(r.choice(words, n))
    return make
