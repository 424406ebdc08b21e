"""From raw documents to packed sequences, by five of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet in the shared folder and read again as the next one's ``docs``. All but
the last return the columns of ``documents``; columns beyond those are dropped.

Nulls, empty texts, repeats: each stage treats them as its operator says. An
empty text scores the share of good labels; rows that repeat a document are one
to the near-dedup; documents without a word aren't taken by the mix; an empty
table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewise.llm import language, mixing, near_dups, packing, quality_knn, repeats
from versewise.llm.common import DOC_COLUMNS, documents, stage

#: Documents that score less go.
LEAST_QUALITY = 0.3
#: Passages of so many bytes that stand elsewhere are cut: 50 words are rarely
#: fewer (51 successive words of the test corpora are 245 bytes or more, 317 in the median).
PASSAGE_BYTES = 240


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*DOC_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (9) accepts. It is learnt from the
    labelled rows of ``docs`` whose crc32 modulo 5 isn't 0."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    docs = _columns(docs)
    model = quality_knn.fit(docs, labels, ~language.held_out(5, 0))
    return quality_knn.accepted(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (3): the smallest id."""
    return near_dups.kept(_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``PASSAGE_BYTES`` or more that stand
    elsewhere (7); ``n_chars`` follows the text."""
    cut = repeats.without_repeats(_columns(docs), length=PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix (8) takes it: not at all, once or twice."""
    return mixing.mixed(_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 1024 tokens (4)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing", mixture), ("best-fit packing", packed)]

#: A classifier, MinHash and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage-{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
