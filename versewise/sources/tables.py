"""Reading the parquet tables and shaping them into song-shaped stand-ins.

Each stand-in is a projection of a driver table (no rows added or dropped);
see FIXTURES.md for the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the
    scan, whose splits the session's ``spark.sql.files`` settings decide."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def songs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as songs: id, lyrics, artist (source), market (lang)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("lyrics"),
                    F.col("source").alias("artist"), F.col("lang").alias("market"), "n_chars")


def mood_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (valence, energy) truth and predictions.

    valence = l_discount * 10, energy = l_quantity / 50,
    predicted valence = l_tax / 0.08, predicted energy = l_discount * 10.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     (F.col("l_discount") * 10).alias("valence"),
                     (F.col("l_quantity") / 50).alias("energy"),
                     (F.col("l_tax") / 0.08).alias("pred_valence"),
                     (F.col("l_discount") * 10).alias("pred_energy"))


def catalog_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the audio-feature catalog."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("track_id"),
                    F.col("p_name").alias("track_name"), F.col("p_brand").alias("track_artist"),
                    F.col("p_type").alias("track_album_name"),
                    ((F.col("p_retailprice") - 900) / 100).alias("valence"),
                    (F.col("p_size") / 50).alias("energy"),
                    (F.col("p_size") * 4.0).alias("tempo"))
