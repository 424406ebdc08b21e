"""Evaluation tables and run counters.

Each metric is one aggregation pass with partial aggregation; class-level
tables are built from the (truth, prediction) count table, whose size is
bounded by classes^2, never by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.schema import VIBES


def quality_counters(df: DataFrame, music: Column, usable: Column | None = None) -> DataFrame:
    """A1: rows, rows with usable lyrics, rows with music data, in one pass."""
    usable = X.has_usable_lyrics("lyrics") if usable is None else usable
    return df.agg(F.count(F.lit(1)).alias("input_rows"),
                  F.count_if(usable).alias("rows_with_lyrics"),
                  F.count_if(music).alias("rows_with_music_data"))


def regression_metrics(df: DataFrame, truth: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """A4: n, MAE and R^2 (1 - SSE / SST with SST = n * var_pop(truth)) in one
    pass; R^2 is NULL when the truth is constant."""
    err = F.col(truth) - F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(err)).alias("mae"),
            (F.lit(1.0) - F.sum(err * err) / F.nullif(F.var_pop(truth) * F.count(F.lit(1)), F.lit(0.0))).alias("r2")]
    return df.groupBy(*(group or [])).agg(*aggs)


def accuracy(df: DataFrame, truth: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """A5."""
    return df.groupBy(*(group or [])).agg(
        F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts per (truth, prediction); classes^2 rows at most."""
    return df.groupBy(F.col(truth).alias("actual"), F.col(pred).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class (classes = union of
    truth and prediction; zero division -> 0), then accuracy, macro avg and
    weighted avg rows (``label`` column; the accuracy row carries it in f1)."""
    pc = pair_counts(df, truth, pred)
    # each (actual, predicted) count feeds two classes: one aggregation over
    # both roles, no joins between re-derived copies of the pair table
    roles = pc.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_n"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted_n"), F.lit(0).cast("long").alias("tp")))))
    per = roles.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n"),
                                     F.sum("tp").alias("tp"))
    p = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": p, "recall": r})
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") /
                                      (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    per = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"),
                     F.col("tp").cast("long").alias("tp"))
    total = F.sum("support")
    summary = per.agg(
        (F.sum("tp") / total).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("wf"),
        total.cast("long").alias("n"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")))
    tail = summary.select(F.inline(rows))
    return per.drop("tp").unionByName(tail)


def confusion(df: DataFrame, truth: str, pred: str, labels=VIBES) -> DataFrame:
    """rows = actual, columns = predicted, over the taxonomy (pivot values
    given, so no extra pass to find them), then ``other``: predictions outside
    it, so that each row's cells sum to its rows. ``actual_pos`` is the
    taxonomy order (O4), unknown classes last."""
    pc = pair_counts(df, truth, pred)
    named = F.when(F.col("predicted").isin(*labels), F.col("predicted")).otherwise(F.lit("other"))
    wide = pc.withColumn("predicted", named).groupBy("actual").pivot("predicted", [*labels, "other"]).agg(F.sum("n"))
    wide = wide.fillna(0, [*labels, "other"])
    return wide.withColumn("actual_pos", L.vibe_index("actual")).select(
        "actual", "actual_pos", *[F.col(c).cast("long").alias(c) for c in [*labels, "other"]])


def mood_histogram(df: DataFrame, v: str, e: str, bins: int = 10) -> DataFrame:
    """A10: 2-D histogram of (valence, energy) on a bins x bins grid, so the
    chart data stays bounded however many rows there are."""
    bv = F.least(F.floor(F.col(v) * bins), F.lit(bins - 1)).cast("int")
    be = F.least(F.floor(F.col(e) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bv.alias("v_bin"), be.alias("e_bin")).agg(F.count(F.lit(1)).alias("n"))


def actual_vs_predicted(df: DataFrame, truth: str, pred: str, group: list[str], bins: int = 10) -> DataFrame:
    """A10: actual-against-predicted points counted on a bins x bins grid."""
    def cell(c):
        return F.greatest(F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(*group, cell(truth).alias("actual_bin"), cell(pred).alias("predicted_bin")).agg(F.count(F.lit(1)).alias("n"))
