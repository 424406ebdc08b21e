"""First/last-wins dedupe and keep-last upserts.

Keeping one row per key is written as ``min_by``/``max_by`` over a struct of
the row instead of ``row_number()`` over a window: the aggregate keeps one
candidate per key in each map task before the shuffle (partial aggregation),
so a key that holds a third of all rows sends one row per task over the network
instead of a third of the table into one sort. Rows as aggregation values make
it a sort aggregate: each task sorts its own rows by key before the partial and
before the final step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order_cols) -> Column:
    """Order value as a struct: never NULL itself, so ``min_by``/``max_by`` do
    not skip a row whose order field is NULL (NULL fields sort first)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return F.struct(*cols)


def keep_first(df: DataFrame, keys: list[str], order_cols: list) -> DataFrame:
    """The row with the smallest order value per key (input order must be
    explicit: Spark has no implicit row order)."""
    cols = df.columns
    return (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*cols), _order(order_cols)).alias("_row"))
              .select(*[F.col(f"_row.{c}").alias(c) for c in cols]))


def keep_last(df: DataFrame, keys: list[str], order_cols: list) -> DataFrame:
    """The row with the largest order value per key."""
    cols = df.columns
    return (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*cols), _order(order_cols)).alias("_row"))
              .select(*[F.col(f"_row.{c}").alias(c) for c in cols]))


def upsert_keep_last(old: DataFrame, new: DataFrame, keys: list[str], pos_col: str) -> DataFrame:
    """Union the stored rows with a new batch (columns may differ) and keep
    the last row per key, new batch after old, then by position."""
    both = (old.withColumn("_batch", F.lit(0))
               .unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True))
    out = keep_last(both, keys, ["_batch", pos_col])
    return out.drop("_batch")
