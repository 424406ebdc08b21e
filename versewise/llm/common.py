"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names and nothing else, so
    extra columns of the caller can't clash with those the operator adds."""
    return df.select(*[df[f"`{c}`"].alias(a) for a, c in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a higher-order function
    evaluates its lambda variable once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Keys that hold more than 1 / HOT of the rows, of which there are fewer than HOT, are joined by broadcast.
HOT = 1000


def join_counted(rows: DataFrame, sums: DataFrame, on: list[str], count: str, total: int, hot: int | None = None) -> DataFrame:
    """``rows`` joined with ``sums``, one row a key, in which ``count`` says how
    many of the ``total`` rows the key has. The few hot keys meet their rows where
    those are; the others are shuffled, and none of them makes a large part. Both
    are read twice: they should be staged. ``count`` is never null."""
    most = F.col(count) * (hot or HOT) > total
    near = rows.join(F.broadcast(sums.where(most)), on, "left")
    rest = near.where(F.col(count).isNull()).select(*rows.columns).join(sums.where(~most), on)
    return near.where(F.col(count).isNotNull()).unionByName(rest)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder named in spark.checkpoint.dir.
    Only a local master, as in tests, may leave that setting empty."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="versewise-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the
    lineage, and lost executors cost no recomputation beyond their tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that tasks write plain files to."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_once(uri: str, name: str, chunks) -> str:
    """Write a file so that a repeated or parallel attempt of the same task
    can't leave half a file: under another name first, then moved."""
    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    final, part = f"{base}/{name}", f"{base}/.{name}.{os.urandom(4).hex()}"
    with fs.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
    fs.move(part, final)
    return final


def zero_crc(doc_id) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
