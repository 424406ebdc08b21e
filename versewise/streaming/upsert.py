"""Incremental ingest and scoring with Structured Streaming.

R1 replaces "rewrite the whole CSV every k rows" with a file-source stream.
The target table is hashed by key into buckets; a micro-batch reads and writes
the buckets its keys fall into and no others, keep-last-per-key (S7). The table
is a log of snapshots: a batch writes its buckets into a folder of its own, and
then a manifest (one small JSON file, bucket -> folder) put in place by a
rename. A reader resolves one manifest and sees exactly that version, whatever is
merged meanwhile; folders that none of the last ``RETAIN`` manifests names are
removed. A retried epoch finds its manifest there, or leaves an attempt's folder
that no manifest names. The checkpoint location makes the query resume where
it stopped after a lost executor or driver restart.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewise.operators.dedupe import keep_last


def _versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Committed epoch versions of a table directory (via the Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def read_latest(spark: SparkSession, table_dir: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest committed version, or None before the first commit."""
    vs = _versions(spark, table_dir)
    if not vs:
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{table_dir}/epoch={vs[-1]}")


#: Buckets of an upsert table (a table keeps the number it was made with); manifests kept.
BUCKETS, RETAIN = 64, 4


class SnapshotLog:
    """The manifests of an upsert table. One writer at a time (a streaming
    query); any number of readers."""

    def __init__(self, spark: SparkSession, table_dir: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self.dir = table_dir.rstrip("/")
        self.fs = self.path(self.dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.path(f"{self.dir}/{folder}")
        return [st.getPath().getName() for st in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def epochs(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def read(self, epoch: int) -> dict[int, str]:
        """Bucket -> its folder in the given version."""
        stream = self.fs.open(self.path(f"{self.dir}/manifests/{epoch}.json"))
        try:
            return {int(b): f for b, f in json.loads(self.io.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict[int, str]]:
        """The newest version's epoch (-1 before the first) and buckets."""
        have = self.epochs()
        return (have[-1], self.read(have[-1])) if have else (-1, {})

    def commit(self, epoch: int, buckets: dict[int, str]) -> None:
        part = self.path(f"{self.dir}/manifests/.{epoch}-{os.urandom(4).hex()}")
        out = self.fs.create(part)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        if not self.fs.rename(part, self.path(f"{self.dir}/manifests/{epoch}.json")):
            raise RuntimeError(f"version {epoch} of {self.dir} is there already")

    def written(self, folder: str) -> dict[int, str]:
        """The buckets that a batch wrote into its folder."""
        return {int(n.split("=", 1)[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def expire(self, retain: int) -> None:
        """Remove manifests but the last ``retain``, and folders that those
        left don't name and that no batch can be writing."""
        have = self.epochs()
        kept = have[-retain:]
        for e in have[:-retain]:
            self.fs.delete(self.path(f"{self.dir}/manifests/{e}.json"), False)
        named = {f for e in kept for f in self.read(e).values()}
        for folder in self._names("data"):
            if int(folder.split("-")[0]) <= have[-1]:
                buckets = self.written(f"data/{folder}").values()
                gone = [f for f in buckets if f not in named]
                for f in gone if len(gone) < len(buckets) else [f"data/{folder}"]:
                    self.fs.delete(self.path(f"{self.dir}/{f}"), True)


def _read_buckets(spark: SparkSession, table_dir: str, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table_dir.rstrip('/')}/{f}" for f in sorted(folders)])


def merge_batch(table_dir: str, keys: list[str], order_cols: list[str], buckets: int = BUCKETS, retain: int = RETAIN):
    """foreachBatch function: the batch and the buckets it touches -> keep last
    per key -> a version of the table in which those buckets are new."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        log = SnapshotLog(spark, table_dir)
        epoch, now = log.newest()
        if epoch >= epoch_id:  # a retried epoch that had been committed
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()] if now else []  # at most ``buckets`` numbers
        rows = batch
        old = [now[b] for b in touched if b in now]
        if old:
            rows = _read_buckets(spark, table_dir, old, batch.schema).unionByName(batch)
        merged = keep_last(rows, keys, order_cols).withColumn("bucket", bucket)
        folder = f"data/{epoch_id}-{os.urandom(4).hex()}"
        # a bucket's rows come together for its folder, a big bucket's in several files
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{table_dir.rstrip('/')}/{folder}")
        new = log.written(folder)
        if new:
            log.commit(epoch_id, now | new)
            log.expire(retain)
    return run


def read_upserted(spark: SparkSession, table_dir: str, schema: T.StructType, epoch: int | None = None) -> DataFrame:
    """The content of an upsert table: its newest version, or that of an epoch
    still retained."""
    log = SnapshotLog(spark, table_dir)
    return _read_buckets(spark, table_dir, list((log.newest()[1] if epoch is None else log.read(epoch)).values()), schema)


def stream_upsert(spark: SparkSession, source_dir: str, schema: T.StructType, keys: list[str],
                  order_cols: list[str], table_dir: str, checkpoint: str, bytes_per_trigger: int = 1 << 30,
                  buckets: int = BUCKETS) -> DataFrame:
    """Run the stream over every file present now (availableNow), in
    batches of about ``bytes_per_trigger``, and return the merged table."""
    src = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(source_dir)
    q = (src.writeStream.foreachBatch(merge_batch(table_dir, keys, order_cols, buckets))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_upserted(spark, table_dir, schema)


def stream_transform(spark: SparkSession, source_dir: str, schema: T.StructType, fn, sink_dir: str,
                     checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
    """R2: a stateless transformation (e.g. feature extraction and model
    scoring) applied to arriving files; results appended to a Parquet sink
    with exactly-once file commits."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    q = (fn(src).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_dir)
