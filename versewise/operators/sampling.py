"""Seeded order, pool cut, per-artist cap, stop-after-N and exact stratified
splits (O1, O2, W3, W4, W6, A3).

Nothing here sorts a whole table in one task or collects rows to the
driver: totals orders use ``orderBy().limit()`` (per-task top-k, then a
merge), the per-artist cap becomes a WindowGroupLimit that trims each map
task before the shuffle, and the exact split ranks rows through a bucketed
histogram so that even a class holding a third of the rows is ranked in
parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(id_col, seed: int) -> Column:
    """O1: a stable pseudo-random order key, md5(id|seed) as hex."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def seeded_pool(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """O1 + O2: the first n rows of a seeded shuffle, with their 1-based pool
    position (TakeOrderedAndProject: top-n per task, merged on the driver;
    n is the pool size asked for, bounded by the caller)."""
    h = seeded_hash(id_col, seed)
    top = df.withColumn("_h", h).orderBy("_h", id_col).limit(n)
    w = Window.orderBy("_h", id_col)  # over at most n rows
    return top.withColumn("pool_pos", F.row_number().over(w)).drop("_h")


def cap_per_key(df: DataFrame, key: Column, order_col: str, k: int) -> DataFrame:
    """At most k rows per key in order (row_number <= k is planned as a
    WindowGroupLimit, so a hot key ships at most k rows per map task)."""
    w = Window.partitionBy(key).orderBy(order_col)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def accept_until(df: DataFrame, accept: Column, artist_col: str, pos_col: str,
                 count: int, max_per_artist: int) -> DataFrame:
    """W3 + W4: rows that pass ``accept``, at most ``max_per_artist`` per
    lower-cased artist in pool order, then the first ``count`` of them."""
    ok = df.filter(accept)
    capped = cap_per_key(ok, F.lower(F.col(artist_col)), pos_col, max_per_artist)
    return capped.orderBy(pos_col).limit(count)


def discover_summary(pool: DataFrame, accepted: DataFrame, pos_col: str, count: int) -> DataFrame:
    """A11 from W4: scanned = position of the count-th acceptance (else the
    pool size); skipped = scanned - accepted; unique artists accepted."""
    p = pool.agg(F.count(F.lit(1)).alias("pool_size"))
    a = accepted.agg(F.count(F.lit(1)).alias("tracks_saved"), F.max(pos_col).alias("_last"),
                     F.countDistinct(F.lower(F.col("artist"))).alias("unique_artists"))
    both = p.select("pool_size", F.lit(None).cast("bigint").alias("tracks_saved"),
                    F.lit(None).cast("int").alias("_last"), F.lit(None).cast("bigint").alias("unique_artists")) \
        .unionByName(a.select(F.lit(None).cast("bigint").alias("pool_size"), "tracks_saved",
                              F.col("_last").cast("int").alias("_last"), "unique_artists"))
    s = both.agg(F.max("pool_size").alias("pool_size"), F.max("tracks_saved").alias("tracks_saved"),
                 F.max("_last").alias("_last"), F.max("unique_artists").alias("unique_artists"))
    scanned = F.when(F.col("tracks_saved") >= count, F.col("_last").cast("bigint")).otherwise(F.col("pool_size"))
    return s.select(F.col("tracks_saved"), F.lit(count).cast("bigint").alias("target"),
                    scanned.alias("candidates_scanned"), "pool_size",
                    (scanned - F.col("tracks_saved")).alias("skipped"), "unique_artists")


def class_counts(df: DataFrame, label_col: str) -> DataFrame:
    """A3: rows per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


#: Broadcasts of one row a class are made up to so many classes; beyond, the
#: cuts are joined like any table.
MAX_BROADCAST_CLASSES = 10_000


def class_quotas(counts: DataFrame, test_n) -> DataFrame:
    """Largest-remainder test quota ``_q`` of each class (``_s``, ``n``): the
    floor of its share, and one more for the largest remainders (ties by class
    name, NULL first) until ``test_n`` rows are given out. One row a class."""
    every = Window.partitionBy()
    whole = F.col("n") * test_n
    d = counts.withColumn("_total", F.sum("n").over(every))
    d = d.withColumns({"_base": F.floor(whole / F.col("_total")), "_rem": whole % F.col("_total")})
    extra = F.lit(test_n) - F.sum("_base").over(every)
    rank = F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.coalesce("_s", F.lit("")), F.col("_s").isNotNull()))
    return d.select("_s", (F.col("_base") + F.when(rank <= extra, 1).otherwise(0)).alias("_q"))


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_n: int | None = None,
                     test_pct: int | None = None, seed: int = 42, buckets_hex: int = 5) -> DataFrame:
    """Exact-size split with a ``split`` column (train / test).

    Stratified by ``label_col`` (NULL is a class of its own) when every class
    has >= 2 rows and the test part can hold one row per class; else one
    stratum. Each class puts its ``quota`` rows with the smallest md5(id|seed)
    into the test part.

    Rows are counted per (class, hash bucket) -- 16^buckets_hex buckets, a
    bounded table -- the cumulative counts locate the bucket holding a class's
    cut, and only rows of that one bucket are ranked. That gives one cut, (hash,
    id), per class; every row is then told apart by comparison with its class's
    cut, so wide rows are read once and never shuffled (ids must be unique).
    """
    key = F.col(label_col).cast("string")
    h = seeded_hash(id_col, seed)
    bucket = F.conv(F.substring("_h", 1, buckets_hex), 16, 10).cast("long")
    narrow = df.select(key.alias("_s"), F.col(id_col).alias("_id"), h.alias("_h")).withColumn("_b", bucket)
    hist = narrow.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = hist.groupBy("_s").agg(F.sum("_c").alias("n"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    total, classes = size["total"], size["classes"]
    if test_n is None:
        test_n = (total * test_pct + 99) // 100
    if test_n < 0 or test_n > total:
        raise ValueError(f"test size {test_n} does not fit {total} rows")
    if not (classes and size["least"] >= 2 and test_n >= classes):
        key, classes = F.lit("_all"), 1
        narrow = narrow.withColumn("_s", key)
        hist = hist.groupBy(key.alias("_s"), "_b").agg(F.sum("_c").alias("_c"))
        counts = hist.groupBy("_s").agg(F.sum("_c").alias("n"))
    quotas = class_quotas(counts, test_n)
    small = F.broadcast if classes <= MAX_BROADCAST_CLASSES else (lambda d: d)

    run = Window.partitionBy("_s").orderBy("_b")
    edge = (hist.withColumn("_upto", F.sum("_c").over(run)).alias("h")
            .join(small(quotas).alias("q"), F.col("h._s").eqNullSafe(F.col("q._s")))
            .where((F.col("_q") > 0) & (F.col("_upto") >= F.col("_q")) & (F.col("_upto") - F.col("_c") < F.col("_q")))
            .select(F.col("h._s").alias("_es"), F.col("_b").alias("_eb"), (F.col("_q") - F.col("_upto") + F.col("_c")).alias("_take")))
    # one bucket per class is cut inside: only its rows are ranked
    inside = narrow.join(small(edge), F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_b") == F.col("_eb")))
    ranked = inside.withColumn("_rk", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_id")))
    cut = ranked.where("_rk = _take").select(F.col("_s").alias("_cs"), F.struct("_h", "_id").alias("_cut"))
    out = df.withColumn("_s", key).join(small(cut), F.col("_s").eqNullSafe(F.col("_cs")), "left")
    test = F.struct(h.alias("_h"), F.col(id_col).alias("_id")) <= F.col("_cut")
    return out.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")
