"""Mixing sources to target weights (8) by hash thresholds.

Each document has a fixed hash. A histogram of words by source and hash bucket
finds the bucket in which a source's budget ends; only that bucket is counted
again by finer buckets. A document is taken if its hash is below the source's
threshold, so nothing is sorted, and a smaller budget's mix is part of a larger
one's.

Nulls, empty texts, repeats: a null or empty text has size 0 and is taken 0
times; the null source is a source, last in order; a null id hashes like an
empty one; rows that share an id, or its hash, are taken or left together; very
long texts are counted whole; extra columns, whatever their names, are not read
by ``mix``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewise.llm.common import WORD, pick, stage

WEIGHTS = (5, 2, 1)
#: Bits of the hash; of its buckets; of the buckets a boundary bucket is cut into.
HASH_BITS, COARSE_BITS, FINE_BITS = 48, 12, 12


def hashed(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words) and the hash, its first and second bucket."""
    return (pick(docs, doc_id=id_col, text=text_col, source=source_col)
            .select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                    hashed(F.col("doc_id")).alias("h"))
            .withColumn("coarse", F.shiftright("h", HASH_BITS - COARSE_BITS))
            .withColumn("fine", F.shiftright("h", HASH_BITS - COARSE_BITS - FINE_BITS)))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh
    ``weights`` in turn and share ``total_share`` of all words; a target stops
    at ``most_repeats`` times its source and the excess goes to the others by
    weight. With the caps in order of cap by weight, the level at which all
    uncapped sources stand is the first that the next cap doesn't undercut.
    One row a source here: the windows hold no documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    t = (sizes.withColumn("w", w).withColumn("cap", most_repeats * F.col("source_size"))
         .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
         .withColumn("budget", total_share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("level", F.col("budget") / F.col("rest")))
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")),
                     F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source"))).over(every)
    return t.withColumn("at", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("at") * F.col("w")).alias("target"))


def cuts(words: DataFrame, need: DataFrame, bucket: str, keys: list[str]) -> DataFrame:
    """The bucket in which the running sum of words passes what is needed, the
    sum before it and its own words."""
    run = Window.partitionBy(*keys).orderBy(bucket)
    return (words.withColumn("upto", F.sum("words").over(run)).alias("w")
            .join(need.alias("n"), [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
            .where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need")) & (F.col("words") > 0))
            .select(*[F.col(f"w.{k}").alias(k) for k in keys], bucket, "words",
                    (F.col("need") - (F.col("upto") - F.col("words"))).alias("over")))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, total_share: float = 1.5, most_repeats: int = 2) -> tuple[DataFrame, DataFrame]:
    """(documents with their sizes and hash buckets, sources with their target,
    whole repeats and the fine bucket below which a document is taken once more)."""
    d = stage(sized(docs, id_col, text_col, source_col), "mix-sizes")
    words = d.groupBy("source", "coarse").agg(F.sum("size").alias("words"))
    goal = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, most_repeats)
    # whole repeats first; what is left of the target is found by threshold
    goal = goal.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = stage(goal.withColumn("need", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-goals")
    edge = cuts(words, goal.select("source", "need"), "coarse", ["source"]).withColumnRenamed("over", "need")
    # only the boundary bucket of each source is counted by finer buckets
    inner = (d.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.coarse") == F.col("e.coarse")))
             .groupBy(F.col("d.source").alias("source"), F.col("d.fine").alias("fine")).agg(F.sum("size").alias("words")))
    fine = cuts(inner, edge.select("source", "need"), "fine", ["source"])
    # the last bucket is taken whole if that comes nearer to the target
    stop = fine.select("source", (F.col("fine") + F.when(2 * F.col("over") > F.col("words"), 1).otherwise(0)).alias("stop"))
    plan = (goal.alias("g").join(stop.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")), "left")
            .select(F.col("g.source").alias("source"), "source_size", "target", "repeats", F.coalesce("stop", F.lit(0)).alias("stop")))
    # one row a source: staged, so that its size is known and Spark broadcasts it below its threshold only
    return d, stage(plan, "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, total_share: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted)."""
    d, plan = taken(docs, id_col, text_col, source_col, weights, total_share, most_repeats)
    times = F.col("repeats") + F.when(F.col("fine") < F.col("stop"), 1).otherwise(0)
    return (d.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, total_share: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Size and hash are
    made again from the row, so texts are joined to the sources' thresholds
    only."""
    _, plan = taken(docs, id_col, text_col, source_col, weights, total_share, most_repeats)
    plan = plan.select(F.col("source").alias("_source"), F.col("repeats").alias("_repeats"), F.col("stop").alias("_stop"))
    fine = F.shiftright(hashed(F.col(f"`{id_col}`")), HASH_BITS - COARSE_BITS - FINE_BITS)
    times = F.when(F.coalesce(F.regexp_count(f"`{text_col}`", F.lit(WORD)), F.lit(0)) == 0, F.lit(0)) \
        .otherwise(F.col("_repeats") + F.when(fine < F.col("_stop"), 1).otherwise(0))
    rows = docs.join(plan, F.col(f"`{source_col}`").eqNullSafe(F.col("_source")))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[f"`{c}`" for c in docs.columns])


#: The same in SQL over a table ``documents``.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HASH_BITS // 4}))::BIGINT AS h FROM documents),
b AS (SELECT *, h >> {HASH_BITS - COARSE_BITS} AS coarse, h >> {HASH_BITS - COARSE_BITS - FINE_BITS} AS fine FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
a AS (SELECT level AS common FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, least(cap::DOUBLE, common * w) AS target FROM l, a),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM g),
m AS (SELECT *, target - repeats * source_size AS need FROM n),
c AS (SELECT source, coarse, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY coarse) AS upto FROM b GROUP BY source, coarse),
e AS (SELECT c.source, c.coarse, need - (upto - words) AS need FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source
      WHERE upto > need AND upto - words <= need AND words > 0),
f AS (SELECT b.source, fine, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY b.source ORDER BY fine) AS upto
      FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source AND b.coarse = e.coarse GROUP BY b.source, fine),
t AS (SELECT f.source, fine + CASE WHEN 2 * (need - (upto - words)) > words THEN 1 ELSE 0 END AS stop
      FROM f JOIN e ON f.source IS NOT DISTINCT FROM e.source
      WHERE upto > need AND upto - words <= need AND words > 0)
SELECT b.doc_id, b.size, m.source_size, m.target,
       (b.size * (m.repeats + CASE WHEN b.fine < coalesce(t.stop, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b JOIN m ON b.source IS NOT DISTINCT FROM m.source LEFT JOIN t ON m.source IS NOT DISTINCT FROM t.source
"""
