"""Document fingerprints (1) [native]: winnowing over characters.

White space is left out, so its edits don't matter. A hash covers each run of
``K`` characters; of each window of ``WINDOW`` successive hashes the smallest is
kept, the rightmost of equals, with its position among the characters kept
(Schleimer, Wilkerson and Aiken 2003). Texts that share ``WINDOW + K - 1``
characters in a row, white space aside, share a fingerprint entry, wherever the
passage stands and with or without spaces. DataFrame functions only. Arrays are
read by index from lambda variables, so the work is linear in the text. The hash
of K characters is rolled up from those of pairs, which its neighbours share, and
the minimum of a window from those of three. The edited text's fingerprint is put
together from those of its two parts and of what crosses their seam.

Nulls, empty texts, repeats: a null or empty text has an empty fingerprint;
two empty ones are alike (1), an empty one and another aren't (0); a null id
comes last in descending order; rows that share an id are ordered by the hash
of their text and give a row each; of equal hashes in a window the rightmost
counts; very long texts are hashed whole; extra columns, whatever their names,
are not read; an empty table gives no rows. The next of a
single document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewise.llm.common import let, pick

#: LONGEST: characters of a unit.
K, WINDOW, LONGEST = 8, 8, 1
LOW = (1 << 31) - 1
#: Ranges of ids for each shuffle partition: several, so that tasks get like shares.
RANGES = 8


def without_space(text: Column) -> Column:
    return F.translate(text, " \t\n\v\f\r", "")


def characters(text: Column) -> Column:
    """All but ASCII white space."""
    return let(without_space(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "")))


def _spread(size: int, part: int) -> list[int]:
    """Offsets of parts that cover a stretch of the given size."""
    return [*range(0, size - part, part), size - part]


def _window_minima(ranks: Column, window: int) -> Column:
    """Minimum of each full window, or of the whole if it is shorter: of three
    first, then of those that cover the window. Beyond the end get() is null."""
    few = min(3, window)

    def least(a: Column, offsets: list[int], count: Column) -> Column:
        return F.transform(F.slice(a, 1, count), lambda x, i: F.least(x, *[F.get(a, i + d) for d in offsets[1:]])) if len(offsets) > 1 else F.slice(a, 1, count)

    full = F.size(ranks) - window + 1
    covered = let(least(ranks, list(range(few)), F.size(ranks)), lambda a: least(a, _spread(window, few), F.greatest(full, F.lit(1))))
    return F.when(full < 1, F.when(F.size(ranks) > 0, F.array(F.array_min(ranks))).otherwise(F.array().cast("array<bigint>"))).otherwise(covered)


def fingerprint(units: Column, k: int = K, window: int = WINDOW) -> Column:
    """struct<hash: array<bigint>, pos: array<int>>: the selected hashes and
    the positions of their first units, in text order."""
    pair = min(2, k)

    def hashed(pairs: Column, x: Column, i: Column) -> Column:
        # of k units from unit i on; what stands beyond the end is null and adds nothing
        return F.xxhash64(x, *[F.get(pairs, i + d) for d in _spread(k, pair)[1:]])

    def rank(h: Column, i: Column) -> Column:
        # a hash's low 31 bits over the inverted position: the least is the least hash, rightmost of equals
        return F.shiftleft(h.bitwiseAND(F.lit(LOW).cast("long")), 32) + (F.lit(LOW).cast("long") - i)

    def chosen(pairs: Column) -> Column:
        starts = F.slice(pairs, 1, F.greatest(F.size(pairs) - k + 1, F.least(F.size(pairs), F.lit(1))))
        ranks = F.transform(starts, lambda x, i: rank(hashed(pairs, x, i), i))
        low = let(ranks, lambda r: F.array_distinct(_window_minima(r, window)))
        pos = F.transform(low, lambda x: (F.lit(LOW).cast("long") - x.bitwiseAND(F.lit((1 << 32) - 1))).cast("int"))
        # ranks hold a part of the hash only: the whole one is made again for the few selected
        return let(pos, lambda p: F.struct(F.transform(p, lambda i: hashed(pairs, F.get(pairs, i), i)).alias("hash"), p.alias("pos")))

    return let(units, lambda w: let(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + 1)] * (pair - 1))), chosen))


def seamed(fp: Column, text: Column, fp_next: Column, text_next: Column) -> Column:
    """The fingerprint of ``text`` followed by ``text_next``, beginnings (white
    space left out, ``K + WINDOW - 1`` characters at least) of two texts whose
    fingerprints are given. A window lies in one of the beginnings, or in the
    characters beside the seam. Windows select ever later positions, so what those
    up to some window select are the entries up to the one that it selects."""
    reach = K + WINDOW - 1

    def of(piece: Column) -> Column:
        return fingerprint(F.split(piece, ""))

    def joined(seam: Column, end: Column, n: Column) -> Column:
        first = F.array_position(fp["pos"], F.get(seam["pos"], F.lit(0)) + n - reach).cast("int")
        last = F.array_position(fp_next["pos"], F.get(end["pos"], F.lit(0)) + F.length(text_next) - reach).cast("int")
        def moved(pos: Column, by: Column) -> Column:
            return F.transform(pos, lambda x: x + by)
        parts = [(fp, F.lit(1), first, F.lit(0)), (seam, F.lit(2), F.size(seam["pos"]) - 1, n - reach), (fp_next, F.lit(2), last - 1, n)]
        return F.struct(F.concat(*[F.slice(p["hash"], a, m) for p, a, m, _ in parts]).alias("hash"),
                        F.concat(*[moved(F.slice(p["pos"], a, m), by) for p, a, m, by in parts]).alias("pos"))

    seam = of(F.concat(F.right(text, F.lit(reach)), F.left(text_next, F.lit(reach))))
    end = of(F.right(text_next, F.lit(reach)))
    return let(F.struct(seam.alias("seam"), end.alias("end"), F.length(text).alias("n")), lambda x: joined(x["seam"], x["end"], x["n"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two fingerprints' hashes, 0 to 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def as_text(fp: Column) -> Column:
    """The hashes in hex, ``;`` and the steps from each position to the next
    (the first's from the text's start); empty if there are none."""
    before = F.concat(F.array(F.lit(0)), fp["pos"])  # one longer: the last is paired with null
    steps = F.slice(F.zip_with(fp["pos"], before, lambda p, q: p - q), 1, F.size(fp["pos"]))
    text = F.concat_ws(";", F.array_join(F.transform(fp["hash"], F.hex), " "), F.array_join(steps.cast("array<string>"), " "))
    return F.when(F.size(fp["pos"]) > 0, text).otherwise(F.lit(""))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the descending ``cuts`` are above the key: a binary search,
    whose steps are halves of the number of cuts."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    # beyond the last cut get() is null, and the step isn't taken
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(key < F.get(edges, at + s - 1), s).otherwise(F.lit(0)))


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str], suffix: str = "_next",
              made: dict[str, Column] | None = None) -> DataFrame:
    """Adds each row's ``columns`` of the next row in descending order of
    ``key`` (of the last: the first row's). Columns ``made`` of the rows are
    added after the shuffle, which doesn't carry them. Ranges of the key, from approximate
    quantiles, are ordered on their own; each range also gets the first row of
    the next, so one shuffle does and no task orders the whole."""
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(key, [i / n for i in range(n - 1, 0, -1)], 10 * n).alias("q")).first()["q"] if n > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    part = F.when(F.col(key).isNull(), F.lit(len(cuts))).otherwise(range_of(F.col(key), cuts))
    ranged = rows.withColumn("range", part)
    # the first row of each range that has rows (one a range), and the range before it, which is the last for the first
    first = ranged.groupBy("range").agg(F.max(F.struct(F.coalesce(key, F.lit(-(1 << 63))), F.col(tie))).alias("top"))
    order = Window.orderBy("range")
    first = first.select("top", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("guest"))
    top = F.struct(F.coalesce(key, F.lit(-(1 << 63))), F.col(tie))
    # rows that repeat the first row's id and text are equal to it: any of them may be the guest
    # (at most RANGES first rows a shuffle partition: a bounded broadcast)
    hosted = ranged.join(F.broadcast(first), top == F.col("top"), "left").drop("top")
    places = F.when(F.col("guest").isNull(), F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("g")))) \
        .otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("g")),
                           F.struct(F.col("guest").alias("r"), F.lit(True).alias("g"))))
    dealt = hosted.withColumn("place", F.explode(places)).drop("range", "guest")
    if made:
        dealt = dealt.repartition("place.r").withColumns(made)
    w = Window.partitionBy("place.r").orderBy("place.g", F.col(key).desc_nulls_last(), F.col(tie).desc())
    nexts = F.lead(F.struct(*columns)).over(w).alias("next")
    out = dealt.select("*", nexts).where(~F.col("place.g"))
    return out.select(*rows.columns, *(made or {}), *[F.col(f"next.{c}").alias(c + suffix) for c in columns])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text and ``fp`` (hashes and positions) of each whole text."""
    return texts(docs, id_col, text_col).withColumn("fp", fingerprint(characters(F.col("text")), k, window))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))


def edited_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, the last
    third replaced by the beginning of the next document, and the likenesses."""
    d = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    d = with_next(d, "doc_id", "h", ["text", "fp"], made={"fp": fingerprint(characters(F.col("text")))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    d = d.withColumns({"head": F.substr("text", F.lit(1), n - third), "tail": F.substr("text_next", F.lit(1), third)})
    d = d.withColumns({"head_units": without_space(F.col("head")), "tail_units": without_space(F.col("tail"))})
    edited = F.concat("head", "tail")
    long = F.least(F.length("head_units"), F.length("tail_units")) >= K + WINDOW - 1
    fp2 = F.when(long, seamed(F.col("fp"), F.col("head_units"), F.col("fp_next"), F.col("tail_units"))) \
        .otherwise(fingerprint(characters(edited)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("fp_next.hash").alias("next"), edited.alias("edited"), fp2.alias("fp2"))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("fp2")).alias("edited_fingerprint"),
                    likeness(F.col("fp.hash"), F.col("fp2.hash")).alias("near_edited"),
                    likeness(F.col("fp.hash"), F.col("next")).alias("near_next"))
