"""Best-fit packing (4) of token pieces into sequences of a fixed length.

Exact-complement hashing on the histogram of piece lengths: for the longest
lengths first, single lengths, pairs and triples whose sum is exactly the gap
are consumed as often as their counts allow; what is left goes best-fit. The
plan depends on the counts of the at most ``capacity`` lengths alone, so it is
made on the driver in bounded memory; pieces then find their places by their
rank among the pieces of their length.

Nulls, empty texts, repeats: a null or empty text is a piece of the end id
alone; null ids and repeated rows are packed like others, each once; pieces of
one length are equal to the plan, and take their places by rank; very long texts
are cut into pieces and lose nothing; extra columns, whatever their names, are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versewise.llm.common import pick, stage
from versewise.llm.encode import encoder

CAPACITY = 1024
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each whole text's ids and ``end_id``; texts longer than ``capacity`` are
    cut into pieces of it, the first taking what is over. ``with_ids`` adds
    the piece's ids (little-endian 32-bit)."""
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def cut(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b["id"].to_pylist(), b["text"]
            for at in range(0, len(ids), 256):
                out = []
                for doc_id, raw in zip(ids[at:at + 256], enc.encode_all(texts.slice(at, 256).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:])):
                        part = raw[4 * a:4 * z]
                        out.append((doc_id, k, a, z - a, zlib.crc32(part), *[part] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    names = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return pick(docs, id=id_col, text=text_col).mapInArrow(cut, names)


def exact_fill(count: np.ndarray, length: int, capacity: int, most: int) -> tuple[int, ...] | None:
    """One, two or three (``most``) available lengths that fill what ``length``
    leaves: fewest parts first, long parts first."""
    gap = capacity - length
    have = count.copy()
    have[length] -= 1
    if gap == 0:
        return ()
    if most > 0 and have[gap] > 0:
        return (gap,)
    if most < 2:
        return None
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    a = a[(have[a] > 0) & (have[gap - a] > 0)]
    for x in a.tolist():
        if x != gap - x or have[x] > 1:
            return (x, gap - x)
    if most < 3:
        return None
    for x in np.nonzero(have[:max(0, gap - 1)])[0][::-1].tolist():
        rest = gap - x
        if 3 * x < gap:
            break
        have[x] -= 1
        b = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
        b = b[(have[b] > 0) & (have[rest - b] > 0)]
        for y in b.tolist():
            if y != rest - y or have[y] > 1:
                return (x, y, rest - y)
        have[x] += 1
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences). Exact fills use up
    short pieces that best fit could have spread, so plans with at most three,
    two and one filling parts are made; the one of fewest sequences counts."""
    return min((plan_with(histogram, capacity, most) for most in (3, 2, 1)), key=lambda made: sum(n for _, n in made))


def plan_with(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills of one part for all lengths, then of two and of three, up to
    ``most``; then best fit of what is left; all by counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made = []
    for parts in range(most + 1):
        for length in range(capacity, 0, -1):
            while left[length] > 0:
                fill = exact_fill(left, length, capacity, parts)
                if fill is None:
                    break
                used = Counter((length, *fill))
                times = min(int(left[x]) // k for x, k in used.items())
                for x, k in used.items():
                    left[x] -= times * k
                made.append(((length, *fill), times))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n > 0:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                # new bins; equal pieces join one of their kind as long as it holds them
                per = capacity // length
                fresh = [((length,) * per, n // per), ((length,) * (n % per), 1)]
                n = 0
            else:
                parts, times = bins[gap].pop()
                used = min(times, n)
                fresh = [(parts, times - used), ((*parts, length), used)]
                n -= used
                if not bins[gap]:
                    del bins[gap]
            for parts, times in fresh:
                if parts and times:
                    bins.setdefault(capacity - sum(parts), []).append((parts, times))
    return made + [x for same in bins.values() for x in same]


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each slot, first sequence, place in it."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for parts, times in made:
        at = 0
        for x in parts:
            by.setdefault(x, []).append((taken[x], first, at))
            taken[x] += times
            at += x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in by.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to staged pieces. The rank of a piece among
    those of its length is its rank in a hashed share of them plus the counts
    of the shares before, so that no length is ranked in one task."""
    spark = cut.sparkSession
    # as many shares as shuffle partitions: a length with a third of all pieces is spread over them
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    cut = cut.withColumn("share", F.pmod(key, F.lit(n)))
    shares = cut.groupBy("length", "share").count()
    histogram = {int(r["length"]): int(r["n"]) for r in shares.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(plan(histogram, capacity))  # at most ``capacity`` lengths: bounded whatever the input
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("rank", rank).join(shares, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("base"))
    columns = [c for c in cut.columns if c != "share"]

    def find(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                of = np.nonzero(length == x)[0]
                ranks, firsts, places = table[x]
                k = np.searchsorted(ranks, rank[of], "right") - 1
                seq[of], at[of] = firsts[k] + rank[of] - ranks[k], places[k]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in columns], pa.array(seq), pa.array(at)],
                                             names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {t}" for c, t in cut.select(*columns).dtypes)
    return ranked.select(*columns, "rank").mapInArrow(find, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset."""
    return place(stage(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id, the
    pieces' documents and the ids; a group holds one sequence."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), ids.alias("ids"))
