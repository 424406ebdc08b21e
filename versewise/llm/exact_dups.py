"""Exact dedup (13): tree merge of sorted digest runs.

Texts are equal if they are after each run of ASCII white space is replaced by
one space. A text is known by its SHA-256: the first 8 bytes, the digest, order
the runs; where digests meet, the other 24 bytes verify that the texts are the
same before the smaller identifier is kept.

Each task sorts its documents into runs of one entry a distinct text (smallest
identifier, count). The runs' places are numbered in base ``FAN``; in round r
a place exchanges with the FAN - 1 places that differ from it in digit r: each
gets the entries whose own place, the leading bits of the digest, has its digit
there, and merges the FAN sorted runs it holds into one. A text of a third of all
rows is one entry a run from the start, and in 1/FAN as many runs after each
round; after the last one a place holds all entries of its range of digests, and
no task ever the whole. Entries are packed, 65 bytes each, and places are so many that
each holds about ``PLACE`` of them at most, whatever the size of the input.

Nulls, empty texts, repeats: a null text counts as empty; empty texts are equal
to each other, and not to a text of white space only, which is one space. The
identifier is the id, null after all others, and then the row: of equal rows
that share the smallest id one is kept. Very long texts are digested whole. An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import join_counted, pick, stage

FAN = 8
#: Entries sorted at once by a task; entries of a place.
RUN, PLACE = 1 << 18, 1 << 17
ENTRY = np.dtype([("digest", ">u8"), ("rest", "V24"), ("null", "?"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])

#: The first 16 of an entry: digest, rest, null, id, row, n.
Entry = tuple[int, bytes, bool, int, int, int]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space replaced by one space (a single space,
    which would not change, is not matched)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def distinct(entries: Iterable[Entry]) -> Iterator[Entry]:
    """Of sorted entries one for each verified text: its smallest identifier
    and the sum of the counts."""
    last: Entry | None = None
    for e in entries:
        if last is not None and last[0] == e[0] and last[1] == e[1]:
            last = (*last[:5], last[5] + e[5])
            continue
        if last is not None:
            yield last
        last = e
    if last is not None:
        yield last


def packed(entries: list[Entry]) -> bytes:
    return np.array(entries, ENTRY).tobytes()


def unpacked(block: bytes) -> Iterator[Entry]:
    a = np.frombuffer(block, ENTRY)
    return zip(*[a[c].tolist() for c in ENTRY.names])


def exchange(run: Iterable[Entry], place: int, digit: int, rounds: int) -> list[tuple[int, int, bytes]]:
    """(place to go to, place it comes from, block): a run cut by the given
    digit of its entries' own places."""
    shift, parts = 64 - BITS * rounds + BITS * digit, [[] for _ in range(FAN)]
    for e in run:
        parts[e[0] >> shift & FAN - 1].append(e)
    keep = place & ~((FAN - 1) << BITS * digit)
    return [(keep | k << BITS * digit, place, packed(p)) for k, p in enumerate(parts) if p]


BITS = FAN.bit_length() - 1
BLOCK = pa.schema([("place", pa.int64()), ("source", pa.int64()), ("block", pa.binary())])
KEPT = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows
                                else [pa.array([], f.type) for f in schema], schema=schema)


def tree_merge(digests: DataFrame, rounds: int) -> DataFrame:
    """sha, keep_id, keep_row and group_size of each distinct text of
    ``digests`` (row, doc_id, sha), by ``rounds`` rounds."""
    def local(batches):
        pid = TaskContext.get().partitionId() % FAN ** rounds
        held: list[Entry] = []

        def run():
            rows = exchange(distinct(sorted(held)), pid, 0, rounds)
            held.clear()
            return table(rows, BLOCK).to_batches()

        for b in batches:
            for row, i, sha in zip(*[b[c].to_pylist() for c in ("row", "doc_id", "sha")]):
                held.append((int.from_bytes(sha[:8]), sha[8:], i is None, i or 0, row, 1))
            if len(held) >= RUN:
                yield from run()
        yield from run()

    def merge(digit):
        def merged(key, blocks):
            runs = [unpacked(b) for b in blocks["block"].to_pylist()]
            one = distinct(heapq.merge(*runs))
            if digit + 1 < rounds:
                return table(exchange(one, key[0].as_py(), digit + 1, rounds), BLOCK)
            return table([(d.to_bytes(8) + rest, None if null else i, row, n) for d, rest, null, i, row, n in one], KEPT)
        return merged

    blocks = digests.select("row", "doc_id", "sha").mapInArrow(local, "place long, source long, block binary")
    for digit in range(rounds):
        schema = "place long, source long, block binary" if digit + 1 < rounds else \
            "sha binary, keep_id long, keep_row long, group_size long"
        blocks = blocks.groupBy("place").applyInArrow(merge(digit), schema)
    return blocks


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, keep_id (the id of the row that stays), group_size,
    kept and text_sha256."""
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                 F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha"))
    d = stage(d, "exact-digests")
    total = d.count()
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PLACE))
    rounds = 1
    while FAN ** rounds < places:
        rounds += 1
    groups = stage(tree_merge(d, rounds), "exact-groups")
    every = join_counted(d, groups, ["sha"], "group_size", total)
    return every.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, as they are: one for each kept id and
    text (of equal rows that share an id, one)."""
    stay = duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)
    rows = docs.withColumn("_sha", sha).dropDuplicates([id_col, "_sha"])
    return (rows.alias("r").join(stay.alias("s"), (F.col("r._sha") == F.col("s._sha")) & F.col(f"r.`{id_col}`").eqNullSafe(F.col("s._id")), "left_semi")
            .drop("_sha"))


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
