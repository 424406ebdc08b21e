"""Suffix-array dedup (7): remove every byte covered by a ``LENGTH``-byte string
that also starts elsewhere, in the same text or another.

A suffix array of the whole corpus would be one unbounded group, so the suffixes
are dealt by content first. Of the ``GRAM``-byte grams of a string of LENGTH
bytes the least hash is its anchor: equal strings have equal anchors. A text's
start positions fall into runs of one anchor; a run's bytes are a context.
Anchors that occur once are dropped; contexts that occur twice repeat as a
whole; only anchors with different contexts need their text. Their contexts are
sorted in batches by two-stage sorting (Itoh and Tanaka 1999): suffixes smaller
than their successors are sorted directly, the rest are induced by a scan of
the buckets, and neighbours whose common prefix has LENGTH bytes are repeats.
An anchor with more than ``HOT`` contexts, as of a passage that very many texts
share, would be one sorting task without bound, whatever its suffixes are dealt
by: equal strings must meet, and any of them may be shared by all contexts. Its
strings are dealt by their own hash and counted by Spark, with partial sums.

Results depend on a text's content alone, so texts are known by a digest and
copies are handled once.

Nulls, empty texts, repeats: a null or empty text has no bytes and loses none;
null ids are kept; repeated rows are copies of each other, and lose everything
from LENGTH bytes on; of equally small grams the rightmost is the anchor; very
long texts are read whole, in segments that overlap; extra columns, whatever
their names, are not read (``without_repeats`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import join_counted, pick, stage
from versewise.llm.vectors import prefix_sums, span_hash

LENGTH, GRAM = 400, 32
HOT = 4000
BATCH = 2 << 20
SEGMENT = 1 << 23
POSITION = np.uint64((1 << 24) - 1)


def contexts(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first start, number of starts, anchor hash, context hash) of each run
    of start positions with one anchor."""
    out = []
    for base in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[base:base + SEGMENT + length - 1]
        sums = prefix_sums(part)
        at = np.arange(len(part) - gram + 1)
        h = span_hash(sums, at, at + gram)
        # hash over inverted position: the least is the rightmost of equals
        best = (h & ~POSITION) | (POSITION - at.astype(np.uint64))
        window, span = length - gram + 1, 1
        while span < window:
            step = min(span, window - span)
            best = np.minimum(best[:len(best) - step], best[step:])
            span += step
        anchor = (POSITION - (best & POSITION)).astype(np.int64)
        first = np.nonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[0]
        count = np.diff(np.append(first, len(anchor)))
        out.append((first + base, count, h[anchor[first]].view(np.int64),
                    span_hash(sums, first, first + count + length - 1).view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def two_stage(text: np.ndarray, want: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions ``want`` (a mask that holds each wanted position's successors
    up to the first that is smaller than its own) in order of their first
    ``length`` bytes. ``text`` ends with ``length`` zero bytes."""
    n = len(want)
    step = np.sign(np.diff(text[:n + 1].astype(np.int16)))
    # equal neighbours are of the type of what follows them
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(step, 1)[following] > 0  # smaller than the successor; the end counts as such
    direct = np.nonzero(want & small)[0]
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - length + 1, length), (1, 1))
    order = direct[np.argsort(rows[direct].view(f"S{length}").ravel(), kind="stable")]
    char = text[:n]
    # of a byte's bucket, the induced suffixes come before the directly sorted ones
    sorted_in = np.split(order, np.searchsorted(char[order], np.arange(1, 256)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    large = want & ~small
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[large[before] & (char[before] == c)]
            waves.append(wave)
        bucket = np.concatenate([*waves, sorted_in[c]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (char[before] > c)]
        if len(before):
            chars = char[before]
            before = before[np.argsort(chars, kind="stable")]
            found, counts = np.unique(chars, return_counts=True)
            for b, part in zip(found.tolist(), np.split(before, np.cumsum(counts)[:-1])):
                induced[b].append(part)
    return np.concatenate(out)


def repeated_starts(parts: list[tuple[bytes, int]], length: int = LENGTH) -> list[np.ndarray]:
    """Of contexts (bytes, number of starts) the starts whose ``length`` bytes
    stand at another start of any of them."""
    sizes = np.array([len(p) + 1 for p, _ in parts])
    text = np.frombuffer(b"\0".join(p for p, _ in parts) + b"\0" * (length + 1), np.uint8)
    n = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    own, want = np.zeros(n, bool), np.zeros(n, bool)
    for b, (p, m) in zip(begin.tolist(), parts):
        own[b:b + m] = True
    # beyond its starts a context adds what they are induced from: up to the next smaller-than-successor suffix
    step = np.sign(np.diff(text[:n + 1].astype(np.int16)))
    at = np.where(step != 0, np.arange(n), n)
    small = np.append(step, 1)[np.minimum.accumulate(at[::-1])[::-1]] > 0
    places = np.nonzero(small)[0]
    for b, (p, m) in zip(begin.tolist(), parts):
        k = np.searchsorted(places, b + m)
        want[b:(int(places[k]) + 1 if k < len(places) else n)] = True
    order = two_stage(text, want, length)
    order = order[own[order]]
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - length + 1, length), (1, 1))
    twice = np.zeros(n, bool)
    for k in range(0, len(order) - 1, 1 << 15):
        a, b = order[k:k + (1 << 15)], order[k + 1:k + 1 + (1 << 15)]
        a = a[:len(b)]
        same = rows[a].view(f"V{length}").ravel() == rows[b].view(f"V{length}").ravel()
        twice[a[same]] = True
        twice[b[same]] = True
    return [np.nonzero(twice[b:b + m])[0] for b, (_, m) in zip(begin.tolist(), parts)]


def stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of successive numbers: first and one past the last."""
    cut = np.nonzero(np.diff(starts) != 1)[0] + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + 1


def covered(marks: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start in the marked runs."""
    out: list[list[int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [(a, b) for a, b in out]


def digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def marks(docs: DataFrame, text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): distinct texts that may hold repeats (key, bytes) and,
    by key, the runs of start positions that repeat."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") >= length)

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for t in b["text"].slice(at, 256).to_pylist():
                    raw = t.encode()
                    found = contexts(np.frombuffer(raw, np.uint8), length)
                    out.append(([hashlib.sha256(raw).digest()[:16]] * len(found[0]), *found))
                yield pa.RecordBatch.from_arrays([pa.array([k for o in out for k in o[0]], pa.binary()),
                                                  *[pa.array(np.concatenate([o[j] for o in out])) for j in range(1, 5)]],
                                                 names=["key", "start", "n", "anchor", "context"])

    # a row for each run
    runs = stage(rows.mapInArrow(scan, "key binary, start long, n long, anchor long, context long"), "repeats-runs")
    seen = (runs.groupBy("anchor").agg(F.count("*").alias("total"), F.min("context").alias("lo"), F.max("context").alias("hi"))
            .where("total > 1").select("anchor", "total", (F.col("lo") != F.col("hi")).alias("differ")))
    # sums are written before they are joined back, and so is the join before copies are counted:
    # a join of two plain shuffles that no grouping by its key follows can split a hot key
    seen = stage(seen, "repeats-anchors")
    twice = stage(join_counted(runs, seen, ["anchor"], "total", runs.count()).drop("total"), "repeats-shared")
    twice = stage(twice.groupBy("anchor", "context", "key", "start", "n", "differ").agg(F.count("*").alias("copies")), "repeats-counted")
    keys = twice.select("key").distinct()
    texts = (rows.select(digest(F.col("text")).alias("key"), F.col("text").cast("binary").alias("raw"))
             .dropDuplicates(["key"]).join(keys, "key", "left_semi"))
    texts = stage(texts, "repeats-texts")

    # the bytes of one run of each context of the anchors that have several
    one = twice.where("differ").select("anchor", "context", "key", "start", "n").dropDuplicates(["anchor", "context"])
    kinds = one.groupBy("anchor").agg(F.count("*").alias("kinds"))
    wanted = (one.join(kinds, "anchor").groupBy("key")
              .agg(F.collect_list(F.struct("start", "n", "anchor", "context", (F.col("kinds") > hot).alias("hot"))).alias("runs")))

    def cut(batches):
        for b in batches:
            for raw, found in zip(b["raw"].to_pylist(), b["runs"].to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in found]) for k in ("anchor", "context", "n", "hot")]
                    + [pa.array([raw[r["start"]:r["start"] + r["n"] + length - 1] for r in found], pa.binary())],
                    names=["anchor", "context", "n", "hot", "bytes"])

    some = texts.join(wanted, "key").select("raw", "runs").mapInArrow(cut, "anchor long, context long, n long, hot boolean, bytes binary")
    some = stage(some, "repeats-contexts")

    def sort(batches):
        held, size = [], 0

        def solve():
            found = repeated_starts([(r[2], r[1]) for r in held], length)
            out = [(r[0], r[3], a, z) for r, f in zip(held, found) if len(f) for a, z in zip(*map(np.ndarray.tolist, stretches(f)))]
            cols = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "context", "a", "z"])
        for b in batches:
            for anchor, context, n, raw in zip(*[b[c].to_pylist() for c in ("anchor", "context", "n", "bytes")]):
                # a batch ends between anchors
                if held and size >= BATCH and anchor != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                held.append((anchor, n, raw, context))
                size += len(raw)
        if held:
            yield solve()

    found = (some.where("NOT hot").select("anchor", "context", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(sort, "anchor long, context long, a long, z long"))

    def strings(batches):
        for b in batches:
            for anchor, context, n, raw in zip(*[b[c].to_pylist() for c in ("anchor", "context", "n", "bytes")]):
                each = [hashlib.blake2b(raw[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n), pa.array([context] * n), pa.array(range(n), pa.int64()),
                                                  pa.array(each, pa.binary())], names=["anchor", "context", "a", "string"])

    each = some.where("hot").select("anchor", "context", "n", "bytes").mapInArrow(strings, "anchor long, context long, a long, string binary")
    often = each.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    found = found.unionByName(each.join(often, "string", "left_semi").select("anchor", "context", "a", (F.col("a") + 1).alias("z")))

    times = stage(twice.groupBy("anchor", "context").agg(F.sum("copies").alias("times"), F.count("*").alias("rows")), "repeats-times")
    found = stage(found, "repeats-found")
    known = join_counted(twice, times, ["anchor", "context"], "rows", twice.count()).drop("rows")
    whole = known.where("times > 1").select("key", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("z"))
    parts = (known.where("times = 1").join(found, ["anchor", "context"])
             .select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z")))
    return texts, whole.unionByName(parts).groupBy("key").agg(F.collect_list(F.struct("a", "z")).alias("marks"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what remains,
    which has n_kept bytes."""
    texts, found = marks(docs, text_col, length)

    def measure(batches):
        for b in batches:
            out = []
            for key, raw, m in zip(*[b[c].to_pylist() for c in ("key", "raw", "marks")]):
                spans = covered([(x["a"], x["z"]) for x in m], length)
                rest, at = hashlib.sha256(), 0
                for a, z in spans:
                    rest.update(raw[at:a])
                    at = z
                rest.update(raw[at:])
                out.append((key, sum(z - a for a, z in spans), len(spans), rest.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                                 names=["key", "n_removed", "n_spans", "rest"])

    lost = texts.join(found, "key").select("key", "raw", "marks").mapInArrow(measure, "key binary, n_removed long, n_spans long, rest string")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = pick(docs, doc_id=id_col, text=text_col).select("doc_id", digest(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"),
                                                             F.sha2(text.cast("binary"), 256).alias("whole"))
    return every.join(lost, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("rest", "whole").alias("kept_sha256"), (F.col("n_bytes") - F.coalesce("n_removed", F.lit(0))).alias("n_kept"))


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows with the repeated bytes cut from their texts; a character is
    cut only if all its bytes are covered."""
    texts, found = marks(docs, text_col, length)

    def remove(batches):
        for b in batches:
            keys, rests = [], []
            for key, raw, m in zip(*[b[c].to_pylist() for c in ("key", "raw", "marks")]):
                rest, at = [], 0
                for a, z in covered([(x["a"], x["z"]) for x in m], length):
                    while a < len(raw) and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while z < len(raw) and raw[z] & 0xC0 == 0x80:
                        z -= 1
                    if z > a:
                        rest.append(raw[at:a])
                        at = z
                rest.append(raw[at:])
                keys.append(key)
                rests.append(b"".join(rest).decode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rests, pa.string())], names=["_key", "_rest"])

    cut = texts.join(found, "key").select("key", "raw", "marks").mapInArrow(remove, "_key binary, _rest string")
    name = f"`{text_col}`"
    # a null text has no key and stays null
    return (docs.withColumn("_key", digest(F.col(name))).join(cut, "_key", "left")
            .withColumn(text_col, F.coalesce("_rest", F.col(name))).select(*[f"`{c}`" for c in docs.columns]))
