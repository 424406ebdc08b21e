"""Periodic run detection (12): suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, of at least ``LEAST`` words
and ``POWER`` times q, that no neighbouring word extends. Words are appended to
a suffix automaton one by one. Its suffix links form a tree, in which a prefix's
path to the root holds the classes of all its suffixes; a link-cut tree keeps
the path in segments of one colour, the last place at which their strings
ended. Appending word i recolours the whole path to i (an access, O(log n)
amortised); a segment that was coloured e, whose longest string has L words, says
that these L words ended at e before and at i now. If i - e <= L, the two
touch: a square of period i - e, and L + i - e words of that period end at i.
No longer string ended at e, so the stretch can't begin earlier, and no
string of the segment ended after e, so its period is the smallest. Each run shows
at every word from its second period on, until its last: the last one seen is its end.

Words that no run can hold aren't given to the automaton: where a run
with period q goes on, each gram of ``GRAM`` words is the one q words
before, for POWER - 1 periods less a gram; so a stretch of grams that recur after at
most a third of the stretch's own length is left, and what it reaches back to. The
cut loses no run; equal hashes of different grams only leave more words in.

A text is worked on whole, in one task, in space linear in its words.

Nulls, empty texts, repeats: a null or empty text, or one of white space, has no
words and no runs and collapses to the empty text; a null id is kept, and
counts as the empty text where its digits are hashed; rows that repeat an id
give a row each; very long texts aren't cut; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import let, pick
from versewise.llm.vectors import windows

#: Words of a run, and periods of a run, at least.
LEAST, POWER = 6, 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def repetitions(word: list[int]) -> dict[tuple[int, int], int]:
    """(first word, smallest period): last word, of every stretch that holds
    two periods or more and that no neighbouring word extends."""
    # automaton states from 1; 0 is none. State 1 is the empty string
    link, longest, step = [0, 0], [0, 0], [{}, {}]
    # link-cut: splay trees of path segments, in order of depth; a segment's colour is kept at its splay root
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def state(parent: int, length: int, steps: dict) -> int:
        link.append(parent)
        longest.append(length)
        step.append(steps)
        left.append(0)
        right.append(0)
        up.append(parent)
        colour.append(-1)
        return len(link) - 1

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def splay(x: int) -> None:
        r, p = x, up[x]
        while left[p] == r or right[p] == r:
            r, p = p, up[p]
        if r == x:
            return
        colour[x] = colour[r]
        top = up[r]
        while up[x] != top:
            p = up[x]
            g = up[p]
            if g != top:
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    found: dict[tuple[int, int], int] = {}
    last = 1
    for i, c in enumerate(word):
        cur = state(0, i + 1, {})
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if not p:
            parent = 1
        else:
            q = step[p][c]
            parent = q
            if longest[q] != longest[p] + 1:
                # the shorter strings of q get a state of their own, above q on the same segment
                parent = state(link[q], longest[p] + 1, dict(step[q]))
                while p and step[p].get(c) == q:
                    step[p][c] = parent
                    p = link[p]
                splay(q)
                link[q] = parent
                colour[parent] = colour[q]
                up[parent] = up[q]
                if left[q]:
                    left[parent] = left[q]
                    up[left[q]] = parent
                    left[q] = 0
                right[parent] = q
                up[q] = parent
        link[cur] = up[cur] = parent
        last = cur
        # access: the path from cur to the root becomes one segment, coloured i
        below, v = 0, cur
        while v:
            splay(v)
            e = colour[v]
            if right[v]:
                colour[right[v]] = e
            right[v] = below
            if e >= 0 and i - e <= longest[v]:
                found[i - longest[v] - (i - e) + 1, i - e] = i
            below, v = v, up[v]
        colour[below] = i
    return found


def stretches(word: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """Disjoint stretches (first, one past the last word) outside which no word
    is in a run; each run is wholly within one."""
    gram = min(least - 1, 2 * (power - 1))
    n = len(word) - gram + 1
    if n < 2:
        return []
    g = windows(word.astype(np.uint64), gram)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return []
    back = np.full(n, n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    alive = back < n
    while True:
        edge = np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8))
        first, past = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        # a run of period q in here has at least (power - 1) q - gram + 1 grams that recur after q
        most = (past - first + gram - 1) // (power - 1)
        still = alive.copy()
        still[alive] = back[alive] <= np.repeat(most, past - first)
        if (still == alive).all():
            break
        alive = still
    out: list[tuple[int, int]] = []
    for a, z, q in zip(first.tolist(), past.tolist(), most.tolist()):
        a, z = max(0, a - q), z + gram - 1
        while out and a < out[-1][1]:
            a, z = min(a, out[-1][0]), max(z, out.pop()[1])
        out.append((a, z))
    return out


def runs(word: list[int], least: int = LEAST, power: int = POWER, cut: bool = True) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. Without
    ``cut`` all words are given to the automaton."""
    out = []
    for a, z in stretches(np.array(word, np.int64), least, power) if cut else [(0, len(word))]:
        for (s, q), e in repetitions(word[a:z]).items():
            length, s, e = e - s + 1, s + a, e + a
            if length < max(least, power * q):
                continue
            # one that only the stretch's own edge ends is part of a run of another stretch
            if (s == a and s and word[s - 1] == word[s - 1 + q]) or (e == z - 1 and z < len(word) and word[z] == word[z - q]):
                continue
            out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Equal words as equal numbers."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and
    collapsed, the words that stay, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        ("collapsed", pa.string())])

    def detect(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for i, raw in zip(b["doc_id"].slice(at, 256).to_pylist(), b["text"].slice(at, 256).to_pylist()):
                    words = (raw or b"").split()  # bytes are split at ASCII white space alone
                    n, found = len(words), runs(numbered(words), least, power)
                    if found:
                        words = [words[k] for k in np.nonzero(kept(n, found))[0].tolist()]
                    out.append((i, n, [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(words).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(detect, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one id in ten, by the crc32 of its digits, the words from a place on
    repeat with a period, both by the same number."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * times)[:n - a]


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, in which one document in ten is made periodic."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def plant(batches):
        for b in batches:
            ids = b["doc_id"].to_pylist()
            at = [k for k, i in enumerate(ids) if zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0]
            texts = b["text"]
            if at:
                changed = texts.to_pylist()
                for k in at:
                    changed[k] = b" ".join(made_periodic(ids[k], (changed[k] or "").encode().split())).decode()
                texts = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], texts.cast(pa.string())], schema=schema)

    d = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(plant, "doc_id long, text string")


def strongest(found: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of
    equals. Null without runs."""
    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    return F.aggregate(found, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def summary(found: DataFrame) -> DataFrame:
    """Of :func:`periodic_runs` the strongest run and digests of all."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words")
