"""Ranked lexical search (11): accumulator-limited term-at-a-time.

Documents are searched in lots, each with an inverted index of its own, under
counts of the whole corpus. An item's terms are taken rarest first. A term adds
its share to the accumulators of the documents that hold it, and creates one for
those that have none, as long as a document without one could still be ranked:
as soon as the greatest shares of the remaining terms add up to less than the
k-th best score so far (of the lot, or of the lots that the task searched
before), no accumulator is created any more, and the survivors alone are
updated, exactly, by all remaining terms. A sum equal to that score doesn't
stop creation, as an equal score with a smaller id is ranked before. The best k
of each task are merged, first within ``SALTS`` parts of an item, then to the
item's best k; a task sends k rows an item, whatever it holds.

Scores are integers (see :func:`weights` and :func:`shares`), so the order of
adding doesn't matter. Items are searched in blocks of about ``PAIRS``
(item, term) pairs, each broadcast; a block reads the documents once.

Nulls, empty texts, repeats: a null text has no term; a document without a
term isn't counted; an item without one, or whose terms no document has with a
weight above 0, has no rows; rows that share an item's id are one item with the terms
of all; documents that share an id are documents of their own; a null id, of
an item or a document, is an id, the documents' last among equal scores; very
long texts are counted whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versewise.llm.common import pick, stage

TOP = 50
#: (item, term) pairs of a block; postings and documents of a lot; parts in which an item's best are merged first.
PAIRS, POSTINGS, LOT, SALTS = 1 << 18, 1 << 21, 1 << 15, 64
#: ASCII letters and digits, letters in lower case, and all bytes beyond ASCII; others separate terms.
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(TERM_BYTES).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of terms that so many documents hold."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share in a score for its occurrences in a document of n
    terms, before it is multiplied by the term's weight."""
    m = 100 - 50 + 50 * n * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and term, once each."""
    def split(batches):
        for b in batches:
            rows = [(i, t) for i, raw in zip(b["item_id"].to_pylist(), b["text"].to_pylist()) for t in set(terms(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["item_id", "term"])

    i = pick(items, item_id=id_col, text=text_col).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return i.mapInArrow(split, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers of its terms in the
    vocabulary with their occurrences, as 32-bit integers."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])

    def count(batches):
        number = known.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                out = []
                for i, raw in zip(b["doc_id"].slice(at, 512).to_pylist(), b["text"].slice(at, 512).to_pylist()):
                    every = terms(raw)
                    found = [(number[t], c) for t, c in Counter(every).items() if t in number]
                    out.append((i, len(every), np.array([f[0] for f in found], "<u4").tobytes(), np.array([f[1] for f in found], "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(count, "doc_id long, n long, terms binary, tf binary")


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term: a count a term from each task."""
    def count(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b["terms"].to_pylist()), "<u4"), minlength=size)
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    rows = held.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for r in rows.collect():  # at most the vocabulary of a block of items
        out[r["term"]] = r["df"]
    return out


class Index:
    """Inverted index of a lot of documents: of each term the places of the
    documents that hold it, their shares and the greatest of them."""

    def __init__(self, n: np.ndarray, terms: list[bytes], tf: list[bytes], size: int, n_docs: int, n_terms: int):
        term = np.frombuffer(b"".join(terms), "<u4")
        doc = np.repeat(np.arange(len(n)), [len(t) // 4 for t in terms])
        share = shares(np.frombuffer(b"".join(tf), "<u4").astype(np.int64), n[doc], n_docs, n_terms)
        order = np.argsort(term, kind="stable")
        self.doc, self.share, self.docs = doc[order], share[order], len(n)
        self.ends = np.cumsum(np.bincount(term, minlength=size))
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        self.most = np.zeros(size, np.int64)
        some = np.nonzero(self.ends > self.starts)[0]
        if len(some):
            self.most[some] = np.maximum.reduceat(self.share, self.starts[some])

    def holds(self, t: int) -> slice:
        return slice(self.starts[t], self.ends[t])


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def scored(index: Index, query: np.ndarray, weight: np.ndarray, k: int = TOP, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores): all documents of the lot whose score can be among the
    k best or above ``floor``, with exact scores, and maybe others of less.
    ``query``: numbers of the terms, rarest first."""
    acc = np.zeros(index.docs, np.int64)
    gains = weight[query] * index.most[query]
    rest = np.cumsum(gains[::-1])[::-1]  # what this term and the later ones can add
    least, creating = floor, True
    for t, bound in zip(query.tolist(), rest.tolist()):
        at = index.holds(t)
        doc, gain = index.doc[at], index.share[at] * weight[t]
        if creating and bound < max(floor, least):
            creating = False
        if not creating:
            some = acc[doc] > 0
            doc, gain = doc[some], gain[some]
        acc[doc] += gain
        if creating:
            held = acc[acc > 0]
            least = max(least, kth(held, k))
    places = np.nonzero(acc)[0]
    return places, acc[places]


def best(rows: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
    """The k first of (score, id is null, id): highest score, smallest id."""
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]


def hits(held: DataFrame, items: list, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best k documents of each item: item_id, doc_id, score."""
    shared = held.sparkSession.sparkContext.broadcast((items, queries, weight))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        items, queries, weight = shared.value
        top: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        lot: list[tuple] = []
        size = 0

        def solve():
            ids = [r[0] for r in lot]
            index = Index(np.array([r[1] for r in lot], np.int64), [r[2] for r in lot], [r[3] for r in lot], len(weight), n_docs, n_terms)
            for q, query in enumerate(queries):
                floor = top[q][-1][0] if len(top[q]) == k else 0
                places, scores = scored(index, query, weight, k, floor)
                some = scores >= max(floor, kth(scores, k))
                top[q] = best(top[q] + [(s, ids[p] is None, ids[p] or 0) for p, s in zip(places[some].tolist(), scores[some].tolist())], k)

        for b in batches:
            for row in zip(*[b[c].to_pylist() for c in ("doc_id", "n", "terms", "tf")]):
                lot.append(row)
                size += len(row[2]) // 4
                if size >= POSTINGS or len(lot) >= LOT:
                    solve()
                    lot, size = [], 0
        if lot:
            solve()
        out = [(i, None if null else d, s) for i, rows in zip(items, top) for s, null, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                                         [pa.array([], f.type) for f in schema], schema=schema)

    return held.mapInArrow(search, "item_id long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item, numbered: first of each of ``SALTS`` parts of an
    item's rows, so that no task gets all that the tasks sent."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return (part.drop("rank", "part").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            .where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text", k: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0
    for each item, among all ``docs``."""
    wanted = stage(item_terms(items, item_col, query_col), "search-items")
    blocks = max(1, -(-wanted.count() // pairs))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        # about ``pairs`` rows, as items are dealt by hash; one item's terms at least
        by_item: dict = {}
        for r in wanted.where(block == b).toLocalIterator():
            by_item.setdefault(r["item_id"], []).append(bytes(r["term"]))
        vocabulary = sorted({t for ts in by_item.values() for t in ts})
        number = {t: k for k, t in enumerate(vocabulary)}
        held = stage(postings(docs, vocabulary, id_col, text_col), "search-postings")
        total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = document_frequencies(held, len(vocabulary))
        items_ = sorted(by_item, key=lambda i: (i is None, i or 0))
        # rarest first; terms that no document holds add nothing
        queries = []
        for i in items_:
            q = np.array(sorted((number[t] for t in by_item[i]), key=lambda t: (df[t], t)), np.int64)
            queries.append(q[df[q] > 0])
        found = hits(held, items_, queries, weights(df, total["docs"]), total["docs"], total["terms"], k)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"
SEARCH_SQL = f"""
WITH t AS (SELECT doc_id, {_SPLIT} AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
q AS (SELECT DISTINCT item_id, {_SPLIT} AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM f JOIN (SELECT DISTINCT term FROM q) USING (term), c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN l USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}
"""
