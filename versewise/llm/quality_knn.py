"""Quality classifier (9): nearest-neighbour voting among labelled vectors in a
latent semantic space.

Terms of a text are its words, the shapes of words (letter case, digits and
punctuation, runs as one) alone and in pairs, and whether runs of words and
lines are new in the text or repeat earlier ones. Document frequencies are
counted over all texts on Spark. At most about ``per_class`` labelled texts a
class, chosen by hash, give the latent space (truncated SVD of their TF-IDF
rows) and are its labelled vectors: both are broadcast, bounded by that
parameter. Every text is projected; its cosines with all labelled vectors are
exact products of blocks, and the nearest vote with their similarity.

Nulls, empty texts, ties, repeats: all labelled vectors as near as the last
neighbour vote; very long texts count whole; extra columns are not read; a null or empty text gets the share of label 1
among the labelled rows; labels that are null or of no document are not
learnt; of several labels of an id the largest counts; repeated rows are each
scored; with no labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import pick
from versewise.llm.language import document_frequencies
from versewise.llm.vectors import mixed, prefix_sums, slots, span_hash, windows, word_spans

BITS = 13
#: Class of each byte for shapes: letters by case (other bytes of UTF-8 as lower case), digits, the rest as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a"):ord("z") + 1] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[ord("A"):ord("Z") + 1] = ord("A")
SHAPE[ord("0"):ord("9") + 1] = ord("0")
#: Kinds of terms, by the salt of their hashes: weight of the kind in a text's vector.
WORDS, SHAPES, PAIRS, RUNS, LINES = 1, 2, 3, 4, 5
WEIGHT = {WORDS: 0.5, SHAPES: 1.0, PAIRS: 1.0, RUNS: 1.5, LINES: 1.0}


def _repeats(h: np.ndarray) -> np.ndarray:
    """Whether each hash stood before in the array."""
    first = np.ones(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = False
    return first


def terms(text: str) -> list[tuple[int, np.ndarray]]:
    """(kind, 64-bit hash of each occurrence of a term)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return []
    low = np.frombuffer(text.lower().encode(), np.uint8)
    word = span_hash(prefix_sums(low), *word_spans(low))
    # shapes: the first byte of each run of a class, so that a word's shape has no lengths
    cls = SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = cls[1:] != cls[:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    keep_cls = cls[keep]
    # a word that starts within a run can't be: white space is a class of its own
    shape = span_hash(prefix_sums(keep_cls), kept[starts], kept[ends])
    ends_line = np.nonzero(raw == 10)[0]
    line = np.searchsorted(ends_line, starts)
    first = np.nonzero(np.diff(np.concatenate([[-1], line])))[0]
    stop = np.append(first[1:], len(word)) - 1
    lines = span_hash(prefix_sums(raw), starts[first], ends[stop])
    old = lambda h: _repeats(h).astype(np.uint64)
    return [(WORDS, word), (SHAPES, shape), (PAIRS, windows(shape, 2)), (RUNS, old(windows(word, 5))), (LINES, old(lines))]


def counted(text: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, slots, counts)."""
    out = []
    for kind, h in terms(text):
        count = np.bincount(slots(mixed(h * np.uint64(8) + np.uint64(kind)), BITS), minlength=1 << BITS)
        at = np.nonzero(count)[0]
        out.append((kind, at, count[at]))
    return out


def slots_of(text: str) -> np.ndarray:
    found = [at for _, at, _ in counted(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: TF-IDF of each kind, normed, times the kind's weight.
    Runs and lines count by their share of the text, as repeats matter by share."""
    places, values = [], []
    for kind, at, n in counted(text or ""):
        v = n / n.sum() if kind in (RUNS, LINES, SHAPES) else (1 + np.log(n))
        v = v * idf[at]
        places.append(at)
        values.append(WEIGHT[kind] * v / np.sqrt((v * v).sum()))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(places), np.concatenate(values)


def latent(rows: np.ndarray, dims: int, seed: int = 0) -> np.ndarray:
    """Right singular vectors of the ``dims`` largest singular values, by
    random projection and two power iterations."""
    dims = min(dims, *rows.shape)
    q = rows @ np.random.default_rng(seed).standard_normal((rows.shape[1], min(dims + 16, min(rows.shape)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(rows @ (rows.T @ np.linalg.qr(q)[0]))
    return np.linalg.svd(q.T @ rows, full_matrices=False)[2][:dims].T.astype(np.float32)


class Model:
    def __init__(self, idf, space, vectors, labels, prior: float, neighbours: int):
        self.idf, self.space, self.vectors, self.labels = idf, space, vectors, labels
        self.prior, self.neighbours = prior, neighbours

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.space.shape[1]), np.float32)
        for i, t in enumerate(texts):
            at, v = vector(t, self.idf)
            if len(at):
                out[i] = v.astype(np.float32) @ self.space[at]
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A block of texts against all labelled vectors: one matrix product."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = self.project(texts) @ self.vectors.T
        k = near.shape[1] - min(self.neighbours, near.shape[1])
        least = np.partition(near, k, axis=1)[:, k:k + 1]
        # all that are as near as the last neighbour vote
        w = np.where(near >= least, np.maximum(near, 0.0).astype(np.float64) ** 4, 0.0)
        total = w.sum(1)
        vote = (w @ self.labels) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "quality", per_class: int = 1500, dims: int = 64,
        neighbours: int = 15) -> Model:
    """``learn``: condition over ``doc_id`` of the label rows to learn from."""
    lab = (pick(labels, doc_id=label_id, y=label_col).where(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y")))
    counts = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    d = pick(docs, doc_id=id_col, text=text_col)
    nothing = Model(np.ones(1), np.zeros((1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior, neighbours)
    if not total:
        return nothing
    df = document_frequencies(d, slots_of, 1 << BITS)
    idf = np.log((1 + max(df.max(), 1)) / (1 + df)) + 1
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, per_class / max(counts.get(0, 0), 1))))
    chosen = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    # about 2 x per_class ids: bounded by the parameter, so broadcast
    sample = d.join(F.broadcast(chosen), "doc_id").select("text", "y")

    def train(batches):
        got = sorted((r["text"] or "", r["y"]) for b in batches for r in b.to_pylist())
        got = [g for g in got if g[0]]
        rows = np.zeros((len(got), 1 << BITS), np.float32)
        for i, (t, _) in enumerate(got):
            at, v = vector(t, idf)
            np.add.at(rows[i], at, v)
        if not len(got):
            return
        space = latent(rows, dims)
        x = rows @ space
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        y = np.array([y for _, y in got], np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (space, x.astype(np.float32), y)], names=["s", "x", "y"])

    got = sample.repartition(1).mapInArrow(train, "s binary, x binary, y binary").first()
    if got is None:
        return nothing
    y = np.frombuffer(got["y"], np.int8).astype(np.float64)
    return Model(idf, np.frombuffer(got["s"], np.float32).reshape(1 << BITS, -1),
                 np.frombuffer(got["x"], np.float32).reshape(len(y), -1), y, prior, neighbours)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """doc_id, score (0 to 1)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.scores(part["text"].to_pylist()))], names=["doc_id", "score"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text", block: int = 256) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # any column name passes through Arrow
    at_text = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                yield part.filter(pa.array(model.scores(part.column(at_text).to_pylist()) >= least))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
