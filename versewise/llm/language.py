"""Language identification (6): sparse multinomial logistic regression on
TF-IDF character n-grams, trained by follow-the-regularised-leader with
elastic-net penalties, then calibrated by a temperature.

Only rows that ``learn`` selects and that have a label are learnt from: their
n-gram document frequencies are counted over all of them, on Spark; the model
is fitted on at most about ``per_class`` of them a language, chosen by hash,
whole texts. Prediction uses the text alone.

Nulls, empty texts, ties, repeats: of equally likely languages the first by name
is predicted; very long texts count whole; extra columns are not read; a null text, or one without a letter, is ``und``
with score 0; a null label isn't learnt; a null id counts as an empty one in
the choice of rows; repeated rows are each learnt and predicted; with nothing
to learn from, everything is ``und``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import pick, zero_crc

BITS = 16
LONGEST = 4
UNKNOWN = "und"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of anything but letters
    as one space, a space at both ends; a text without a letter gives none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    at = np.nonzero(letters()[codes])[0]
    if not len(at):
        return np.zeros(0, np.uint64)
    place = np.arange(1, len(at) + 1) + np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
    out = np.full(place[-1] + 2, 32, np.uint64)
    out[place] = codes[at]
    return out


def ngrams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the runs of 1 to LONGEST of ``letter_codes``."""
    codes = letter_codes(text)
    h, count = np.zeros(len(codes), np.uint64), np.zeros(1 << bits, np.int64)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        h = (h[:len(codes) - n + 1] + codes[n - 1:] + np.uint64(n)) * SPREAD
        count += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    at = np.nonzero(count)[0]
    return at, count[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = ngrams(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / (np.sqrt((v * v).sum()) or 1)


def document_frequencies(rows: DataFrame, slots_of, size: int) -> np.ndarray:
    """Number of texts (column ``text``) that have each of ``size`` slots: each
    task counts its own rows, Spark sums by slot; ``size`` numbers come back."""
    def count(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            for t in b["text"].to_pylist():
                if t:
                    df[slots_of(t)] += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["slot", "n"])

    total = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in total:
        out[r["slot"]] = r["n"]
    return out


class Ftrl:
    """Per-coordinate FTRL-proximal for a softmax over ``classes`` classes."""

    def __init__(self, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((classes, dims + 1)), np.zeros((classes, dims + 1))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        at, v = np.append(at, self.z.shape[1] - 1), np.append(v, 1.0)  # the last slot is the bias
        w = self.weights(at)
        g = softmax(w @ v)
        g[label] -= 1
        g = g[:, None] * v
        n = self.n[:, at]
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - s * w
        self.n[:, at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits of least negative log likelihood, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, r = np.log(0.25), np.log(8.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        x, y = b - r * (b - a), a + r * (b - a)
        a, b = (a, y) if loss(x) < loss(y) else (x, b)
    return float(np.exp((a + b) / 2))


def fit_rows(texts: list[str], labels: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 2, held: int = 5):
    """(weights with the bias last, temperature); every ``held``-th row
    calibrates and isn't trained on, if there are enough."""
    vectors = [vector(t, idf) for t in texts]
    model = Ftrl(classes, len(idf))
    order = np.random.default_rng(0).permutation(len(texts))
    cal = order[::held] if len(order) >= 10 * held else order[:0]
    train = np.setdiff1d(order, cal, assume_unique=True)
    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(train):
            model.learn(*vectors[i], labels[i])
    w = model.weights(slice(None))
    logits = np.array([w[:, vectors[i][0]] @ vectors[i][1] + w[:, -1] for i in cal])
    return w, temperature(logits, labels[cal]) if len(cal) else 1.0


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, idf: np.ndarray, temp: float):
        self.names, self.weights, self.idf, self.temp = names, weights.astype(np.float32), idf, temp

    def predict(self, text: str | None) -> tuple[str, float]:
        at, v = vector(text or "", self.idf) if self.names else ([], [])
        if not len(at):
            return UNKNOWN, 0.0
        p = softmax((self.weights[:, at] @ v + self.weights[:, -1]) / self.temp)
        k = int(p.argmax())
        return self.names[k], float(min(1.0, max(0.0, p[k])))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        per_class: int = 1500) -> Model:
    """``learn`` is a condition over the column ``doc_id``. ``per_class``
    bounds the fitted sample of each language."""
    rows = pick(docs, doc_id=id_col, text=text_col, label=label_col).where(learn & F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a language
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros(1), 1.0)
    df = document_frequencies(rows, lambda t: ngrams(t)[0], 1 << BITS)
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    # about per_class rows of each language: those with the smallest hashes
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("label") == name, F.lit(min(1.0, per_class / counts[name]))).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit < share).select("doc_id", "text", "label")

    def train(batches):
        got = [(r["text"], names.index(r["label"])) for b in batches for r in b.to_pylist()]
        got.sort()
        w, t = fit_rows([x for x, _ in got], np.array([y for _, y in got], np.int64), len(names), idf)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([t])], names=["w", "t"])

    # all tasks look for the sample, one learns from it; a few MB of weights come back
    got = sample.repartition(1).mapInArrow(train, "w binary, t double").first()
    return Model(names, np.frombuffer(got["w"], "<f4").reshape(len(names), -1), idf, got["t"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    def run(batches):
        for b in batches:
            found = [model.predict(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(parts: int, left: int) -> Column:
    return F.pmod(zero_crc(F.col("doc_id")), F.lit(parts)) == left
