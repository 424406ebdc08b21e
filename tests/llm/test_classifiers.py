import numpy as np
import pytest
from pyspark.sql import functions as F

from versewise.llm import language, queries, quality_knn

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and 250 < len(held) < 420
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_held_out_accuracy(spark):
    got = queries.op9_quality_classifier(spark, SF)
    assert got.count() == 1000
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


TEXTS = {"aa": "the cat and the dog went home", "bb": "der hund und die katze gehen heim"}


def test_language_of_odd_rows(docs):
    rows = [(i, TEXTS[k] * (1 + i % 3), k) for i in range(30) for k in TEXTS] + [(100, None, "aa"), (101, "", "aa"), (102, "12 + 3!", "bb"), (None, TEXTS["aa"], None)]
    model = language.fit(docs(rows), F.lit(True))
    assert model.names == ["aa", "bb"]
    got = language.predict(docs(rows), model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows) and by[100] == by[101] == by[102] == ("und", 0.0) and by[None][0] == "aa"
    long = model.predict(TEXTS["bb"] * 20000)
    assert long[0] == "bb"


def test_language_of_nothing(docs):
    assert language.predict(docs([]), language.fit(docs([]), F.lit(True))).collect() == []
    got = language.predict(docs([(1, "some text")]), language.fit(docs([(1, "some text", None)]), F.lit(True))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_ftrl_is_sparse_and_temperature_calibrates():
    model = language.Ftrl(2, 50, l1=0.5)
    r = np.random.default_rng(0)
    for _ in range(300):
        y = int(r.integers(0, 2))
        model.learn(np.array([y, 10 + int(r.integers(0, 30))]), np.array([1.0, 0.3]), y)
    w = model.weights(slice(None))
    assert w[0, 0] > 0 > w[0, 1] and (w == 0).mean() > 0.5
    logits = r.normal(size=(4000, 3))
    p = language.softmax(logits / 2.0)
    labels = np.array([r.choice(3, p=q) for q in p])
    assert language.temperature(logits, labels) == pytest.approx(2.0, rel=0.15)


def test_neighbours_are_exact(docs):
    model = quality_knn.Model(np.ones(1 << quality_knn.BITS), np.eye(1 << quality_knn.BITS, 300, dtype=np.float32),
                              np.eye(5, 300, dtype=np.float32), np.array([0, 1, 0, 1, 1.0]), 0.7, 2)
    z = np.zeros((2, 300), np.float32)
    z[0, [0, 1]] = 0.6, 0.8
    model.project = lambda texts: z
    assert model.scores(["a", "b"]) == pytest.approx([0.8 ** 4 / (0.6 ** 4 + 0.8 ** 4), 0.7])


def test_votes_against_a_plain_search(spark):
    """The query's scores from the same vectors: every cosine on its own, the nearest by sorting."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_knn.fit(docs, labels, ~language.held_out(5, 0))
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op9_quality_classifier(spark, SF).collect()}
    assert set(got) == set(text)
    known = model.vectors.astype(np.float64)
    for i in sorted(text)[::7]:
        at, v = quality_knn.vector(text[i], model.idf)
        x = v @ model.space[at].astype(np.float64) if len(at) else np.zeros(known.shape[1])
        length = np.sqrt((x * x).sum())
        near = sorted(((float(k @ x / length), y) for k, y in zip(known, model.labels)), reverse=True) if length else []
        voters = [(c, y) for c, y in near if c >= near[14][0] - 1e-6]
        total = sum(max(c, 0) ** 4 for c, _ in voters)
        want = sum(max(c, 0) ** 4 * y for c, y in voters) / total if total else model.prior
        assert got[i] == pytest.approx(want, abs=0.02), i


def test_all_of_the_last_rank_vote():
    eye = np.eye(4, dtype=np.float32)
    model = quality_knn.Model(np.ones(1), np.zeros((1, 4), np.float32), eye[[0, 0, 0, 1]], np.array([1, 0, 0, 1.0]), 0.5, 1)
    model.project = lambda texts: eye[:1]
    assert model.scores(["x"])[0] == pytest.approx(1 / 3)


def test_language_against_a_plain_learner():
    """FTRL-proximal one coordinate at a time."""
    import math
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["der", "und", "ein", "the", "and", "one"][3 * (k % 2):][:3], 6)) for k in range(24)]
    labels, idf = np.array([k % 2 for k in range(24)]), np.ones(1 << language.BITS)
    w, _ = language.fit_rows(texts, labels, 2, idf, epochs=2)
    z, n = [{}, {}], [{}, {}]
    alpha, beta, l1, l2, bias = 0.5, 1.0, 0.02, 0.01, 1 << language.BITS

    def weight(c, i):
        x = z[c].get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n[c].get(i, 0.0))) / alpha + l2)
    for e in range(2):
        for k in np.random.default_rng(e).permutation(np.random.default_rng(0).permutation(24)):
            at, v = language.vector(texts[k], idf)
            x = [*zip(at.tolist(), v.tolist()), (bias, 1.0)]
            out = [sum(weight(c, i) * a for i, a in x) for c in (0, 1)]
            top = max(out)
            p = [math.exp(o - top) for o in out]
            p = [q / sum(p) for q in p]
            now = [{i: weight(c, i) for i, _ in x} for c in (0, 1)]
            for c in (0, 1):
                for i, a in x:
                    g = (p[c] - (labels[k] == c)) * a
                    old = n[c].get(i, 0.0)
                    z[c][i] = z[c].get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * now[c][i]
                    n[c][i] = old + g * g
    for c in (0, 1):
        plain = np.zeros(bias + 1)
        for i in z[c]:
            plain[i] = weight(c, i)
        assert np.abs(plain - w[c]).max() < 1e-9


def test_very_long_texts_are_scored(spark, docs, prose):
    long = prose(120_000, 3)
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    rows = [(i, prose(40, i) if i % 2 else prose(40, i).upper()) for i in range(20)] + [(50, long), (51, long.upper())]
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs(rows), quality_knn.fit(docs(rows), lab, F.lit(True))).collect()}
    assert got[50] > 0.5 > got[51]


def test_latent_space_is_the_svd():
    x = np.random.default_rng(1).standard_normal((40, 8)).astype(np.float32) @ np.random.default_rng(2).standard_normal((8, 60)).astype(np.float32)
    v = quality_knn.latent(x, 8)
    assert np.abs(x @ v @ v.T - x).max() < 1e-3


def test_quality_of_odd_rows(spark, docs, prose):
    rows = [(i, prose(40, i) if i % 2 else " ".join(w.upper() + "!!" for w in prose(40, i).split())) for i in range(40)] + [(90, None), (91, ""), (None, prose(30, 1))]
    lab = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (5, 0, "x"), (999, 1, "x"), (6, None, "x")], "doc_id long, quality int, y string")
    model = quality_knn.fit(docs(rows), lab, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs(rows), model).collect()}
    assert len(got) == len(rows) and got[90] == got[91] == pytest.approx(21 / 41)
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(40)) and got[None] > 0.5
    kept = quality_knn.accepted(docs(rows), model, 0.5)
    assert kept.columns == docs(rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_quality_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_knn.score(docs([]), quality_knn.fit(docs([]), none, F.lit(True))).collect() == []
    assert [r["score"] for r in quality_knn.score(docs([(1, "x")]), quality_knn.fit(docs([(1, "x")]), none, F.lit(True))).collect()] == [0.5]
    # labels of no document
    one = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert [r["score"] for r in quality_knn.score(docs([(1, "x")]), quality_knn.fit(docs([(1, "x")]), one, F.lit(True))).collect()] == [1.0]


def test_ngrams_of_up_to_four_characters():
    at, n = language.ngrams("abcdefg")  # 9 characters with the spaces around
    assert n.sum() == 9 + 8 + 7 + 6
    many = " ".join(chr(0x4E00 + i) for i in range(20_000))
    assert language.ngrams(many)[0].max() >= 1 << 15
