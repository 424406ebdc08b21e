"""The multinomial booster against plain numpy and against one-vs-rest."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from versewise.operators import boosting as B


def rows(n, seed=0, noise=0.25):
    r = np.random.default_rng(seed)
    x = r.random((n, 3))
    c = np.where(x[:, 0] < 0.3, 0, np.where(x[:, 1] < 0.5, 1, 2))
    c = np.where(r.random(n) < noise, r.integers(0, 3, n), c)
    return [(i, *map(float, v), "abc"[k]) for i, (v, k) in enumerate(zip(x, c))]


SCHEMA = "id int, u double, v double, w double, y string"


def log_loss(p, y, classes):
    return float(np.mean([-np.log(max(q[classes.index(c)], 1e-12)) for q, c in zip(p, y)]))


def test_no_worse_than_one_against_the_rest(spark):
    train, test = spark.createDataFrame(rows(1200), SCHEMA), spark.createDataFrame(rows(600, 1), SCHEMA)
    m = B.fit(train, ["u", "v", "w"], "y", rounds=8, depth=3, rate=0.3, seed=1)
    out = m.transform(test).select("y", "prediction", "probability").collect()
    p = np.array([r["probability"] for r in out])
    assert np.allclose(p.sum(1), 1) and all(m.classes[int(np.argmax(q))] == r["prediction"] for q, r in zip(p, out))
    ours = log_loss(p, [r["y"] for r in out], m.classes)

    va = VectorAssembler(inputCols=["u", "v", "w"], outputCol="features")
    index = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    ovr = OneVsRest(classifier=GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=1)).fit(index.transform(va.transform(train)))
    raw = ovr.transform(va.transform(test)).select("y", vector_to_array("rawPrediction").alias("r")).collect()
    theirs = log_loss(B.softmax(np.array([r["r"] for r in raw])), [r["y"] for r in raw], m.classes)
    assert ours <= theirs and ours < 0.9 * np.log(3)
    assert np.mean([r["prediction"] == r["y"] for r in out]) > 0.7
    assert m.losses == sorted(m.losses, reverse=True)  # the training loss falls every round


def test_one_round_is_the_newton_step(spark):
    data = rows(400, 2)
    m = B.fit(spark.createDataFrame(data, SCHEMA), ["u", "v", "w"], "y", rounds=1, depth=2, rate=0.5)
    x = (np.array([r[1:4] for r in data]) - m.mean) / m.std
    y = np.array(["abc".index(r[4]) for r in data])
    p = B.softmax(np.tile(m.prior, (400, 1)))
    for k, t in enumerate(m.rounds[0]):
        g = (y == k) - p[:, k]
        at = B.leaves(t, x)
        for leaf in set(at.tolist()):
            s = g[at == leaf]
            assert t["value"][leaf] == pytest.approx(0.5 * 2 / 3 * s.sum() / (np.abs(s) * (1 - np.abs(s))).sum())
        assert len(set(at.tolist())) > 1


def test_save_and_load_nulls_and_one_class(spark):
    df = spark.createDataFrame(rows(200, 3), SCHEMA).withColumn("u", F.when(F.col("id") % 7 != 0, F.col("u")))
    m = B.fit(df, ["u", "v"], "y", rounds=2, depth=2, rate=0.3)
    again = B.BoostedClasses.from_json(m.to_json())
    assert m.transform(df).collect() == again.transform(df).collect()
    one = B.fit(df.withColumn("y", F.lit("only")), ["v"], "y", rounds=2, depth=2, rate=0.3)
    assert {(r["prediction"], *r["probability"]) for r in one.transform(df).collect()} == {("only", 1.0)}
    with pytest.raises(ValueError):
        B.fit(df.withColumn("y", F.lit(None).cast("string")), ["v"], "y", rounds=2, depth=2, rate=0.3)
    assert m.transform(df.limit(0)).collect() == []


def test_validation_rows_stop_and_do_not_train(spark):
    df = spark.createDataFrame(rows(600, 4, noise=1.0), SCHEMA).withColumn("held", F.col("id") % 3 == 0)
    odd = df.unionByName(df.limit(5).withColumns({"y": F.lit("unseen"), "held": F.lit(True)}))
    m = B.fit(odd, ["u", "v", "w"], "y", rounds=30, depth=3, rate=0.5, validation="held", patience=2)
    assert m.classes == ["a", "b", "c"] and len(m.rounds) < len(m.losses) < 30
    assert len(m.rounds) in (1, int(np.argmin(m.losses)) + 1)
