"""Model training / scoring / persistence and the streaming upsert."""

import os

import pytest
from pyspark.sql import functions as F

from versewise.operators import model as MD
from versewise.session import scratch_path
from versewise.streaming import upsert as ST


def test_model_profiles():
    cfg = MD.model_config(profile="small")
    assert (cfg["n_estimators"], cfg["max_depth"], cfg["learning_rate"]) == (100, 4, 0.08)
    assert MD.model_config()["n_estimators"] == 300
    with pytest.raises(ValueError):
        MD.model_config(profile="tiny")


CFG = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3, "random_state": 1, "parallelism": 2}


def songs(spark, n=80):
    rows = [(i, (i % 10) / 10, ((i * 7) % 10) / 10) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double") \
        .withColumns({"valence": F.col("a") * 0.8 + 0.1, "energy": F.col("b"), "tempo": F.col("a") * 100})


def test_train_score_save_load(spark):
    feats = {t: ["a", "b"] for t in ("valence", "energy", "tempo", "vibe")}
    df = songs(spark)
    models = MD.train_models(df, feats, CFG)      # no vibe column: derived from the two labels
    assert set(models) == {"valence", "energy", "tempo", "vibe"}
    path = scratch_path(spark, "test-models")
    MD.save_models(models, path, {"feature_columns": feats})
    loaded, meta = MD.load_models(path)
    assert set(loaded) == set(models) and meta == {"feature_columns": feats}
    assert MD.rounds_used(loaded) == {t: 3 for t in feats}
    out = MD.score(df.select("id", "a", "b"), loaded, feats, catalog_used=True).collect()
    assert len(out) == 80 and all(0.0 <= r["score_valence"] <= 1.0 for r in out)
    assert {r["valence_label"] for r in out} <= {"negative", "neutral", "positive"}
    assert all(abs(sum(s["value"] for s in r["vibe_scores"]) - 1) < 0.01 for r in out)
    assert out[0]["features_used"] == 2 and out[0]["spotify_features_used"] and not out[0]["audio_analyzed"]
    assert all(abs(r["score_tempo"] - 100 * r["a"]) < 40 for r in out)


def test_unlabelled_and_unseen_rows_are_scored(spark):
    df = songs(spark).withColumn("vibe", F.when(F.col("id") % 2 == 0, "calm").otherwise("loud"))
    models = MD.train_models(df, {"vibe": ["a", "b"]}, CFG)
    assert MD.class_names(models["vibe"]) == ["calm", "loud"]
    odd = df.withColumn("vibe", F.when(F.col("id") % 3 == 0, "never seen").when(F.col("id") % 3 == 1, "calm"))
    for d in (odd, df.drop("vibe")):
        out = MD.score(d, models).collect()
        assert len(out) == 80 and {r["vibe_out"] for r in out} <= {"calm", "loud"}


def test_models_are_versions_and_a_damaged_one_is_an_error(spark, tmp_dir):
    import glob
    path = os.path.join(tmp_dir, "m")
    assert MD.load_models(path) == ({}, {})
    df = songs(spark)
    models = MD.train_models(df, {"valence": ["a", "b"], "vibe": ["a", "b"]}, dict(CFG, n_estimators=1))
    assert set(models) == {"valence"}  # no vibes, and no energy to derive them from
    MD.save_models(models, path, {"n": 1})
    second = MD.save_models(models, path, {"n": 2})
    assert second.endswith("version=2") and MD.load_models(path)[1] == {"n": 2}
    os.remove(os.path.join(second, "metadata", "_SUCCESS"))           # a version that was never committed
    loaded, meta = MD.load_models(path)
    assert meta == {"n": 1} and set(loaded) == {"valence"}
    for f in glob.glob(os.path.join(path, "version=1", "valence_model", "stages", "2_*", "data", "*.parquet")):
        open(f, "r+b").truncate(10)
    with pytest.raises(Exception):
        MD.load_models(path)


def test_a_split_for_validation_stops_the_trees(spark):
    df = songs(spark, 300).withColumns({"valence": F.rand(1), "vibe": F.when(F.rand(2) < 0.5, "x").otherwise("y")})
    cfg = dict(CFG, n_estimators=40)
    models = MD.train_models(df, {"valence": ["a", "b"], "vibe": ["a", "b"]}, cfg, validation_pct=30)
    used = MD.rounds_used(models)
    assert 1 <= used["valence"] < 40 and 1 <= used["vibe"] < 40


def test_rule_fallback(spark):
    df = spark.createDataFrame([(0.6, 120.0, 0.05)], "vader_compound double, tempo_bpm double, rms_mean double")
    r = MD.score(df, {}).first()
    assert r["score_valence"] == 0.8 and abs(r["raw_energy"] - (0.4 * 120 / 180 + 0.6 * 0.5)) < 1e-12


def test_stream_upsert_resumes(spark, tmp_dir):
    schema = "k int, pos int, v string"
    src = os.path.join(tmp_dir, "src")
    table, ckpt = os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ckpt")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(os.path.join(src, "f1"))
    st = spark.createDataFrame([], schema).schema
    out1 = ST.stream_upsert(spark, f"{src}/*", st, ["k"], ["pos"], table, ckpt)
    assert sorted(map(tuple, out1.collect())) == [(1, 1, "a"), (2, 1, "b")]
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], schema).write.parquet(os.path.join(src, "f2"))
    out2 = ST.stream_upsert(spark, f"{src}/*", st, ["k"], ["pos"], table, ckpt)   # resumes from the checkpoint
    assert sorted(map(tuple, out2.collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    # a third run with nothing new changes nothing
    out3 = ST.stream_upsert(spark, f"{src}/*", st, ["k"], ["pos"], table, ckpt)
    assert sorted(map(tuple, out3.collect())) == sorted(map(tuple, out2.collect()))


def test_a_batch_rewrites_touched_buckets_only(spark, tmp_dir):
    schema = "k int, pos int, v string"
    table = os.path.join(tmp_dir, "table")
    merge = ST.merge_batch(table, ["k"], ["pos"], buckets=8)
    first = spark.createDataFrame([(i, 1, "a") for i in range(100)], schema)
    log = ST.SnapshotLog(spark, table)
    assert log.newest() == (-1, {}) and ST.read_upserted(spark, table, first.schema).collect() == []
    merge(first.limit(0), 0)                                            # a batch without rows makes no version
    merge(first, 0)
    epoch, before = log.newest()
    assert epoch == 0 and set(before) == set(range(8))
    merge(spark.createDataFrame([(5, 2, "new")], schema), 1)
    after = log.newest()[1]
    assert sum(after[b] != before[b] for b in range(8)) == 1
    merge(spark.createDataFrame([(5, 9, "retried")], schema), 1)       # an epoch that was committed isn't merged again
    assert log.newest() == (1, after)
    got = {r["k"]: r["v"] for r in ST.read_upserted(spark, table, first.schema).collect()}
    assert len(got) == 100 and got[5] == "new" and got[6] == "a"


def test_a_reader_sees_one_version_while_merges_go_on(spark, tmp_dir):
    schema = "k int, pos int, v string"
    table = os.path.join(tmp_dir, "table")
    merge = ST.merge_batch(table, ["k"], ["pos"], buckets=4, retain=2)
    every = lambda e: spark.createDataFrame([(i, e, f"v{e}") for i in range(50)], schema)
    merge(every(0), 0)
    reader = ST.read_upserted(spark, table, every(0).schema)             # resolved now, read later
    merge(every(1), 1)
    assert {r["v"] for r in reader.collect()} == {"v0"}
    between = ST.read_upserted(spark, table, every(0).schema)
    merge(every(2).filter("k < 3"), 2)
    assert {r["v"] for r in between.collect()} == {"v1"} and between.count() == 50
    assert {r["v"] for r in ST.read_upserted(spark, table, every(0).schema, epoch=1).collect()} == {"v1"}
    log = ST.SnapshotLog(spark, table)
    assert log.epochs() == [1, 2]
    # what no retained manifest names is gone, and so is what an attempt left behind
    os.makedirs(os.path.join(table, "data", "2-dead", "bucket=0"))
    merge(every(3), 3)
    named = {f for e in log.epochs() for f in log.read(e).values()}
    on_disk = {f"data/{d}/{b}" for d in os.listdir(os.path.join(table, "data")) for b in os.listdir(os.path.join(table, "data", d)) if b.startswith("bucket=")}
    assert on_disk == named and {r["v"] for r in ST.read_upserted(spark, table, every(0).schema).collect()} == {"v3"}


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from versewise import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_fits_keep_the_columns_they_read(spark, monkeypatch):
    """Neither ids nor texts of the training rows are kept between the passes."""
    seen = []
    monkeypatch.setattr(MD, "fit_classifier", lambda tr, *_: seen.append(tr.columns))
    df = songs(spark).withColumns({"vibe": F.when(F.col("id") % 2 == 0, "x").otherwise("y"), "lyrics": F.lit("la")})
    MD.train_models(df, {"vibe": ["a", "b"]}, CFG)
    assert sorted(seen[0]) == sorted(["a", "b", "vibe", MD.VALIDATION])
