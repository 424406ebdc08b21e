"""Dedupe, joins, sampling, metrics and features on small inline frames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versewise.functions import text as X
from versewise.operators import dedupe as D
from versewise.operators import features as FT
from versewise.operators import joins as J
from versewise.operators import metrics as M
from versewise.operators import sampling as SM


def test_keep_first_last_with_null_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", 5, 3)], "k string, pos int, v int")
    first = {r["k"]: r["v"] for r in D.keep_first(df, ["k"], ["pos"]).collect()}
    last = {r["k"]: r["v"] for r in D.keep_last(df, ["k"], ["pos"]).collect()}
    assert first == {"a": 1, "b": 3} and last == {"a": 2, "b": 3}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("x", "t", 1, 1.0), ("y", "t", 2, 2.0)], "artist string, title string, pos int, v double")
    new = spark.createDataFrame([("x", "t", 9, 5.0)], "artist string, title string, pos int, v double")
    once = D.upsert_keep_last(old, new, ["artist", "title"], "pos")
    twice = D.upsert_keep_last(once, new, ["artist", "title"], "pos")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {r["artist"]: r["v"] for r in once.collect()} == {"x": 5.0, "y": 2.0}


def song(spark, rows):
    return spark.createDataFrame(rows, "title string, artist string, lyrics string, vibe string")


def test_merge_with_catalog(spark):
    lyr = "la " * 20
    songs = song(spark, [("Hello!", "ADELE", lyr, None), ("", "", lyr, " happy "), ("Nope", "X", lyr, None)])
    cat = spark.createDataFrame([(1, "t1", "hello", "Adele", 0.2, 0.3), (2, "t2", "Hello", "adele", 0.9, 0.9),
                                 (3, "t3", "", "", 0.8, 0.8)],
                                "pos int, track_id string, track_name string, track_artist string, "
                                "valence double, energy double")
    prep = J.prepare_catalog(cat, "pos")
    m = {r["title"]: r for r in J.merge_with_catalog(songs, prep).collect()}
    assert m["Hello!"]["spotify_id"] == "t1" and m["Hello!"]["label_source"] == "kaggle"
    assert m["Hello!"]["vibe"] == "melancholic"
    assert m[""]["spotify_id"] == "t3" and m[""]["vibe"] == "happy"   # blank keys match (reference behaviour)
    assert m["Nope"]["spotify_id"] is None and m["Nope"]["vibe"] == "" and m["Nope"]["label_source"] == ""
    s = J.merge_summary(prep, J.merge_with_catalog(songs, prep), J.merge_keep_predicate()).first()
    assert tuple(s) == (2, 3, 2, 2)


def test_resume_pending(spark):
    wanted = spark.createDataFrame([("A", "x"), ("B", "y")], "artist string, title string")
    have = spark.createDataFrame([(" a ", "X"), (None, "y")], "artist string, title string")
    assert [tuple(r) for r in J.resume_pending(wanted, have).collect()] == [("B", "y")]


def test_overlay_replaces_audio_even_with_null(spark):
    rows = spark.createDataFrame(
        [("t", "a", "", "old", 0.5, 0.5, "dark", "genius", "Spotify: 429 Client Error", "p")],
        "title string, artist string, album string, spotify_id string, valence double, energy double, "
        "vibe string, sources string, fetch_errors string, audio_path string")
    info = rows.select(F.lit(None).cast("string").alias("info_title"), F.lit(None).cast("string").alias("info_artist"),
                       F.lit(None).cast("string").alias("info_album"), F.lit(None).cast("string").alias("info_spotify_id"),
                       F.lit(None).cast("string").alias("info_preview_url"),
                       *[F.lit(None).cast("double").alias(f"info_{c}") for c in J.AUDIO_COLS],
                       F.array().cast("array<string>").alias("info_sources"),
                       F.array(F.lit("Spotify: no match")).alias("info_errors"))
    out = J.overlay(rows.crossJoin(info)).first()
    assert out["valence"] is None and out["spotify_id"] == "" and out["vibe"] == "dark"
    assert out["fetch_errors"] == "Spotify: no match" and out["sources"] == "genius"


def test_file_presence(spark, tmp_dir):
    import os
    path = os.path.join(tmp_dir, "a.mp3")
    open(path, "wb").write(b"x")
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp3").load(tmp_dir).select("path")
    df = spark.createDataFrame([(path,), ("/nope.mp3",), ("",)], "audio_path string")
    got = [r["audio_exists"] for r in J.attach_file_presence(df, listing).orderBy("audio_path").collect()]
    assert sorted(got) == [False, False, True]


def test_stratified_split_exact(spark):
    rows = [(i, "a" if i % 10 < 6 else ("b" if i % 10 < 9 else "c")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y string")
    out = SM.stratified_split(df, "y", "id", test_n=50, seed=7, buckets_hex=1)
    test = out.filter("split = 'test'")
    assert out.count() == 200 and test.count() == 50
    per = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    assert per == {"a": 30, "b": 15, "c": 5}
    # the same rows a full sort per class would pick
    import hashlib
    want = set()
    for y, q in per.items():
        ids = sorted((hashlib.md5(f"{i}|7".encode()).hexdigest(), i) for i, yy in rows if yy == y)
        want |= {i for _, i in ids[:q]}
    assert {r["id"] for r in test.collect()} == want


def test_split_falls_back_without_strata(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "id long, y string")
    out = SM.stratified_split(df, "y", "id", test_n=4, seed=1)
    assert out.filter("split = 'test'").count() == 4
    with pytest.raises(ValueError):
        SM.stratified_split(df, "y", "id", test_n=21)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["p", "q", "r"]), min_size=6, max_size=40), st.integers(1, 5))
def test_split_disjoint_complete(spark, labels, test_n):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y string")
    out = SM.stratified_split(df, "y", "id", test_n=min(test_n, len(labels)), seed=3, buckets_hex=1)
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(labels)))
    assert sum(r["split"] == "test" for r in rows) == min(test_n, len(labels))


def test_cap_and_stop(spark):
    pool = spark.createDataFrame([(i, "A" if i < 5 else ("a" if i < 8 else f"x{i}"), i % 4 != 3) for i in range(1, 21)],
                                 "pool_pos int, artist string, ok boolean")
    acc = SM.accept_until(pool, F.col("ok"), "artist", "pool_pos", 6, 2)
    got = [r["pool_pos"] for r in acc.orderBy("pool_pos").collect()]
    # "A"/"a" is one artist (capped at 2); 3, 7, 11, 15, 19 fail the test
    assert got == [1, 2, 8, 9, 10, 12]
    s = SM.discover_summary(pool, acc, "pool_pos", 6).first()
    assert (s["candidates_scanned"], s["skipped"], s["pool_size"], s["unique_artists"]) == (12, 6, 20, 5)


def test_class_report_matches_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c"), ("c", "c"), ("a", "d")]
    df = spark.createDataFrame(pairs, "y string, p string")
    rep = {r["label"]: r for r in M.class_report(df, "y", "p").collect()}
    assert rep["d"]["precision"] == 0.0 and rep["d"]["support"] == 0
    assert abs(rep["accuracy"]["f1"] - 4 / 7) < 1e-12
    idx = {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}
    num = spark.createDataFrame([(idx[y], idx[p]) for y, p in pairs], "label double, prediction double")
    ev = MulticlassClassificationEvaluator(metricName="weightedPrecision")
    assert abs(rep["weighted avg"]["precision"] - ev.evaluate(num)) < 1e-12


def test_regression_metrics_constant_truth(spark):
    df = spark.createDataFrame([(0.5, 0.4), (0.5, 0.7)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert abs(r["mae"] - 0.15) < 1e-12 and r["r2"] is None


def test_confusion_and_hist(spark):
    df = spark.createDataFrame([("chill", "dark"), ("chill", "chill")], "y string, p string")
    c = M.confusion(df, "y", "p").first()
    assert (c["actual"], c["actual_pos"], c["chill"], c["dark"], c["happy"]) == ("chill", 0, 1, 1, 0)
    h = M.mood_histogram(spark.createDataFrame([(1.0, 0.0), (0.95, 0.01)], "v double, e double"), "v", "e")
    assert [tuple(r) for r in h.collect()] == [(9, 0, 2)]


def test_lyrics_features_and_empty(spark):
    df = spark.createDataFrame([(1, "[Chorus] I love you, don't cry!"), (2, "[x]")], "id int, lyrics string")
    f = FT.lyrics_features(df, "lyrics", {"love": 3.2, "cry": -2.0}, on_empty="drop").collect()
    assert len(f) == 1 and f[0]["kw_love_romance"] == 1 / 5 and f[0]["lyrics_exclamation_ratio"] == 1 / 22
    # "cry" is negated by "don't" -> positive
    assert f[0]["vader_neg"] == 0.0 and f[0]["vader_compound"] > 0
    with pytest.raises(Exception):
        FT.lyrics_features(df, "lyrics", on_empty="error").collect()
    nulls = FT.lyrics_features(df, "lyrics", on_empty="null").filter("id = 2").first()
    assert nulls["lyrics_word_count"] is None


def test_chunk_scores_match_token_chunks(spark):
    text = " ".join((["sad"] * 3 + ["x"] * 61) + ["happy"] * 70)
    df = spark.createDataFrame([(1, text), (2, "")], "id int, t string")
    r = {x["id"]: x for x in FT.chunk_rule_scores(df, "t", "id", 64).collect()}
    assert r[1]["n_chunks"] == 3 and r[2]["n_chunks"] == 0
    assert abs(r[1]["emo_sadness"] - 0.3 / 3) < 1e-12
    assert abs(r[1]["emo_joy"] - (0.0 + 1.0 + 0.6) / 3) < 1e-12   # chunks: 0, 64 and 6 "happy"


def test_feature_table_order(spark):
    from versewise.schema import feature_column_names
    df = spark.createDataFrame([(1, "hello there friend of mine", "0.4", 0.2)],
                               "id int, lyrics string, audio_valence string, energy double")
    ft = FT.feature_table(df, "id")
    assert ft.columns[-86:] == feature_column_names()
    r = ft.first()
    assert r["sp_valence"] == 0.4 and r["sp_energy"] == 0.2 and r["rms_mean"] == 0.0


def test_text_functions_stay_in_jvm(spark):
    df = spark.createDataFrame([(1, "some words")], "id int, lyrics string")
    plan = FT.lyrics_features(df, "lyrics")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_nearest_anchor_has_no_exchange(spark):
    from versewise.functions import labels as L
    df = spark.range(100).select((F.col("id") / 100).alias("v"), (F.col("id") % 7 / 7).alias("e"))
    plan = df.select(L.nearest_anchor("v", "e"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keep_first_aggregates_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"))
    plan = D.keep_first(df, ["k"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    lines = [ln for ln in plan.splitlines() if "Aggregate" in ln or "Exchange" in ln]
    assert ["partial" in ln for ln in lines] == [False, False, True] and "Exchange" in lines[1] and "SortAggregate" in lines[0]


def plain_sentiment(toks, lex, negators, boosters):
    """The look-back rule token by token."""
    s = pos = neg = 0.0
    hits = 0
    for i, t in enumerate(toks or []):
        v = lex.get(t, 0.0)
        if not v:
            continue
        before = toks[max(0, i - 3):i][::-1]
        v += (1 if v > 0 else -1) * sum(boosters.get(p, 0.0) * f for p, f in zip(before, (1.0, 0.95, 0.9)))
        if set(before) & set(negators):
            v *= -0.74
        hits, s, pos, neg = hits + (v != 0), s + v, pos + (v + 1 if v > 0 else 0), neg + (v - 1 if v < 0 else 0)
    total = pos + abs(neg) + len(toks or []) - hits
    share = [round(abs(x / total), 3) if total > 0 else 0.0 for x in (pos, neg, len(toks or []) - hits)]
    return (round(s / (s * s + 15) ** 0.5, 4) + 0.0, *share)


def test_sentiment_against_a_plain_look_back(spark):
    import random
    r = random.Random(3)
    lex = {"love": 3.2, "lov": -1.0, "loves": 1.1, "sad": -2.1, "sadly": -1.7, "don't": -0.4, "so": 0.9, "zero": 0.0, "fine": 0.293, "ok": -0.293, "a b": 5.0}
    boosters = {k: v for k, v in FT.DEFAULT_BOOSTERS.items() if k not in lex}
    words = [*lex, "not", "never", "very", "slightly", "such", "x", "lo", "lovesick", "night", "'", "without", "barely"]
    words.remove("a b")
    rows = [(i, [r.choice(words[:int(2 + r.random() * len(words))]) for _ in range(r.randint(0, 25))]) for i in range(300)] + [(900, None), (901, []), (902, ["love"] * 5000)]
    df = spark.createDataFrame(rows, "id int, toks array<string>")
    got = {x["id"]: tuple(x[1:]) for x in FT.with_sentiment(df, "toks", lex).drop("toks").collect()}
    for i, toks in rows:
        assert got[i] == pytest.approx(plain_sentiment(toks, lex, FT.DEFAULT_NEGATORS, boosters), abs=1.1e-3), (i, toks)
    none = FT.with_sentiment(df, "toks", {}).filter("id = 902").first()
    assert (none["vader_compound"], none["vader_neu"]) == (0.0, 1.0)


def test_words_pattern_is_the_words():
    import re
    words = ["a", "ab", "abc", "b'c", "b.c", "x", "xyz"]
    p = re.compile(FT.words_pattern(words))
    assert [w for w in [*words, "", "abcd", "bxc", "xy", "b"] if p.fullmatch(w)] == words


def test_share_join_against_all_pairs(spark):
    import random
    from versewise.operators import joins as J
    r = random.Random(5)
    words = [f"w{int(20 * r.random() ** 2)}" for _ in range(60)]
    title = lambda k: sorted({r.choice(words) for _ in range(r.randint(0, k))})
    known = [(i, r.choice("ab"), title(7)) for i in range(300)]
    asked = [(r.choice("abc"), title(6)) for _ in range(200)]
    k = spark.createDataFrame(known, "id int, group string, tokens array<string>")
    a = spark.createDataFrame(asked, "group string, tokens array<string>")
    for share in (0.3, 0.5, 0.8, 1.0):
        want = {}
        for g, t in asked:
            rows = [(-len(set(t) & set(u)), i) for i, h, u in known if h == g and set(t) & set(u) and len(set(t) & set(u)) >= share * len(t) - 1e-9]
            if rows:
                want[g, tuple(t)] = min(rows)[1]
        for rows in (10_000, 5):  # lists whole and in parts
            got = {(x["group"], tuple(x["tokens"])): x["id"] for x in J.share_join(a, k, share, rows).collect()}
            assert got == want


def test_tokens_helper_words(spark):
    assert X.word_pattern(["a", "ab"], X.TOKEN_CLASS).startswith("(?<![a-z'])(?:ab|a)")


def test_sentiment_dict_and_table_lexicons(spark):
    df = spark.createDataFrame([(1, "i do not love this sad song but the night is kind"), (2, "nothing here"), (3, ""),
                                (4, "so kind"), (5, "slightly very sad"), (6, None)],
                               "id int, t string").withColumn("toks", X.tokens(F.col("t")))
    lex = {"love": 3.2, "sad": -2.1, "kind": 1.5, "night": 0.0}
    cols = ["id", "vader_compound", "vader_pos", "vader_neg", "vader_neu"]
    a = {r["id"]: tuple(r[1:]) for r in FT.with_sentiment(df, "toks", lex).select(cols).collect()}
    table = spark.createDataFrame(list(lex.items()), "w string, v double")
    b = {r["id"]: tuple(r[1:]) for r in FT.with_sentiment(df, "toks", table).select(cols).collect()}
    # love and sad are both negated by "not": -2.368 + 1.554 + 1.5 -> compound 0.1744
    assert a == b and a[3] == a[6] == (0.0, 0.0, 0.0, 0.0) and a[1][0] == 0.1744
    up = 1.5 + 0.293
    assert a[4][0] == round(up / (up * up + 15) ** 0.5, 4)
    down = -(2.1 + 0.293 - 0.293 * 0.95)
    assert a[5][0] == round(down / (down * down + 15) ** 0.5, 4)
    big = {f"w{i}": 1.0 for i in range(5000)} | lex
    assert {r["id"]: tuple(r[1:]) for r in FT.with_sentiment(df, "toks", big).select(cols).collect()} == a


def test_lexicon_size_is_checked(monkeypatch):
    monkeypatch.setattr(FT, "MAX_LEXICON_WORDS", 2)
    with pytest.raises(ValueError):
        FT.lexicon_dict({"a": 1, "b": 2, "c": 3})


def test_model_scorer_loads_once_a_task_and_keeps_null_texts(spark):
    def load():
        return lambda texts: [{"joy": 1.0} for _ in texts]
    df = spark.createDataFrame([(1, "abcdef"), (2, None), (3, ""), (4, "  ")], "id int, t string")
    got = {r["id"]: (r["n_chunks"], r["emo_joy"]) for r in FT.chunk_model_scores(df, "t", "id", 4, load).collect()}
    assert got == {1: (2, 1.0), 2: (1, 0.0), 3: (1, 0.0), 4: (1, 0.0)}


def exchanges_above_scan(df, column):
    """Whether a shuffle stands between the rows that carry ``column`` and the result."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    probe = [ln for ln in plan.splitlines() if "Exchange" in ln and "Broadcast" not in ln]
    return plan, probe


@pytest.mark.parametrize("name", ["nearest_vibe", "text_stats"])
def test_row_queries_have_no_exchange(spark, name):
    from versewise.plans import queries
    _, found = exchanges_above_scan(queries.queries()[name](spark, "/root/testdata/sf0.001"), "text")
    assert found == []


def test_split_does_not_shuffle_wide_rows(spark, tmp_dir):
    path = f"{tmp_dir}/wide"
    spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("y"), F.lit("w" * 50).alias("wide")).write.parquet(path)
    out = SM.stratified_split(spark.read.parquet(path), "y", "id", test_n=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = next(ln for ln in plan.splitlines() if "wide#" in ln and "FileScan" in ln)
    above = [ln for ln in plan.splitlines()[:plan.splitlines().index(wide)] if "Exchange" in ln and "Broadcast" not in ln]
    assert above == [] and out.filter("split = 'test'").count() == 40


def test_split_keeps_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)], "id int, y string")
    out = SM.stratified_split(df, "y", "id", test_n=20).collect()
    assert len(out) == 100 and sum(r["split"] == "test" for r in out) == 20
    assert sum(r["split"] == "test" and r["y"] is None for r in out) == 4


def test_confusion_keeps_other_classes(spark):
    df = spark.createDataFrame([("chill", "weird"), ("chill", None), ("odd", "chill"), ("chill", "chill")], "a string, b string")
    got = {r["actual"]: (r["chill"], r["other"], r["actual_pos"]) for r in M.confusion(df, "a", "b").collect()}
    assert got["chill"][:2] == (1, 2) and got["odd"] == (1, 0, 99)


def test_labels_that_are_nan_are_missing(spark):
    from versewise.operators import joins as J
    from versewise.operators import lookup as LK
    nan = float("nan")
    df = spark.createDataFrame([("a", "t", "la " * 20, "id1", nan, 0.5, None, ["happy"], "", "KR")],
                               "artist string, title string, lyrics string, spotify_id string, valence double, energy double, "
                               "vibe string, lastfm_tags array<string>, genre_hint string, market string")
    assert J.filter_lyrics_and_music(df).count() == 0
    assert df.select(J.fill_vibe(df).alias("v")).first()["v"] == ""
    assert LK.label_cascade(df).first()["label_source"] == "lastfm"


def test_best_match_blank_keys_and_tokens(spark):
    from versewise.operators import joins as J
    cat = spark.createDataFrame([(1, "夜", "歌手"), (2, "Blue Moon Rising", "Ann"), (3, "Blue Sky", "Ann"), (4, "Moon", "Bob")],
                                "track_id int, name string, artist string")
    q = spark.createDataFrame([(1, "海", "誰か"), (2, "Blue Moon Rising (Live)", "Ann"), (3, "Moon", "Zed"), (4, "Blue", "Ann"), (5, "", "Ann")],
                              "q_id int, title string, artist string")
    got = {r["q_id"]: (r["match_id"], r["match_stage"]) for r in J.best_match(q, cat).collect()}
    assert got == {1: (None, None), 2: (2, 3), 3: (4, 2), 4: (2, 3), 5: (None, None)}


def test_signal_framing_options():
    import numpy as np
    from versewise.operators import signal as SG
    x = np.sin(2 * np.pi * 440 * np.arange(22050) / 22050)[None]
    f = SG.Framing(**SG.REFERENCE)
    out = dict(zip(f.names(("time", "spectral")), f.features(x, ("time", "spectral"))[0]))
    assert abs(out["rms_mean"] - 0.7) < 0.03 and 400 < out["spectral_rolloff_mean"] < 700
    assert f.fb.shape == (128, 1025) and f.features(x, ("mfcc",)).shape == (1, 40)
    assert np.allclose(SG.from_mel(SG.to_mel([100.0, 5000.0], "slaney"), "slaney"), [100.0, 5000.0])
    assert (f.features(np.zeros((2, 0)), ("time",)) == 0).all()


def test_long_signals_take_linear_time(spark):
    import time
    from versewise.operators import signal as SG
    df = spark.range(2).select(F.transform(F.sequence(F.lit(0), F.lit(661500)), lambda i: F.sin(i / 10)).alias("s")).cache()
    df.count()
    f = SG.Framing(**SG.REFERENCE)
    SG.signal_features(df.limit(1), "s", f).drop("s").collect()
    t0 = time.time()
    assert len(SG.signal_features(df, "s", f).drop("s").collect()) == 2
    assert time.time() - t0 < 20


def test_blank_keys_old_values_and_leaks(spark):
    from versewise.operators import joins as J
    from versewise.schema import feature_cols_for_target
    cat = spark.createDataFrame([("t1", "夜", "歌", 0.5, 0.5, 1)], "track_id string, track_name string, track_artist string, valence double, energy double, pos int")
    songs = spark.createDataFrame([("海", "誰")], "title string, artist string")
    prep = J.prepare_catalog(cat, "pos")
    assert J.merge_with_catalog(songs, prep).first()["spotify_id"] == "t1"
    assert J.merge_with_catalog(songs, prep, drop_blank_keys=True).first()["spotify_id"] is None
    row = {"title": "t", "artist": "a", "album": "", "spotify_id": "old", "preview_url": "p", "vibe": "dark", "sources": "", "fetch_errors": "",
           **{c: 0.4 for c in J.AUDIO_COLS}}
    info = {f"info_{c}": None for c in ("title", "artist", "album", "spotify_id", "preview_url", *J.AUDIO_COLS)}
    df = spark.createDataFrame([{**row}]).withColumns({k: F.lit(None).cast("double" if k[5:] in J.AUDIO_COLS else "string") for k in info})
    df = df.withColumns({"info_sources": F.array().cast("array<string>"), "info_errors": F.array(F.lit("x"))})
    new, old = J.overlay(df).first(), J.overlay(df, keep_old_on_null=True).first()
    assert (new["spotify_id"], new["tempo"]) == ("", None) and (old["spotify_id"], old["preview_url"], old["tempo"]) == ("old", "p", 0.4)
    assert set(feature_cols_for_target("vibe")) - set(feature_cols_for_target("vibe", leak_guard=True)) == {"sp_valence", "sp_energy"}


def test_chunk_classifier_against_plain_logits(spark):
    import numpy as np
    from pyspark.ml.feature import HashingTF
    rows = [(i, ("love light sweet " if i % 2 else "dark cold rain ") * 3 + f"w{i}", "joy" if i % 2 else "sadness") for i in range(40)] + [(90, None, "joy"), (91, "x", None)]
    df = spark.createDataFrame(rows, "id int, t string, y string")
    m = FT.fit_text_model(df, "t", "y", bits=10, iterations=20)
    texts = [(1, "love, LIGHT! " * 4 + "dark"), (2, " " * 30), (3, None), (4, "cold rain"), (5, "Sweet " * 50)]
    got = {r["id"]: (r["n_chunks"], r["emo_joy"], r["emo_sadness"]) for r in
           FT.chunk_classifier_scores(spark.createDataFrame(texts, "id int, t string"), "t", "id", 20, m).collect()}
    import re
    lr, slot = m.stages[2], HashingTF(numFeatures=1 << 10)
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    for i, t in texts:
        chunks = [(t or "")[k:k + 20] for k in range(0, max(len(t or ""), 1), 20)]
        total = np.zeros(2)
        for c in chunks:
            if c.strip():
                x = b + sum((w[:, slot.indexOf(word)] for word in re.findall(r"\w+", c.lower())), np.zeros(2))
                total += np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert got[i] == (len(chunks), *(pytest.approx(v) for v in total / len(chunks)))
    assert got[1][1] > 0.5 and got[4][2] > 0.5
