"""Nearest anchor, buckets, clipping, numeric aliases, label cascade."""

import math

from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.operators import lookup as LK
from versewise.schema import VIBE_ANCHORS


def brute_nearest(v, e):
    best, bd = None, math.inf
    for name, av, ae in VIBE_ANCHORS:
        d = (v - av) ** 2 + (e - ae) ** 2
        if d < bd:
            best, bd = name, d
    return best


def test_anchor_points_map_to_themselves(spark):
    df = spark.createDataFrame([(v, e) for _, v, e in VIBE_ANCHORS], "v double, e double")
    got = [r[0] for r in df.select(L.nearest_anchor("v", "e")).collect()]
    assert got == [n for n, _, _ in VIBE_ANCHORS]


def test_nearest_matches_brute_force_on_grid(spark):
    pts = [(i / 20, j / 20) for i in range(-2, 23) for j in range(-2, 23)]
    df = spark.createDataFrame(pts, "v double, e double")
    got = [r[0] for r in df.select(L.nearest_anchor("v", "e")).collect()]
    assert got == [brute_nearest(v, e) for v, e in pts]


def test_tie_goes_to_first_anchor(spark):
    # equidistant from chill (.55,.25) and melancholic (.25,.30)? use an exact midpoint of two anchors
    (n1, v1, e1), (n2, v2, e2) = VIBE_ANCHORS[0], VIBE_ANCHORS[5]
    mid = ((v1 + v2) / 2, (e1 + e2) / 2)
    got = spark.createDataFrame([mid], "v double, e double").select(L.nearest_anchor("v", "e")).first()[0]
    assert got == brute_nearest(*mid)


def test_null_and_nan(spark):
    df = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5)], "v double, e double")
    assert [r[0] for r in df.select(L.nearest_anchor("v", "e")).collect()] == [None, None]


def test_buckets_and_clip(spark):
    df = spark.createDataFrame([(0.34999,), (0.35,), (0.65,), (-1.0,), (2.0,), (None,)], "x double")
    r = df.select(L.energy_bucket("x"), L.valence_bucket("x"), L.clip_round("x")).collect()
    assert [x[0] for x in r] == ["low", "medium", "high", "low", "high", None]
    assert [x[1] for x in r] == ["negative", "neutral", "positive", "negative", "positive", None]
    assert [x[2] for x in r] == [0.35, 0.35, 0.65, 0.0, 1.0, None]


def test_numeric_aliases(spark):
    df = spark.createDataFrame([("0.3", "0.9", "abc", "1"), ("x", None, "120", None)],
                               "valence string, audio_valence string, tempo string, mode string")
    out = df.select(*[c.alias(k) for k, c in L.numeric_features(df).items()]).collect()
    assert out[0]["sp_valence"] == 0.9 and out[0]["sp_tempo"] == 0.0 and out[0]["sp_mode"] == 1.0
    assert out[1]["sp_valence"] == 0.0 and out[1]["sp_tempo"] == 120.0 and out[1]["sp_loudness"] == 0.0


def test_sorted_scores(spark):
    df = spark.createDataFrame([({"b": 0.2, "a": 0.2, "c": 0.61234},)], "m map<string,double>")
    r = df.select(L.sorted_scores(F.col("m"))).first()[0]
    assert [(x["key"], x["value"]) for x in r] == [("c", 0.612), ("a", 0.2), ("b", 0.2)]


def test_tag_mood(spark):
    df = spark.createDataFrame([([],), (["unknown"],), (["  HAPPY ", "sad", "happy"],)], "t array<string>")
    r = df.select(LK.tag_mood(F.col("t")).alias("m")).collect()
    assert r[0]["m"] is None and r[1]["m"] is None
    assert abs(r[2]["m"]["valence"] - (0.85 * 2 + 0.22) / 3) < 1e-12


def test_label_cascade_order(spark):
    rows = [(0.9, 0.9, ["dark"], "rock", "KR"),      # own labels win
            (None, 0.9, ["dark"], "rock", "KR"),     # one label missing -> tags
            (None, None, ["foo"], "genre:Rock", "KR"),  # unknown tags -> genre
            (None, None, [], "", "kr"),              # market, case-insensitive
            (None, None, None, None, "ZZ")]          # unknown market -> pop
    df = spark.createDataFrame(rows, "valence double, energy double, lastfm_tags array<string>, "
                                     "genre_hint string, market string")
    out = LK.label_cascade(df).collect()
    assert [r["label_source"] for r in out] == ["spotify", "lastfm", "genre_estimate", "market_estimate",
                                               "market_estimate"]
    assert (out[1]["valence"], out[1]["energy"]) == (0.15, 0.55)
    assert (out[2]["valence"], out[2]["energy"]) == (0.55, 0.65)
    assert (out[3]["valence"], out[3]["energy"]) == (0.68, 0.72)
    assert (out[4]["valence"], out[4]["energy"]) == (0.65, 0.55)
    assert out[0]["vibe"] == brute_nearest(0.9, 0.9)
