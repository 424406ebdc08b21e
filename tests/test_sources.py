"""Sources and sinks: CSV round trip, track lists, whole texts, summaries,
payload parsing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from versewise.schema import LABELLED_SONG_SCHEMA
from versewise.sources import payloads as P
from versewise.sources import songs as SG


def test_csv_round_trip_multiline_and_na(spark, tmp_dir):
    rows = [("1", "A", "line one\nline \"two\"", "", "happy", 0.8, 0.6),
            ("2", "NA", "nan", None, None, None, None)]
    df = spark.createDataFrame(rows, LABELLED_SONG_SCHEMA)
    path = os.path.join(tmp_dir, "songs")
    SG.write_table(df, path, "csv")
    back = SG.read_song_csv(spark, path, LABELLED_SONG_SCHEMA).orderBy("track_id").collect()
    assert back[0]["lyrics"] == "line one\nline \"two\"" and back[0]["valence"] == 0.8
    assert back[1]["title"] is None and back[1]["lyrics"] is None   # NA, nan -> NULL
    keep = SG.read_song_csv(spark, path, LABELLED_SONG_SCHEMA, na_tokens=["", "nan"]).orderBy("track_id").collect()
    assert keep[1]["title"] == "NA"


def test_require_and_alias(spark):
    df = spark.createDataFrame([(0.4, 1)], "audio_valence double, audio_mode int")
    with pytest.raises(ValueError):
        SG.require_columns(df, ["lyrics"])
    out = SG.alias_columns(df)
    assert out.first()["valence"] == 0.4 and out.first()["mode"] == 1


def test_track_list_parsing(spark, tmp_dir):
    lines = ["# comment", "", "A - B - C", "D|E", "F,G", "H - ", "no separator", "  I  -  J  ", "K|L - M"]
    path = os.path.join(tmp_dir, "tracks.txt")
    open(path, "w").write("\n".join(lines) + "\n")
    got = [(r["artist"], r["title"]) for r in SG.read_track_list(spark, path).orderBy("pos").collect()]
    assert got == [("A", "B - C"), ("D", "E"), ("F", "G"), ("I", "J"), ("K|L", "M")]


def test_track_lines_and_map(spark):
    df = spark.createDataFrame([("A", "x", "y" * 50), ("nan", "x", "y" * 50), ("B", "z", "short")],
                               "artist string, title string, lyrics string")
    assert [r[0] for r in SG.track_lines(df).collect()] == ["A - x"]
    m = spark.createDataFrame([("A", ["x", "X", "y"], 0), ("a", ["y", "z"], 1)], "artist string, titles array<string>, pos int")
    got = [r["line"] for r in SG.track_map(m).orderBy("pos", "tpos").collect()]
    assert got == ["A - x", "A - y", "a - z"]


def test_whole_texts_and_pairs(spark, tmp_dir):
    for i in range(2):
        open(os.path.join(tmp_dir, f"s{i}.txt"), "w").write(f"line {i}\nmore\n")
    t = SG.read_whole_texts(spark, tmp_dir)
    assert sorted(r["lyrics"] for r in t.collect()) == ["line 0\nmore\n", "line 1\nmore\n"]
    ok = spark.createDataFrame([(["a", "b"], ["x", "y"])], "a array<string>, t array<string>")
    assert [tuple(p) for p in ok.select(SG.pair_lists(F.col("a"), F.col("t"))).first()[0]] == [("a", "x"), ("b", "y")]
    bad = spark.createDataFrame([(["a"], ["x", "y"])], "a array<string>, t array<string>")
    with pytest.raises(Exception):
        bad.select(SG.pair_lists(F.col("a"), F.col("t"))).collect()


def test_summary_json(spark, tmp_dir):
    s = spark.range(5).agg(F.count("*").alias("rows"), F.max("id").alias("top"))
    d = SG.write_summary(spark, s, os.path.join(tmp_dir, "summary"))
    assert d == {"rows": 5, "top": 4}
    assert json.loads(spark.read.text(os.path.join(tmp_dir, "summary")).first()[0]) == d


def test_dataset_rows(spark):
    df = spark.createDataFrame([("t", None, 0.9, 0.9, ["a", "b"]), ("u", "l", None, 0.2, None)],
                               "title string, lyrics string, valence double, energy double, lastfm_tags array<string>")
    out = SG.dataset_rows(df).collect()
    assert out[0]["lyrics"] == "" and out[0]["lastfm_tags"] == "a|b" and out[0]["vibe"] == "energetic"
    assert out[1]["vibe"] == "" and out[1]["lastfm_tags"] == ""


def test_payloads(spark):
    track = json.dumps({"id": "t1", "name": "N", "artists": [], "album": {"name": "Al"},
                        "features": {"valence": 0.3, "energy": 0.4, "key": 5}})
    df = spark.createDataFrame([(track,)], "p string")
    r = P.flatten_track(df, "p").first()
    assert (r["spotify_id"], r["artist"], r["album"], r["valence"], r["key"]) == ("t1", "Unknown", "Al", 0.3, 5)
    obj = json.dumps({"track": {"url": "u", "toptags": {"tag": {"name": "sad"}}}})
    arr = json.dumps({"track": {"url": "v", "toptags": {"tag": [{"name": f"t{i}"} for i in range(12)] + [{"name": ""}]},
                                "album": {"title": "A"}}})
    tags = P.flatten_tags(spark.createDataFrame([(obj,), (arr,)], "p string"), "p", k=10).collect()
    assert tags[0]["lastfm_tags"] == ["sad"] and tags[0]["lastfm_album"] is None
    assert tags[1]["lastfm_tags"] == [f"t{i}" for i in range(10)] and tags[1]["lastfm_album"] == "A"
    search = json.dumps({"tracks": {"items": [{"id": "a", "name": "x", "artists": [{"name": "Z"}]},
                                              {"id": "", "name": "y"}, {"id": "a", "name": "dup"}]}})
    c = P.explode_search(spark.createDataFrame([(1, search)], "q int, p string"), "p", ["q"]).collect()
    assert [(x["spotify_id"], x["title"], x["artist"]) for x in c] == [("a", "x", "Z")]


def test_tags_default_to_all_and_album_fills_empty_only(spark):
    arr = json.dumps({"track": {"toptags": {"tag": [{"name": f"t{i}"} for i in range(12)]}, "album": {"title": "New"}}})
    rows = P.flatten_tags(spark.createDataFrame([(arr, "Old"), (arr, ""), (arr, None)], "p string, album string"), "p", album="album").collect()
    assert [r["album"] for r in rows] == ["Old", "New", "New"] and len(rows[0]["lastfm_tags"]) == 12


def test_a_repeated_artist_takes_the_last_list(spark):
    d = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", ["x"]), (3, "A", ["z"])], "pos int, artist string, titles array<string>")
    assert sorted((r["pos"], r["line"]) for r in SG.track_map(d).collect()) == [(1, "A - z"), (2, "B - x")]


def test_lines_are_numbered_across_splits(spark, tmp_dir):
    import os
    from versewise.sources import songs as SG
    lines = [f"Artist {i} - Song {i}" if i % 10 else "# note" for i in range(20_000)]
    for name, some in (("a.txt", lines), ("b.txt", lines[:5]), ("c.txt", [])):
        with open(os.path.join(tmp_dir, name), "w", newline="") as f:
            f.write("\r\n".join(some) if name == "b.txt" else "".join(x + "\n" for x in some))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))
        assert spark.read.text(tmp_dir).rdd.getNumPartitions() > 8  # a file is read by several tasks
        got = SG.numbered_lines(spark, tmp_dir).collect()
        tracks = SG.read_track_list(spark, tmp_dir).filter("file LIKE '%a.txt'").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r["file"]), {})[r["pos"]] = r["value"]
    assert by == {"a.txt": dict(enumerate(lines)), "b.txt": dict(enumerate(lines[:5]))}
    assert tracks == 18_000


def test_rows_that_do_not_fit_are_rejects(spark, tmp_dir):
    import os
    from pyspark.sql import types as T
    from versewise.sources import songs as SG
    with open(os.path.join(tmp_dir, "songs.csv"), "w") as f:
        f.write('id,lyrics,valence\n1,"two\nlines, ""quoted""",0.5\n2,short,NaN\n3,x,high\n4,y\n5,z,0.1,more\n,,\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lyrics", T.StringType()), T.StructField("valence", T.DoubleType())])
    good, bad = SG.read_song_csv_checked(spark, tmp_dir, schema)
    rows = [tuple(r) for r in good.collect()]
    assert sorted(rows, key=repr) == sorted([(1, 'two\nlines, "quoted"', 0.5), (2, "short", None), (None, None, None)], key=repr)
    assert sorted(r["line"].split(",")[0] for r in bad.collect()) == ["3", "4", "5"]
    every, none = SG.read_song_csv_checked(spark, tmp_dir)
    assert (every.columns, every.count(), none.count()) == (["id", "lyrics", "valence"], 4, 2)


def test_a_bucketed_store_is_not_shuffled(spark, tmp_dir):
    import os
    from versewise.operators import joins as J
    stored = spark.createDataFrame([(f"A{i}", f" t{i} ", "x") for i in range(50)] + [(None, "t", "x")], "artist string, title string, lyrics string")
    wanted = spark.createDataFrame([(i, f"a{i}", f"T{i}") for i in range(40, 60)], "pos int, artist string, title string")
    table = J.store_tracks(stored, "stored_tracks_test", os.path.join(tmp_dir, "stored"), 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = J.resume_from_store(wanted, table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "LeftAnti" in plan
        assert sorted(r["pos"] for r in out.collect()) == list(range(50, 60))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE stored_tracks_test")
