"""End-to-end jobs on small frames written to a fresh folder."""

import os

from pyspark.sql import functions as F

from versewise.plans import jobs as JB
from versewise.streaming.upsert import read_latest

LYR = "we sing of love and of the night " * 3


def songs_df(spark, n=40):
    rows = [(f"Song {i}", f"Artist {i % 7}", LYR if i % 5 else "short", (i % 10) / 10, ((i * 3) % 10) / 10,
             None, "genius", "", "", "", "", None) for i in range(n)]
    return spark.createDataFrame(rows, "title string, artist string, lyrics string, valence double, energy double, "
                                       "vibe string, sources string, fetch_errors string, spotify_id string, "
                                       "preview_url string, album string, audio_path string")


def test_merge_catalog_job(spark, tmp_dir):
    songs = songs_df(spark).drop("valence", "energy", "spotify_id")
    cat = spark.createDataFrame([(f"t{i}", f"song {i}!", f"ARTIST {i % 7}", 0.5, 0.6, 120.0) for i in range(0, 40, 2)]
                                + [("dup", "Song 0", "Artist 0", 0.1, 0.1, 90.0)],
                                "track_id string, track_name string, track_artist string, valence double, energy double, "
                                "tempo double")
    songs.write.parquet(os.path.join(tmp_dir, "songs"))
    cat.coalesce(1).write.parquet(os.path.join(tmp_dir, "cat"))
    s = JB.merge_catalog_job(spark, os.path.join(tmp_dir, "songs"), os.path.join(tmp_dir, "cat"),
                             os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "summary"))
    assert s["kaggle_unique_tracks"] == 20 and s["input_rows"] == 40 and s["matched_with_features"] == 20
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert out.count() == s["output_rows"] == 16    # even ids with usable lyrics (i % 5 != 0)
    assert out.filter("spotify_id = 'dup'").count() == 0     # first catalog row per key wins


def test_clean_job(spark, tmp_dir):
    df = songs_df(spark).withColumn("spotify_id", F.when(F.col("valence") > 0.5, F.lit("sp")).otherwise(F.lit("")))
    df.write.parquet(os.path.join(tmp_dir, "in"))
    s = JB.clean_job(spark, os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "sum"))
    assert s["input_rows"] == 40 and s["rows_with_lyrics"] == 32 and s["output_rows"] == 16


def test_incremental_fetch_resumes(spark, tmp_dir):
    tracks = os.path.join(tmp_dir, "tracks.txt")
    open(tracks, "w").write("A - x\nB - y\n# skip\nA - x\n")
    lyr = spark.createDataFrame([("a", "x", "la")], "artist_key string, title_key string, lyrics_found string")
    table = os.path.join(tmp_dir, "table")
    s1 = JB.incremental_fetch_job(spark, tracks, table, os.path.join(tmp_dir, "s1"), lyr, None, None)
    assert (s1["tracks_in_list"], s1["fetched_this_run"], s1["total_in_csv"]) == (3, 3, 2)
    open(tracks, "a").write("C|z\n")
    s2 = JB.incremental_fetch_job(spark, tracks, table, os.path.join(tmp_dir, "s2"), lyr, None, None)
    assert (s2["tracks_in_list"], s2["fetched_this_run"], s2["skipped_existing"], s2["total_in_csv"]) == (4, 1, 3, 3)
    got = {(r["artist"], r["sources"]) for r in read_latest(spark, table).collect()}
    assert got == {("A", "genius"), ("B", ""), ("C", "")}


def test_track_list_lookup_and_backfill(spark, tmp_dir):
    table = os.path.join(tmp_dir, "table")
    songs_df(spark, 10).write.parquet(f"{table}/epoch=0")
    tracks = os.path.join(tmp_dir, "tracks.txt")
    open(tracks, "w").write("Artist 1 - Song 1\nArtist 0 - Song 0\nNobody - Nothing\n")
    info = spark.createDataFrame([("artist 1", "song 1", "sp1", 0.9, 0.9)],
                                 "artist_key string, title_key string, info_spotify_id string, "
                                 "info_valence double, info_energy double")
    for c in ["title", "artist", "album", "preview_url"]:
        info = info.withColumn(f"info_{c}", F.lit(None).cast("string"))
    for c in ["tempo", "danceability", "acousticness", "instrumentalness", "speechiness", "liveness"]:
        info = info.withColumn(f"info_{c}", F.lit(None).cast("double"))
    info = info.withColumns({"info_sources": F.array(F.lit("spotify")), "info_errors": F.array().cast("array<string>")})
    s = JB.track_list_lookup_job(spark, tracks, table, info, os.path.join(tmp_dir, "sum"))
    assert (s["tracks_requested"], s["processed"], s["spotify_matches"], s["skipped_existing"], s["not_in_csv"]) \
        == (3, 1, 1, 1, 1)
    assert (s["rows_total"], s["with_music_before"], s["with_music_after"]) == (10, 0, 1)
    row = read_latest(spark, table).filter("title = 'Song 1'").first()
    assert row["spotify_id"] == "sp1" and row["vibe"] == "energetic" and row["sources"] == "genius|spotify"
    lt = spark.createDataFrame([("artist 0", "song 0", LYR, "http://g")],
                               "artist_key string, title_key string, new_lyrics string, new_url string")
    b = JB.backfill_job(spark, table, lt, os.path.join(tmp_dir, "b"))
    assert b["fetched"] == 1 and b["total_rows"] == 10


def test_discovery_job(spark, tmp_dir):
    rows = [(f"id{i}", f"t{i}", f"Art{i % 3}", "KR", "", LYR if i % 4 else "", None, None, ["happy"] if i % 2 else [])
            for i in range(30)]
    cands = spark.createDataFrame(rows, "spotify_id string, title string, artist string, market string, "
                                        "genre_hint string, lyrics string, valence double, energy double, "
                                        "lastfm_tags array<string>")
    s = JB.discovery_job(spark, cands, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "sum"),
                         count=5, pool_size=30, max_per_artist=2, seed=1)
    assert s["tracks_saved"] == 5 and s["unique_artists"] == 3 and s["pool_size"] == 30
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert set(r["label_source"] for r in out.collect()) <= {"lastfm", "market_estimate"}


def test_train_evaluate_job(spark, tmp_dir):
    vibes = ["chill", "happy", "dark"]
    rows = [(i, f"t{i}", f"a{i}", f"{'love ' * (i % 5)} we sing along the night {i}", vibes[i % 3],
             0.2 + (i % 3) * 0.3, 0.3 + (i % 4) * 0.1, 100.0 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, artist string, lyrics string, vibe string, "
                                     "valence double, energy double, tempo double")
    cfg = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "random_state": 1, "parallelism": 3}
    out = JB.train_evaluate_job(spark, df, os.path.join(tmp_dir, "m"), train_size=45, cfg=cfg)
    assert out["train_songs"] == 45 and out["test_songs"] == 15
    assert 0.0 <= out["vibe_accuracy_full"] <= 1.0 and "valence_mae_lyrics_only" in out
    preds = spark.read.parquet(os.path.join(tmp_dir, "m", "test_predictions"))
    assert preds.filter("variant = 'full'").count() == 15
    for name, least in (("split", 60), ("features", 60), ("class_report_lyrics_only", 3), ("metric_bars", 6), ("actual_vs_predicted", 1)):
        assert spark.read.parquet(os.path.join(tmp_dir, "m", name)).count() >= least
    assert "tempo_mae_full" in out


def test_train_job_reports_held_out_rows_and_its_models_score(spark, tmp_dir):
    from versewise.operators import features as FT
    from versewise.operators import model as MD
    rows = [(i, f"{'love ' * (i % 5)} we sing along the night {i}", (i % 10) / 10, ((i * 3) % 10) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "track_id long, lyrics string, valence double, energy double")
    src = os.path.join(tmp_dir, "songs")
    df.coalesce(1).write.option("header", True).csv(src)
    cfg = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "random_state": 1, "parallelism": 3}
    out = JB.train_job(spark, src, os.path.join(tmp_dir, "m"), cfg, lexicon={"love": 3.0})
    assert out["samples"] == 60 and out["models"] == ["energy", "valence", "vibe"]
    assert 0 <= out["vibe_accuracy"] <= 1 and out["valence_mae"] < 1
    models, meta = MD.load_models(os.path.join(tmp_dir, "m"))
    songs = spark.createDataFrame([(1, "we love the night"), (2, "sing")], "id long, lyrics string")
    feats = FT.feature_table(songs, "id", "lyrics", lexicon={"love": 3.0})
    scored = MD.score(feats, models, meta["feature_columns"]).collect()
    assert len(scored) == 2 and all(r["vibe_out"] for r in scored)


def test_enrich_job(spark, tmp_dir):
    table = os.path.join(tmp_dir, "table")
    songs_df(spark, 10).write.parquet(f"{table}/epoch=0")
    info = spark.createDataFrame([("artist 1", "song 1", "sp1", 0.9, 0.9)],
                                 "artist_key string, title_key string, info_spotify_id string, info_valence double, info_energy double")
    for c in ["title", "artist", "album", "preview_url"]:
        info = info.withColumn(f"info_{c}", F.lit(None).cast("string"))
    for c in ["tempo", "danceability", "acousticness", "instrumentalness", "speechiness", "liveness"]:
        info = info.withColumn(f"info_{c}", F.lit(None).cast("double"))
    info = info.withColumns({"info_sources": F.array(F.lit("spotify")), "info_errors": F.array().cast("array<string>")})
    s = JB.enrich_job(spark, table, info, os.path.join(tmp_dir, "sum"))
    assert (s["rows_total"], s["spotify_before"], s["spotify_after"]) == (10, 0, 1)
    assert read_latest(spark, table).filter("spotify_id = 'sp1'").count() == 1


def test_training_parses_its_csv_once(spark, tmp_dir, monkeypatch):
    import os

    from versewise.plans import jobs
    path, seen = os.path.join(tmp_dir, "songs"), []
    spark.createDataFrame([("1", "la la", "0.5", "0.5")], "track_id string, lyrics string, valence string, energy string").write.csv(path, header=True)

    def split(df, *_, **__):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(jobs.SM, "stratified_split", split)
    try:
        jobs.train_job(spark, path, os.path.join(tmp_dir, "m"))
    except StopIteration:
        pass
    assert "parquet" in seen[0] and "csv" not in seen[0].lower().replace(tmp_dir.lower(), "")
