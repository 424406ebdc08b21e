"""Composed jobs (P1-P7, M6-M8): the end-to-end runs of the song pipeline,
each a chain of the operators above that reads tables, writes tables and a
one-row JSON summary.

Counters are gathered with ``Observation`` during the write (one pass over
the data instead of a second counting job). Tables that are read and then
rewritten are written to a new ``epoch=`` version (never in place), so a job
that dies half way leaves the last good version readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.operators import dedupe as D
from versewise.operators import features as FT
from versewise.operators import joins as J
from versewise.operators import lookup as LK
from versewise.operators import metrics as M
from versewise.operators import model as MD
from versewise.operators import sampling as SM
from versewise.schema import SPOTIFY_FEATURES, feature_cols_for_target
from versewise.session import checkpoint_dir, stage_table
from versewise.sources import songs as SG
from versewise.streaming.upsert import _versions, read_latest


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return SG.read_song_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)


def _file_order() -> Column:
    """Order of the rows of files as they were written, whatever splits the
    scan is cut into: file, start of the split, row within it."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def _next_version(spark: SparkSession, table_dir: str) -> str:
    vs = _versions(spark, table_dir)
    return f"{table_dir}/epoch={(vs[-1] + 1) if vs else 0}"


def _observe(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    obs = Observation(name)
    return df.observe(obs, *[c.alias(k) for k, c in metrics.items()]), obs


def merge_catalog_job(spark: SparkSession, songs_path: str, catalog_path: str, out_path: str,
                      summary_path: str, clean_only: bool = True, fmt: str = "parquet") -> dict:
    """Songs + catalog (first row per normalised key) -> left join ->
    labels -> optional F4 filter -> table + summary (A2)."""
    songs = _read(spark, songs_path, fmt)
    catalog = _read(spark, catalog_path, fmt).withColumn("_pos", _file_order())
    prep = J.prepare_catalog(catalog, "_pos")
    merged = J.merge_with_catalog(songs, prep)
    keep = J.merge_keep_predicate()
    merged, obs = _observe(merged, "merge", input_rows=F.count(F.lit(1)),
                           matched_with_features=F.count_if(F.col("label_source") == "kaggle"),
                           output_rows=F.count_if(keep))
    out = merged.filter(keep) if clean_only else merged
    SG.write_table(out, out_path)
    summary = {"kaggle_unique_tracks": prep.count(), **obs.get, "clean_only": clean_only}
    if not clean_only:
        summary["output_rows"] = summary["input_rows"]
    SG.write_summary(spark, spark.createDataFrame([summary]), summary_path)
    return summary


def clean_job(spark: SparkSession, in_path: str, out_path: str, summary_path: str,
              require_audio_file: bool = False, audio_listing: DataFrame | None = None,
              info: DataFrame | None = None, fmt: str = "parquet") -> dict:
    """Counters (A1) -> optional re-enrichment (J5) -> complete rows."""
    df = _read(spark, in_path, fmt)
    audio = None
    if audio_listing is not None:
        df = J.attach_file_presence(df, audio_listing)
        audio = F.col("audio_exists")
    before = M.quality_counters(df, J.has_music_data(df, require_audio_file, audio)).first().asDict()
    working = J.enrich_rows(df, info) if info is not None else df
    cleaned, obs = _observe(J.filter_complete_rows(working, require_audio_file, audio), "clean",
                            output_rows=F.count(F.lit(1)))
    SG.write_table(cleaned, out_path)
    summary = {"input_rows": before["input_rows"], "rows_with_lyrics": before["rows_with_lyrics"],
               "rows_with_music_data_before_clean": before["rows_with_music_data"], **obs.get,
               "re_enriched_spotify": info is not None, "require_audio_file": require_audio_file}
    SG.write_summary(spark, spark.createDataFrame([summary]), summary_path)
    return summary


def enrich_job(spark: SparkSession, table_dir: str, info: DataFrame, summary_path: str) -> dict:
    """The latest version of a song table, enriched (J5/J4), written as
    the next version; before/after counters."""
    df = read_latest(spark, table_dir)
    before = M.quality_counters(df, J.has_music_data(df)).first().asDict()
    out = J.enrich_rows(df, info)
    out, obs = _observe(out, "enrich", rows_total=F.count(F.lit(1)),
                        spotify_after=F.count_if(J.has_music_data(out)))
    SG.write_table(out, _next_version(spark, table_dir) + "/")
    summary = {"rows_total": before["input_rows"], "rows_with_lyrics": before["rows_with_lyrics"],
               "spotify_before": before["rows_with_music_data"], "spotify_after": obs.get["spotify_after"]}
    SG.write_summary(spark, spark.createDataFrame([summary]), summary_path)
    return summary


def incremental_fetch_job(spark: SparkSession, tracks_path: str, table_dir: str, summary_path: str,
                          lyrics: DataFrame | None, features: DataFrame | None, tags: DataFrame | None) -> dict:
    """Track list (S4) -> tracks not stored yet (J2) -> provider lookups
    (J13) -> keep-last upsert into the next table version (S7); A14."""
    tracks = SG.read_track_list(spark, tracks_path)
    existing = read_latest(spark, table_dir)
    pending = J.resume_pending(tracks, existing) if existing is not None else tracks
    fetched = J.multi_lookup(pending, lyrics, features, tags)
    if existing is not None:
        stored = existing.withColumn("pos", F.lit(-1).cast("long"))
        merged = D.upsert_keep_last(stored, fetched, ["artist", "title"], "pos")
    else:
        merged = D.keep_last(fetched, ["artist", "title"], ["pos"])
    merged = merged.drop("file", "pos")
    SG.write_table(merged, _next_version(spark, table_dir) + "/")
    tagged = (J.with_track_key(tracks).select(F.lit("w").alias("f"), "artist_key", "title_key")
              .unionByName(J.with_track_key(pending).select(F.lit("p").alias("f"), "artist_key", "title_key")))
    counts = tagged.agg(F.count_if(F.col("f") == "w").alias("tracks_in_list"),
                        F.count_if(F.col("f") == "p").alias("fetched_this_run")).first().asDict()
    total = J.existing_keys(read_latest(spark, table_dir)).count()
    summary = {**counts, "skipped_existing": counts["tracks_in_list"] - counts["fetched_this_run"],
               "total_in_csv": total}
    SG.write_summary(spark, spark.createDataFrame([summary]), summary_path)
    return summary


def track_list_lookup_job(spark: SparkSession, tracks_path: str, table_dir: str, info: DataFrame,
                          summary_path: str) -> dict:
    """P5: outcome per listed track (J3) against the latest table version;
    processed rows take the looked-up info (J4) in the next version."""
    tracks = SG.read_track_list(spark, tracks_path)
    table = read_latest(spark, table_dir).withColumn("_pos", _file_order())
    keyed_info = info.select("artist_key", "title_key", F.col("info_spotify_id").alias("spotify_id"))
    outcomes = J.lookup_outcomes(tracks, table, "_pos", keyed_info)
    counts = outcomes.agg(F.count(F.lit(1)).alias("tracks_requested"),
                          F.count_if(F.col("outcome") == "processed").alias("processed"),
                          F.count_if(F.col("matched")).alias("spotify_matches"),
                          F.count_if(F.col("outcome") == "skipped").alias("skipped_existing"),
                          F.count_if(F.col("outcome") == "not_in_csv").alias("not_in_csv")).first().asDict()
    todo = outcomes.filter(F.col("outcome") == "processed").select("artist_key", "title_key").distinct()
    keyed = J.with_track_key(table)
    need = keyed.join(todo, ["artist_key", "title_key"], "left_semi")
    rest = keyed.join(todo, ["artist_key", "title_key"], "left_anti")
    inf = D.keep_first(info, ["artist_key", "title_key"], [F.col("info_spotify_id").isNull(), "info_spotify_id"])
    updated = J.overlay(need.join(inf, ["artist_key", "title_key"], "left")).unionByName(rest, allowMissingColumns=True)
    before = M.quality_counters(table, J.has_music_data(table)).first()
    updated, obs = _observe(updated.drop("artist_key", "title_key", "_pos"), "lookup", rows_total=F.count(F.lit(1)),
                            with_music_after=F.count_if(J.has_music_data(updated)))
    SG.write_table(updated, _next_version(spark, table_dir) + "/")
    counts |= {"with_music_before": before["rows_with_music_data"], **obs.get}
    SG.write_summary(spark, spark.createDataFrame([counts]), summary_path)
    return counts


def discovery_job(spark: SparkSession, candidates: DataFrame, out_path: str, summary_path: str,
                  count: int, pool_size: int, max_per_artist: int = 2,
                  require_lyrics: bool = True, seed: int = 0) -> dict:
    """Candidate table (spotify_id, title, artist, market, genre_hint,
    lyrics, valence, energy, lastfm_tags) -> seeded pool of ``pool_size``
    (O1/O2) -> label cascade (J11) -> acceptance of ``count`` with per-artist
    cap and stop (W3/W4) -> A11. Both sizes are the sampling's own and the
    caller's to name."""
    pool = SM.seeded_pool(candidates, "spotify_id", seed, pool_size)
    looked = LK.label_cascade(pool).withColumn("has_lyrics", X.has_usable_lyrics("lyrics"))
    ok = F.col("valence").isNotNull() & F.col("energy").isNotNull()
    if require_lyrics:
        ok = ok & F.col("has_lyrics")
    accepted = SM.accept_until(looked, ok, "artist", "pool_pos", count, max_per_artist)
    SG.write_table(accepted, out_path)
    summary = SM.discover_summary(pool, spark.read.parquet(out_path), "pool_pos", count).first().asDict()
    summary["require_lyrics"] = require_lyrics
    SG.write_summary(spark, spark.createDataFrame([summary]), summary_path)
    return summary


def backfill_job(spark: SparkSession, table_dir: str, lyrics_table: DataFrame, summary_path: str) -> dict:
    """Lyrics backfill (J7) into the next version, with counters."""
    df = read_latest(spark, table_dir)
    out, obs = _observe(J.backfill_lyrics(df, lyrics_table), "backfill", total_rows=F.count(F.lit(1)),
                        fetched=F.count_if("backfilled"))
    SG.write_table(out.drop("backfilled"), _next_version(spark, table_dir) + "/")
    summary = dict(obs.get)
    summary["skipped"] = summary["total_rows"] - summary["fetched"]
    SG.write_summary(spark, spark.createDataFrame([summary]), summary_path)
    return summary


def _with_id(df: DataFrame) -> DataFrame:
    """An ``id`` made of the row's content; repeated rows are numbered, so ids
    are unique and the same however the files are read."""
    content = F.sha2(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns)])), 256)
    w = Window.partitionBy("_content").orderBy("_content")
    return (df.withColumn("_content", content)
            .withColumn("id", F.concat_ws("-", "_content", F.row_number().over(w))).drop("_content"))


def _variants(test: DataFrame, models: dict, cols: dict, with_catalog: bool) -> DataFrame:
    """Predictions of the test rows with all features and, where catalog
    features were used, with those set to zero (F11)."""
    full = MD.score(test, models, cols, catalog_used=with_catalog).withColumn("variant", F.lit("full"))
    if not with_catalog:
        return full
    zeroed = MD.score(FT.zero_columns(test, SPOTIFY_FEATURES), models, cols).withColumn("variant", F.lit("lyrics_only"))
    return full.unionByName(zeroed)


def evaluation_tables(preds: DataFrame, targets: list[str]) -> dict[str, DataFrame]:
    """A4-A7, A10 of predictions (``<target>``, ``pred_<target>``, vibe,
    pred_vibe, variant): regression metrics, accuracy, class reports of both
    variants, confusion, and chart data: actual against predicted on a grid
    (bounded, however many rows) and the metrics as bars."""
    stacked = preds.select("variant", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), F.col(f"pred_{t}").alias("p")) for t in targets])))
    stacked = stacked.filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    reg = M.regression_metrics(stacked, "y", "p", ["variant", "target"])
    acc = M.accuracy(preds, "vibe", "pred_vibe", ["variant"])
    full = preds.filter(F.col("variant") == "full")
    bars = (reg.filter("target != 'tempo'").select("variant", F.concat("target", F.lit("_mae")).alias("metric"), F.col("mae").alias("value"))
            .unionByName(acc.select("variant", F.lit("vibe_accuracy").alias("metric"), F.col("accuracy").alias("value"))))
    out = {"regression": reg, "accuracy": acc, "class_report": M.class_report(full, "vibe", "pred_vibe"),
           "confusion": M.confusion(full, "vibe", "pred_vibe"), "metric_bars": bars,
           "actual_vs_predicted": M.actual_vs_predicted(stacked.filter("target != 'tempo'"), "y", "p", ["variant", "target"])}
    other = preds.filter(F.col("variant") == "lyrics_only")
    return out | {"class_report_lyrics_only": M.class_report(other, "vibe", "pred_vibe")}


def train_evaluate_job(spark: SparkSession, data: DataFrame, model_dir: str, train_size: int | None = None,
                       test_size: int | None = None, include_spotify: bool = True, seed: int = 42,
                       cfg: dict | None = None, lexicon=None, profile: str = "default",
                       audio: DataFrame | None = None, leak_guard: bool = False, validation_pct: int = 0) -> dict:
    """M6/M7: labelled songs -> exact split (W6) -> feature table (X25) ->
    per-target models (M1-M4) -> predictions with and without the catalog
    features (F11) -> metric tables (A4-A8, A10), split and feature tables
    (S14) and saved models (S15)."""
    checkpoint_dir(spark)
    df = SG.alias_columns(data)
    SG.require_columns(df, ["lyrics", "valence", "energy", "vibe", "artist", "title"])
    df = SG.drop_unlabelled(df, ("valence", "energy", "vibe"))
    if include_spotify and "tempo" not in df.columns:
        raise ValueError("training with catalog features needs their columns, tempo among them")
    if "id" not in df.columns:
        df = _with_id(df)
    n = df.count()
    if train_size is None:
        train_size = min(100, n - 10)     # M7
    if test_size is None:
        test_size = n - train_size
    if train_size + test_size != n:
        raise ValueError(f"{train_size} training and {test_size} test rows don't add up to the {n} labelled ones")
    split = SM.stratified_split(df, "vibe", "id", test_n=test_size, seed=seed)
    SG.write_table(split, f"{model_dir}/split", partition_by=["split"])
    split = spark.read.parquet(f"{model_dir}/split")
    feats = FT.feature_table(split, "id", "lyrics", audio=audio, include_catalog=include_spotify, lexicon=lexicon, keep=["split"])
    SG.write_table(feats, f"{model_dir}/features", partition_by=["split"])
    feats = spark.read.parquet(f"{model_dir}/features")   # reused by the fits and scorings
    cols = {t: feature_cols_for_target(t, include_spotify, leak_guard) for t in ("valence", "energy", "tempo", "vibe")}
    if "tempo" not in feats.columns:
        cols.pop("tempo")
    train, test = feats.filter(F.col("split") == "train"), feats.filter(F.col("split") == "test")
    models = MD.train_models(train, cols, cfg, profile, validation_pct)
    variants = _variants(test, models, cols, include_spotify)
    targets = ["valence", "energy", *(["tempo"] if "tempo" in models else [])]
    preds = variants.select("id", "variant", "vibe", *targets, *[F.col(f"raw_{t}").alias(f"pred_{t}") for t in targets],
                            F.col("vibe_out").alias("pred_vibe"))
    SG.write_table(preds, f"{model_dir}/test_predictions")
    preds = spark.read.parquet(f"{model_dir}/test_predictions")
    tables = evaluation_tables(preds, targets)
    for name, t in tables.items():
        SG.write_table(t, f"{model_dir}/{name}")
    MD.save_models(models, model_dir, {"feature_columns": cols, "include_spotify_features": include_spotify,
                                      "model_config_used": MD.model_config(cfg, profile), "rounds": MD.rounds_used(models)})
    out = {"train_songs": train_size, "test_songs": test_size} | {f"{t}_rounds": n for t, n in MD.rounds_used(models).items()}
    for r in tables["regression"].collect():
        out[f"{r['target']}_mae_{r['variant']}"] = r["mae"]
        out[f"{r['target']}_r2_{r['variant']}"] = r["r2"]
    for r in tables["accuracy"].collect():
        out[f"vibe_accuracy_{r['variant']}"] = r["accuracy"]
    return out


def train_job(spark: SparkSession, csv_path: str, model_dir: str, cfg: dict | None = None, lexicon=None,
              profile: str = "default", test_pct: int = 20, seed: int = 42, validation_pct: int = 0) -> dict:
    """M8: a labelled CSV -> feature table -> models for every target with
    enough labels (M4), fitted on 80 % and reported on the held-out rest ->
    saved models (S15)."""
    checkpoint_dir(spark)
    df = SG.read_song_csv(spark, csv_path)
    SG.require_columns(df, ["lyrics"])
    df = SG.alias_columns(df)
    df = df.withColumnRenamed("track_id", "id") if "track_id" in df.columns else _with_id(df)
    for c in ("valence", "energy", "tempo"):
        if c in df.columns:
            df = df.withColumn(c, F.expr(f"try_cast({c} AS DOUBLE)"))
    if "vibe" not in df.columns:
        df = df.withColumn("vibe", F.lit(None).cast("string"))
    # the split reads its rows several times: the CSV is parsed once
    split = SM.stratified_split(stage_table(df, "labelled"), "vibe", "id", test_pct=test_pct, seed=seed)
    feats = FT.feature_table(split, "id", "lyrics", lexicon=lexicon, keep=["split"])
    SG.write_table(feats, f"{model_dir}/features", partition_by=["split"])
    feats = spark.read.parquet(f"{model_dir}/features")
    cols = {t: feature_cols_for_target(t) for t in ("valence", "energy", "vibe") if t == "vibe" or t in feats.columns}
    models = MD.train_models(feats.filter("split = 'train'"), cols, cfg, profile, validation_pct)
    MD.save_models(models, model_dir, {"feature_columns": cols, "model_config_used": MD.model_config(cfg, profile),
                                      "rounds": MD.rounds_used(models)})
    test = feats.filter("split = 'test'")
    out = {"samples": feats.count(), "models": sorted(models)}
    scored = MD.score(test, models, cols)
    for t in ("valence", "energy"):
        if t in models:
            got = M.regression_metrics(scored.filter(F.col(t).isNotNull()), t, f"raw_{t}").first()
            out[f"{t}_mae"] = got["mae"]
    if "vibe" in models:
        # where vibes were inferred for training they are for the test rows too
        truth = F.col("vibe")
        if {"valence", "energy"} <= set(feats.columns):
            truth = F.coalesce(truth, L.nearest_anchor("valence", "energy"))
        judged = scored.withColumn("vibe", truth).filter(F.col("vibe").isNotNull())
        out["vibe_accuracy"] = M.accuracy(judged, "vibe", "vibe_out").first()["accuracy"]
        SG.write_table(M.class_report(judged, "vibe", "vibe_out"), f"{model_dir}/class_report")
    SG.write_summary(spark, spark.createDataFrame([{k: str(v) for k, v in out.items()}]), f"{model_dir}/report")
    return out
