"""The composed jobs (P1-P7, M6-M8) run on files made from the driver tables; the
tables each job leaves are compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.operators import joins as J
from versewise.plans import jobs as JB
from versewise.plans import sqltext as S
from versewise.functions import labels as L
from versewise.plans.queries import REGISTRY, marked_text, query
from versewise.plans.queries_joins import _NEED_SQL, _info, _out, _song_rows, _songs_from_part
from versewise.plans.queries_labels import ACCEPT_N, ACCEPT_SQL, PER_ARTIST, POOL_N, SEED
from versewise.plans.queries_models import _test_ids_sql
from versewise.schema import GENRE_ESTIMATES, VIBES
from versewise.session import scratch_path
from versewise.sources import songs as SG
from versewise.sources.tables import catalog_from_part, songs_from_documents, table
from versewise.streaming.upsert import read_latest


GENRE = {g: (v, e) for g, v, e in GENRE_ESTIMATES}


def _sql(name: str) -> str:
    return REGISTRY[name][1]


def _stored(spark, sf) -> str:
    path = scratch_path(spark, "songs-table")
    _song_rows(spark, sf).write.parquet(f"{path}/epoch=0")
    return path


@query("job_merge", _sql("merge_filter"))
def job_merge(spark, sf):
    """Songs and catalog from files, merged, filtered and written. The
    catalog's files are in its order, which decides among equal keys."""
    songs, cat, out = (scratch_path(spark, n) for n in ("songs", "catalog", "merged"))
    _songs_from_part(spark, sf).write.parquet(songs)
    catalog_from_part(spark, sf).orderBy("pos").drop("pos").write.parquet(cat)
    JB.merge_catalog_job(spark, songs, cat, out, scratch_path(spark, "summary"))
    return spark.read.parquet(out).select("song_id", "spotify_id", "vibe")


@query("job_clean", _sql("complete_rows"))
def job_clean(spark, sf):
    """Complete rows of a song table."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("spotify_id"),
                                            F.col("quality").cast("double").alias("valence"), F.col("toxic").cast("double").alias("energy"))
    songs = songs_from_documents(spark, sf).join(lab, "id", "left").withColumns({
        "title": F.col("id").cast("string"),
        "preview_url": F.when(F.col("artist").endswith("1"), F.lit("http://p")).otherwise(F.lit(""))})
    path, out = scratch_path(spark, "songs"), scratch_path(spark, "clean")
    songs.write.parquet(path)
    JB.clean_job(spark, path, out, scratch_path(spark, "summary"))
    return spark.read.parquet(out).select(F.col("id").alias("doc_id"), F.col("market").alias("lang"))


@query("job_enrich", f"SELECT * EXCLUDE (enriched) FROM ({_sql('enrich_needed')})")
def job_enrich(spark, sf):
    """The next version of a song table, enriched where needed."""
    path = _stored(spark, sf)
    JB.enrich_job(spark, path, _info(spark, sf).drop("s_suppkey"), scratch_path(spark, "summary"))
    return _out(read_latest(spark, path))


@query("job_fetch", f"""
WITH t AS (SELECT c_custkey, {S.strip('c_mktsegment')} AS artist, {S.strip('c_name')} AS title FROM customer)
SELECT artist, title, CASE WHEN s_suppkey IS NOT NULL THEN 'genius' ELSE '' END AS sources,
       CASE WHEN s_suppkey IS NOT NULL THEN '' ELSE 'Genius: no match for ' || artist || ' - ' || title END AS fetch_errors
FROM t LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def job_fetch(spark, sf):
    """P4 in two runs: half of a track list first, then all of it; what is
    stored isn't asked for again."""
    c = table(spark, sf, "customer")
    lines = c.select(F.concat_ws(" - ", "c_mktsegment", "c_name").alias("value"), "c_custkey")
    s = table(spark, sf, "supplier")
    lyrics = J.with_track_key(s.join(c, s.s_suppkey == c.c_custkey), "c_mktsegment", "c_name").select(
        "artist_key", "title_key", F.col("s_name").alias("lyrics_found"))
    path = scratch_path(spark, "fetched")
    for part in (lines.filter("c_custkey % 2 = 0"), lines):
        tracks = scratch_path(spark, "tracks")
        part.select("value").write.text(tracks)
        JB.incremental_fetch_job(spark, tracks, path, scratch_path(spark, "summary"), lyrics, None, None)
    return read_latest(spark, path).select("artist", "title", "sources", "fetch_errors")


@query("job_backfill", f"SELECT * EXCLUDE (backfilled) FROM ({_sql('backfill')})")
def job_backfill(spark, sf):
    """The next version of a song table with lyrics filled in."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    lt = J.with_track_key(s.join(c, s.s_suppkey == c.c_custkey), "c_mktsegment", "c_name").select(
        "artist_key", "title_key",
        F.when(F.col("s_suppkey") % 2 == 0, F.repeat(F.concat(F.col("s_name"), F.lit(" ")), 4)).alias("new_lyrics"),
        F.concat(F.lit("http://g/"), F.col("s_suppkey").cast("string")).alias("new_url"))
    path = _stored(spark, sf)
    JB.backfill_job(spark, path, lt, scratch_path(spark, "summary"))
    return read_latest(spark, path).select("c_custkey", F.length("lyrics").alias("lyrics_len"), "genius_url", "sources")


@query("job_lookup", f"SELECT * EXCLUDE (enriched) FROM ({_sql('enrich_needed').replace(_NEED_SQL, f'({_NEED_SQL} AND r.c_custkey % 2 = 0)')})")
def job_lookup(spark, sf):
    """P5: a track list that names every other stored song, and some that
    aren't stored, looked up; those without music data take what was found."""
    path, tracks = _stored(spark, sf), scratch_path(spark, "tracks")
    c = table(spark, sf, "customer")
    lines = c.filter("c_custkey % 2 = 0").select(F.concat_ws(" - ", "c_mktsegment", "c_name").alias("value"))
    lines.unionByName(c.filter("c_custkey % 5 = 0").select(F.concat_ws("|", "c_name", "c_mktsegment").alias("value"))).write.text(tracks)
    JB.track_list_lookup_job(spark, tracks, path, _info(spark, sf).drop("s_suppkey"), scratch_path(spark, "summary"))
    return _out(read_latest(spark, path))


@query("job_discover", f"""
SELECT event_id, pool_pos, CASE WHEN event_id % 2 = 0 THEN 'spotify' ELSE 'market_estimate' END AS label_source,
       CASE WHEN event_id % 2 = 0 THEN {S.nearest_vibe('0.9::DOUBLE', '0.1::DOUBLE')} ELSE {S.nearest_vibe(f"{GENRE['pop'][0]}::DOUBLE", f"{GENRE['pop'][1]}::DOUBLE")} END AS vibe
FROM ({ACCEPT_SQL})
""")
def job_discover(spark, sf):
    """Events as candidates; those worth more than 5 have lyrics, every
    other one labels of its own; at most two a user, until enough are accepted."""
    own = F.col("event_id") % 2 == 0
    cands = table(spark, sf, "events").select(
        "event_id", F.col("event_id").cast("string").alias("spotify_id"), F.col("event_type").alias("title"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("artist"), F.lit("??").alias("market"), F.lit("").alias("genre_hint"),
        F.when(F.col("value") > 5, F.repeat(F.lit("la "), 20)).otherwise(F.lit("")).alias("lyrics"),
        F.when(own, F.lit(0.9)).alias("valence"), F.when(own, F.lit(0.1)).alias("energy"), F.array().cast("array<string>").alias("lastfm_tags"))
    out = scratch_path(spark, "discovered")
    JB.discovery_job(spark, cands, out, scratch_path(spark, "summary"), ACCEPT_N, POOL_N, PER_ARTIST, seed=SEED)
    return spark.read.parquet(out).select("event_id", F.col("pool_pos").cast("bigint").alias("pool_pos"), "label_source", "vibe")


_SMALL = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "random_state": 1}


def _labelled(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("t"), "doc_id").alias("title"), F.col("source").alias("artist"), marked_text().alias("lyrics"),
                    (F.col("doc_id") % 10 / 10).alias("valence"), (F.col("doc_id") % 7 / 7).alias("energy")) \
        .withColumn("vibe", L.nearest_anchor("valence", "energy"))


_LABELLED_SQL = (f"SELECT doc_id AS id, {S.nearest_vibe('v', 'e')} AS vibe FROM "
                 "(SELECT doc_id, (doc_id % 10 / 10)::DOUBLE AS v, (doc_id % 7 / 7)::DOUBLE AS e FROM documents)")


@query("job_train_eval", f"""
SELECT t.id, 'full' AS variant, d.vibe, true AS in_range, true AS known_vibe FROM ({_test_ids_sql(_LABELLED_SQL)}) t JOIN ({_LABELLED_SQL}) d USING (id)
""")
def job_train_eval(spark, sf):
    """M6: an exact split, models of three targets and the predictions of the
    held-out fifth, as the job writes them."""
    d = _labelled(spark, sf)
    n = d.count()
    out = scratch_path(spark, "models")
    JB.train_evaluate_job(spark, d, out, train_size=n - (n * 20 + 99) // 100, include_spotify=False, cfg=_SMALL)
    p = spark.read.parquet(f"{out}/test_predictions")
    return p.select("id", "variant", "vibe", (F.col("pred_valence").between(0, 1) & F.col("pred_energy").between(0, 1)).alias("in_range"),
                    F.col("pred_vibe").isin(*VIBES).alias("known_vibe"))


@query("job_train", """
SELECT count(*) AS samples, 'energy|valence|vibe' AS models, ((count(*) * 20 + 99) // 100)::BIGINT AS held_out, true AS reported FROM documents
""")
def job_train(spark, sf):
    """M7, M8: a labelled CSV, models of every target, the report on the rows
    held out."""
    path, out = scratch_path(spark, "songs-csv"), scratch_path(spark, "models")
    SG.write_table(_labelled(spark, sf).select(F.col("id").alias("track_id"), "lyrics", "valence", "energy", "vibe"), path, "csv")
    got = JB.train_job(spark, path, out, _SMALL)
    support = spark.read.parquet(f"{out}/class_report").filter(F.col("label").isin(*VIBES))
    return support.agg(F.sum("support").cast("long").alias("held_out")).select(
        F.lit(got["samples"]).cast("long").alias("samples"), F.lit("|".join(got["models"])).alias("models"), "held_out",
        F.lit({"valence_mae", "energy_mae", "vibe_accuracy"} <= set(got)).alias("reported"))
