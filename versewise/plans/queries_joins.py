"""Queries for dedupe, upserts and enrichment joins (W1, W2, S7, X8, X9, J1-J7,
J13, F4, F14, A2, A14, U2, X15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.functions import text as X
from versewise.operators import dedupe as D
from versewise.operators import joins as J
from versewise.plans import sqltext as S
from versewise.plans.queries import REGISTRY, query, r6
from versewise.session import scratch_path
from versewise.sources.tables import catalog_from_part, table

# --------------------------------------------------------------------------
# W1, W2, S7
# --------------------------------------------------------------------------


@query("dedupe_first", """
SELECT p_brand, p_name, p_partkey, p_retailprice FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1
""")
def dedupe_first(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_name", "p_partkey", "p_retailprice")
    return D.keep_first(p, ["p_brand", "p_name"], ["p_partkey"])


@query("dedupe_last", """
SELECT p_brand, p_name, p_partkey, p_retailprice FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey DESC) = 1
""")
def dedupe_last(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_name", "p_partkey", "p_retailprice")
    return D.keep_last(p, ["p_brand", "p_name"], ["p_partkey"])


@query("upsert_keep_last", """
WITH u AS (
  SELECT p_brand AS artist, p_name AS title, p_retailprice AS value, 0 AS batch,
         p_partkey AS k1, 0::BIGINT AS k2, 0::BIGINT AS k3, 0::BIGINT AS k4 FROM part
  UNION ALL
  SELECT p.p_brand, p.p_name, l.l_extendedprice, 1, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT artist, title, round(value, 6) AS value, batch FROM u
QUALIFY row_number() OVER (PARTITION BY artist, title ORDER BY batch DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) = 1
""")
def upsert_keep_last(spark, sf):
    """Stored rows = part; the new batch = every lineitem row as a new
    value for its part's (brand, name) key; last row per key wins."""
    part = table(spark, sf, "part")
    old = part.select(F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
                      F.col("p_retailprice").alias("value"),
                      F.struct(F.col("p_partkey").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
                               F.lit(0).cast("bigint").alias("k3"), F.lit(0).cast("bigint").alias("k4")).alias("pos"))
    li = table(spark, sf, "lineitem")
    new = li.join(part.select("p_partkey", "p_brand", "p_name"), li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
        F.col("l_extendedprice").alias("value"),
        F.struct(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("bigint").alias("k2"),
                 F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4")).alias("pos"))
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    out = D.keep_last(both, ["artist", "title"], ["batch", "pos"])
    return out.select("artist", "title", r6(F.col("value")).alias("value"), "batch")


# --------------------------------------------------------------------------
# Merge with the catalog
# --------------------------------------------------------------------------

def _songs_from_part(spark, sf):
    """part re-spelt as a song table: names upper-cased / punctuated / hyphenated
    (or replaced by the type, which the catalog does not know), lyrics of
    repeated names (some too short), an existing vibe on large sizes."""
    p = table(spark, sf, "part")
    title = (F.when(F.col("p_size") % 3 == 0, F.concat(F.upper("p_name"), F.lit("!")))
              .when(F.col("p_size") % 3 == 1, F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
              .otherwise(F.col("p_type")))
    return p.select(F.col("p_partkey").alias("song_id"), title.alias("title"),
                    F.upper(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" #"))).alias("artist"),
                    F.repeat(F.concat(F.col("p_name"), F.lit(" ")), (F.col("p_size") % 6).cast("int")).alias("lyrics"),
                    F.when(F.col("p_size") > 40, F.lit(" chill ")).alias("vibe"),
                    F.lit("old").alias("spotify_id"))


SONGS_FROM_PART_SQL = """
SELECT p_partkey AS song_id,
       CASE WHEN p_size % 3 = 0 THEN upper(p_name) || '!' WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '-')
            ELSE p_type END AS title,
       upper(replace(p_brand, '#', ' #')) AS artist,
       repeat(p_name || ' ', (p_size % 6)::INTEGER) AS lyrics,
       CASE WHEN p_size > 40 THEN ' chill ' END AS vibe
FROM part"""

CATALOG_SQL = f"""
SELECT * EXCLUDE (pos) FROM (
  SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS spotify_id, p_name AS kaggle_track_name,
         p_brand AS kaggle_artist, p_type AS album, (p_retailprice - 900) / 100 AS valence,
         p_size / 50 AS energy, p_size * 4.0::DOUBLE AS tempo, {S.merge_key('p_brand', 'p_name')} AS k
  FROM part)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1"""

MERGED_SQL = f"""
WITH cat AS ({CATALOG_SQL}), songs AS ({SONGS_FROM_PART_SQL})
SELECT s.song_id, s.lyrics, c.spotify_id, c.kaggle_track_name, c.kaggle_artist, c.album,
       c.valence, c.energy, c.tempo,
       CASE WHEN NOT {S.missing('c.spotify_id')} THEN 'kaggle' ELSE '' END AS label_source,
       CASE WHEN NOT {S.missing(S.strip('s.vibe'))} THEN {S.strip('s.vibe')}
            WHEN c.valence IS NOT NULL AND c.energy IS NOT NULL THEN {S.nearest_vibe('c.valence', 'c.energy')}
            ELSE '' END AS vibe
FROM songs s LEFT JOIN cat c ON {S.merge_key('s.artist', 's.title')} = c.k"""


def _merged(spark, sf):
    cat = J.prepare_catalog(catalog_from_part(spark, sf), "pos")
    return cat, J.merge_with_catalog(_songs_from_part(spark, sf), cat)


@query("merge_key_join", f"""
SELECT song_id, spotify_id, kaggle_track_name, kaggle_artist, album, round(valence, 6) AS valence,
       round(energy, 6) AS energy, round(tempo, 6) AS tempo, label_source, vibe
FROM ({MERGED_SQL})
""")
def merge_key_join(spark, sf):
    _, m = _merged(spark, sf)
    return m.select("song_id", "spotify_id", "kaggle_track_name", "kaggle_artist", "album",
                    r6(F.col("valence")).alias("valence"), r6(F.col("energy")).alias("energy"),
                    r6(F.col("tempo")).alias("tempo"), "label_source", "vibe")


@query("merge_filter", f"""
SELECT song_id, spotify_id, vibe FROM ({MERGED_SQL})
WHERE {S.usable('lyrics')} AND NOT {S.missing('spotify_id')} AND valence IS NOT NULL AND energy IS NOT NULL
""")
def merge_filter(spark, sf):
    _, m = _merged(spark, sf)
    return J.filter_lyrics_and_music(m).select("song_id", "spotify_id", "vibe")


@query("merge_summary", f"""
SELECT (SELECT count(*) FROM ({CATALOG_SQL})) AS kaggle_unique_tracks,
       count(*) AS input_rows,
       count(*) FILTER (WHERE {S.usable('lyrics')} AND NOT {S.missing('spotify_id')}
                        AND valence IS NOT NULL AND energy IS NOT NULL) AS output_rows,
       count(*) FILTER (WHERE label_source = 'kaggle') AS matched_with_features
FROM ({MERGED_SQL})
""")
def merge_summary(spark, sf):
    cat, m = _merged(spark, sf)
    return J.merge_summary(cat, m, J.merge_keep_predicate())


# --------------------------------------------------------------------------
# Resume, fetch summary, lookup outcomes
# --------------------------------------------------------------------------

def _wanted(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.col("c_mktsegment").alias("artist"), F.col("c_name").alias("title"))


def _stored(spark, sf):
    """Stored output: customers with an urgent order, names re-spaced and re-cased."""
    c = table(spark, sf, "customer")
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    s = c.join(urgent, c.c_custkey == urgent.o_custkey, "left_semi")
    return s.select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("artist"),
                    F.concat(F.upper("c_name"), F.lit(" ")).alias("title"))


STORED_SQL = """
SELECT ' ' || lower(c_mktsegment) AS artist, upper(c_name) || ' ' AS title FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _tk(a, t):
    return f"lower({S.strip(a)}) AS artist_key, lower({S.strip(t)}) AS title_key"


@query("resume_anti", f"""
SELECT c_custkey, c_mktsegment AS artist, c_name AS title FROM customer w
WHERE NOT EXISTS (SELECT 1 FROM ({STORED_SQL}) s
                  WHERE lower({S.strip('s.artist')}) = lower({S.strip('w.c_mktsegment')})
                    AND lower({S.strip('s.title')}) = lower({S.strip('w.c_name')}))
""")
def resume_anti(spark, sf):
    return J.resume_pending(_wanted(spark, sf), _stored(spark, sf))


@query("resume_bucketed", REGISTRY["resume_anti"][1])
def resume_bucketed(spark, sf):
    """J2 + S5 on a stored table bucketed by track key."""
    path = scratch_path(spark, "stored-tracks")
    return J.resume_from_store(_wanted(spark, sf), J.store_tracks(_stored(spark, sf), "tracks_" + path.rsplit("-", 1)[1], path, 16))


@query("fetch_summary", f"""
WITH w AS (SELECT c_custkey, {_tk('c_mktsegment', 'c_name')} FROM customer),
     e AS (SELECT DISTINCT {_tk('artist', 'title')} FROM ({STORED_SQL})),
     p AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.artist_key = w.artist_key
                                             AND e.title_key = w.title_key)),
     saved AS (SELECT artist_key, title_key FROM e UNION SELECT artist_key, title_key FROM p)
SELECT (SELECT count(*) FROM w) AS tracks_in_list, (SELECT count(*) FROM p) AS fetched_this_run,
       (SELECT count(*) FROM w) - (SELECT count(*) FROM p) AS skipped_existing,
       (SELECT count(*) FROM saved) AS total_in_csv
""")
def fetch_summary(spark, sf):
    """A14 in one aggregation over tagged key rows (no joins of one-row results)."""
    wanted = J.with_track_key(_wanted(spark, sf))
    stored = J.existing_keys(_stored(spark, sf))
    pending = J.with_track_key(J.resume_pending(_wanted(spark, sf), _stored(spark, sf)))
    k = ["artist_key", "title_key"]
    tagged = (wanted.select(F.lit("w").alias("f"), *k)
              .unionByName(pending.select(F.lit("p").alias("f"), *k))
              .unionByName(stored.select(F.lit("s").alias("f"), *k)))
    saved_key = F.when(F.col("f").isin("p", "s"), F.struct(*k))
    return tagged.agg(F.count_if(F.col("f") == "w").alias("tracks_in_list"),
                      F.count_if(F.col("f") == "p").alias("fetched_this_run"),
                      (F.count_if(F.col("f") == "w") - F.count_if(F.col("f") == "p")).alias("skipped_existing"),
                      F.count_distinct(saved_key).alias("total_in_csv"))


def _table_rows(spark, sf):
    """Stored song table for J3: customers with an open order; lyrics long
    enough from nation key 7 on; music data when the balance is high."""
    c = table(spark, sf, "customer")
    open_o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
    s = c.join(open_o, c.c_custkey == open_o.o_custkey, "left_semi")
    rich = F.col("c_acctbal") > 5000
    return s.select(F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("artist"),
                    F.col("c_name").alias("title"),
                    F.repeat(F.lit("la "), (F.col("c_nationkey") * 2).cast("int")).alias("lyrics"),
                    F.when(rich, F.concat(F.lit("sp"), F.col("c_custkey").cast("string"))).alias("spotify_id"),
                    F.when(rich, F.lit(0.5)).alias("valence"), F.when(rich, F.lit(0.5)).alias("energy"))


@query("lookup_outcomes", f"""
WITH st AS (
  SELECT c_custkey AS pos, c_mktsegment AS artist, c_name AS title, repeat('la ', (c_nationkey * 2)::INTEGER) AS lyrics,
         CASE WHEN c_acctbal > 5000 THEN 'sp' || c_custkey END AS spotify_id,
         CASE WHEN c_acctbal > 5000 THEN 0.5 END AS valence, CASE WHEN c_acctbal > 5000 THEN 0.5 END AS energy
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')),
idx AS (
  SELECT {_tk('artist', 'title')}, {S.usable('lyrics')} AS usable,
         (NOT {S.missing('spotify_id')} AND valence IS NOT NULL AND energy IS NOT NULL) AS music
  FROM st WHERE NOT {S.missing('artist')} AND NOT {S.missing('title')}
  QUALIFY row_number() OVER (PARTITION BY lower({S.strip('artist')}), lower({S.strip('title')}) ORDER BY pos DESC) = 1),
info AS (SELECT lower({S.strip('c.c_mktsegment')}) AS artist_key, lower({S.strip('c.c_name')}) AS title_key,
                CASE WHEN s.s_suppkey % 2 = 0 THEN 'sp' || s.s_suppkey END AS found
         FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey)
SELECT w.c_custkey,
       CASE WHEN i.usable IS NULL THEN 'not_in_csv' WHEN NOT i.usable OR (i.music AND i.usable) THEN 'skipped'
            ELSE 'processed' END AS outcome,
       CAST(i.usable IS NOT NULL AND i.usable AND NOT (i.music AND i.usable)
            AND NOT {S.missing('f.found')} AS INTEGER) AS matched
FROM (SELECT c_custkey, {_tk('c_mktsegment', 'c_name')} FROM customer) w
LEFT JOIN idx i ON i.artist_key = w.artist_key AND i.title_key = w.title_key
LEFT JOIN info f ON f.artist_key = w.artist_key AND f.title_key = w.title_key
""")
def lookup_outcomes(spark, sf):
    c = table(spark, sf, "customer")
    sup = table(spark, sf, "supplier")
    info = J.with_track_key(sup.join(c, sup.s_suppkey == c.c_custkey), "c_mktsegment", "c_name").select(
        "artist_key", "title_key",
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("sp"), F.col("s_suppkey").cast("string"))).alias("spotify_id"))
    out = J.lookup_outcomes(_wanted(spark, sf), _table_rows(spark, sf), "pos", info)
    return out.select("c_custkey", "outcome", F.col("matched").cast("int").alias("matched"))


# --------------------------------------------------------------------------
# Overlay, enrichment, backfill, provenance
# --------------------------------------------------------------------------

def _song_rows(spark, sf):
    """customer as stored songs (some with lyrics, some with music data)."""
    c = table(spark, sf, "customer")
    rich = F.col("c_acctbal") > 8000
    return c.select(
        "c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"),
        F.repeat(F.lit("na "), (F.col("c_nationkey") * 2).cast("int")).alias("lyrics"),
        F.lit("").alias("album"),
        F.when(rich, F.concat(F.lit("sp"), F.col("c_custkey").cast("string"))).otherwise(F.lit("")).alias("spotify_id"),
        F.lit("").alias("preview_url"), F.lit("").alias("genius_url"),
        *[F.when(rich, F.lit(0.3)).alias(c) for c in J.AUDIO_COLS],
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("dark")).alias("vibe"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("genius")).otherwise(F.lit("genius|lastfm")).alias("sources"),
        F.when(F.col("c_acctbal") < 0, F.lit("Spotify: 429 Client Error; Last.fm: timeout"))
         .otherwise(F.lit("")).alias("fetch_errors"))


SONG_ROWS_SQL = f"""
SELECT c_custkey, c_name AS title, c_mktsegment AS artist, repeat('na ', (c_nationkey * 2)::INTEGER) AS lyrics,
       '' AS album, CASE WHEN c_acctbal > 8000 THEN 'sp' || c_custkey ELSE '' END AS spotify_id,
       '' AS preview_url, '' AS genius_url,
       {', '.join(f"CASE WHEN c_acctbal > 8000 THEN 0.3::DOUBLE END AS {c}" for c in J.AUDIO_COLS)},
       CASE WHEN c_nationkey % 3 = 0 THEN 'dark' END AS vibe,
       CASE WHEN c_custkey % 2 = 0 THEN 'genius' ELSE 'genius|lastfm' END AS sources,
       CASE WHEN c_acctbal < 0 THEN 'Spotify: 429 Client Error; Last.fm: timeout' ELSE '' END AS fetch_errors
FROM customer"""


def _info(spark, sf):
    """Looked-up info: supplier rows keyed by the customer of the same key;
    even keys found a track, odd keys failed with an error."""
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier")
    j = s.join(c.select("c_custkey", "c_mktsegment", "c_name"), s.s_suppkey == c.c_custkey)
    ok = F.col("s_suppkey") % 2 == 0
    cols = {
        "info_spotify_id": F.when(ok, F.concat(F.lit("tr"), F.col("s_suppkey").cast("string"))),
        "info_title": F.when(ok, F.col("s_name")),
        "info_artist": F.lit(None).cast("string"),
        "info_album": F.when(ok, F.concat(F.lit("album"), F.col("s_nationkey").cast("string"))),
        "info_preview_url": F.when(ok & (F.col("s_nationkey") % 2 == 0), F.lit("http://pv")),
        "info_valence": F.when(ok, F.col("s_acctbal") / 10000),
        "info_energy": F.when(ok, F.col("s_nationkey") / 25),
        "info_tempo": F.when(ok, F.col("s_nationkey") * 5.0),
        "info_sources": F.when(ok, F.array(F.lit("spotify"))).otherwise(F.array().cast("array<string>")),
        "info_errors": F.when(ok, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("Spotify: no match for "), F.col("c_mktsegment"), F.lit(" - "), F.col("c_name")))),
    }
    for a in ["danceability", "acousticness", "instrumentalness", "speechiness", "liveness"]:
        cols[f"info_{a}"] = F.when(ok, F.lit(0.25))
    j = J.with_track_key(j, "c_mktsegment", "c_name").withColumns(cols)
    return j.select("s_suppkey", "artist_key", "title_key", *cols.keys())


INFO_SQL = f"""
SELECT s.s_suppkey, lower({S.strip('c.c_mktsegment')}) AS artist_key, lower({S.strip('c.c_name')}) AS title_key,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 'tr' || s.s_suppkey END AS info_spotify_id,
       CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_name END AS info_title,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 'album' || s.s_nationkey END AS info_album,
       CASE WHEN s.s_suppkey % 2 = 0 AND s.s_nationkey % 2 = 0 THEN 'http://pv' END AS info_preview_url,
       CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_acctbal / 10000 END AS info_valence,
       CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_nationkey / 25 END AS info_energy,
       CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_nationkey * 5.0::DOUBLE END AS info_tempo,
       CASE WHEN s.s_suppkey % 2 = 0 THEN ['spotify'] ELSE [] END AS info_sources,
       CASE WHEN s.s_suppkey % 2 = 0 THEN [] ELSE ['Spotify: no match for ' || c.c_mktsegment || ' - ' || c.c_name] END
         AS info_errors
FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey"""


def _overlay_sql(row: str, info: str) -> str:
    """J4 in SQL over a joined row (aliases r, i)."""
    old = f"list_filter(string_split(coalesce({row}.sources, ''), '|'), lambda x: x <> '')"
    new = f"coalesce({info}.info_sources, [])"
    union = f"array_to_string(list_concat({old}, list_filter({new}, lambda x, i: list_position({new}, x) = i AND NOT list_contains({old}, x))), '|')"
    errs = f"coalesce({info}.info_errors, [])"
    cleared = f"trim(replace(coalesce({row}.fetch_errors, ''), 'Spotify: 429 Client Error', ''), ' ;')"
    got = f"({info}.info_valence IS NOT NULL AND {info}.info_energy IS NOT NULL)"
    return f"""
       coalesce(CASE WHEN NOT {S.missing(f'{info}.info_title')} THEN {info}.info_title END, {row}.title) AS title,
       coalesce({info}.info_spotify_id, '') AS spotify_id,
       coalesce({info}.info_preview_url, '') AS preview_url,
       coalesce(CASE WHEN NOT {S.missing(f'{info}.info_album')} THEN {info}.info_album END, {row}.album, '') AS album,
       round({info}.info_valence, 6) AS valence, round({info}.info_energy, 6) AS energy,
       round({info}.info_tempo, 6) AS tempo,
       CASE WHEN {got} THEN {S.nearest_vibe(f'{info}.info_valence', f'{info}.info_energy')}
            WHEN coalesce({S.strip(f'{row}.vibe')}, '') = '' THEN '' ELSE {row}.vibe END AS vibe,
       {union} AS sources,
       CASE WHEN len({errs}) > 0 THEN array_to_string({errs}, '; ')
            WHEN NOT {S.missing(f'{info}.info_spotify_id')} THEN {cleared}
            ELSE coalesce({row}.fetch_errors, '') END AS fetch_errors"""


OUT_COLS = ["title", "spotify_id", "preview_url", "album", "valence", "energy", "tempo", "vibe",
            "sources", "fetch_errors"]


def _out(df, *more):
    return df.select(*more, "c_custkey", "title", "spotify_id", "preview_url", "album",
                     r6(F.col("valence")).alias("valence"), r6(F.col("energy")).alias("energy"),
                     r6(F.col("tempo")).alias("tempo"), "vibe", "sources", "fetch_errors")


@query("overlay_merge", f"""
SELECT r.c_custkey, {_overlay_sql('r', 'i')}
FROM ({SONG_ROWS_SQL}) r
LEFT JOIN ({INFO_SQL}) i ON i.s_suppkey = r.c_custkey
""")
def overlay_merge(spark, sf):
    """J4 for every stored row against the info row of the same key."""
    rows = _song_rows(spark, sf)
    info = _info(spark, sf).drop("artist_key", "title_key")
    j = rows.join(info, rows.c_custkey == info.s_suppkey, "left").drop("s_suppkey")
    return _out(J.overlay(j))


_NEED_SQL = (f"({S.usable('r.lyrics')} AND NOT (NOT {S.missing('r.spotify_id')} AND "
             f"((r.valence IS NOT NULL AND r.energy IS NOT NULL) OR NOT {S.missing('r.preview_url')})) "
             f"AND NOT {S.missing('r.artist')} AND NOT {S.missing('r.title')})")


@query("enrich_needed", f"""
WITH r AS ({SONG_ROWS_SQL}),
     i AS (SELECT * FROM ({INFO_SQL}) QUALIFY row_number() OVER (PARTITION BY artist_key, title_key
                                                                 ORDER BY info_spotify_id NULLS LAST) = 1)
SELECT r.c_custkey, {_overlay_sql('r', 'i')}, 1 AS enriched
FROM r LEFT JOIN i ON i.artist_key = lower({S.strip('r.artist')}) AND i.title_key = lower({S.strip('r.title')})
WHERE {_NEED_SQL}
UNION ALL
SELECT r.c_custkey, r.title, r.spotify_id, r.preview_url, r.album, round(r.valence, 6), round(r.energy, 6),
       round(r.tempo, 6), r.vibe, r.sources, r.fetch_errors, 0
FROM r WHERE NOT {_NEED_SQL}
""")
def enrich_needed(spark, sf):
    """Only rows with usable lyrics, no music data and valid names are
    joined with the info table; the rest pass through unchanged."""
    rows = _song_rows(spark, sf)
    rows = rows.withColumn("enriched", J.needs_enrichment(rows).cast("int"))
    out = J.enrich_rows(rows, _info(spark, sf).drop("s_suppkey"))
    return _out(out, "enriched")


@query("backfill", f"""
WITH r AS ({SONG_ROWS_SQL}),
     lt AS (SELECT lower({S.strip('c.c_mktsegment')}) AS artist_key, lower({S.strip('c.c_name')}) AS title_key,
                   CASE WHEN s.s_suppkey % 2 = 0 THEN repeat(s.s_name || ' ', 4) END AS new_lyrics,
                   'http://g/' || s.s_suppkey AS new_url
            FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey),
     j AS (SELECT r.*, lt.new_lyrics, lt.new_url,
                  (NOT {S.usable('r.lyrics')} AND NOT {S.missing('r.artist')} AND NOT {S.missing('r.title')}) AS need
           FROM r LEFT JOIN lt ON lt.artist_key = lower({S.strip('r.artist')}) AND lt.title_key = lower({S.strip('r.title')}))
SELECT c_custkey,
       length(CASE WHEN need AND coalesce(new_lyrics, '') <> '' THEN new_lyrics ELSE lyrics END) AS lyrics_len,
       CASE WHEN need AND coalesce(new_lyrics, '') <> '' THEN coalesce(new_url, genius_url, '') ELSE genius_url END
         AS genius_url,
       CASE WHEN need AND coalesce(new_lyrics, '') <> '' AND NOT contains(coalesce(sources, ''), 'genius')
            THEN CASE WHEN coalesce(sources, '') = '' THEN 'genius' ELSE sources || '|genius' END
            ELSE sources END AS sources,
       CAST(need AND coalesce(new_lyrics, '') <> '' AS INTEGER) AS backfilled
FROM j
""")
def backfill(spark, sf):
    """Rows without usable lyrics take them from a lyrics table (even
    supplier keys have lyrics, odd ones none)."""
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier")
    lt = J.with_track_key(s.join(c, s.s_suppkey == c.c_custkey), "c_mktsegment", "c_name").select(
        "artist_key", "title_key",
        F.when(F.col("s_suppkey") % 2 == 0, F.repeat(F.concat(F.col("s_name"), F.lit(" ")), 4)).alias("new_lyrics"),
        F.concat(F.lit("http://g/"), F.col("s_suppkey").cast("string")).alias("new_url"))
    out = J.backfill_lyrics(_song_rows(spark, sf), lt)
    return out.select("c_custkey", F.length("lyrics").alias("lyrics_len"), "genius_url", "sources",
                      F.col("backfilled").cast("int").alias("backfilled"))


@query("provenance_union", f"""
WITH r AS (
  SELECT c_custkey,
         CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'genius' ELSE 'genius|lastfm|genius' END AS old,
         CASE c_nationkey % 3 WHEN 0 THEN ['spotify'] WHEN 1 THEN ['genius', 'spotify', 'spotify'] ELSE [] END AS new,
         CASE WHEN c_acctbal < 2000 THEN ['Spotify: timeout'] ELSE [] END AS errs,
         'Spotify: 429 Client Error; Genius: x' AS old_err, c_acctbal > 0 AS matched
  FROM customer)
SELECT c_custkey,
       array_to_string(list_concat(o, list_filter(new, lambda x, i: list_position(new, x) = i AND NOT list_contains(o, x))), '|') AS sources,
       CASE WHEN len(errs) > 0 THEN array_to_string(errs, '; ')
            WHEN matched THEN trim(replace(old_err, 'Spotify: 429 Client Error', ''), ' ;') ELSE old_err END
         AS fetch_errors
FROM (SELECT *, list_filter(string_split(old, '|'), lambda x: x <> '') AS o FROM r)
""")
def provenance_union(spark, sf):
    c = table(spark, sf, "customer")
    old = (F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.lit("genius"))
            .otherwise(F.lit("genius|lastfm|genius")))
    new = (F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("spotify")))
            .when(F.col("c_nationkey") % 3 == 1, F.array(F.lit("genius"), F.lit("spotify"), F.lit("spotify")))
            .otherwise(F.array().cast("array<string>")))
    errs = F.when(F.col("c_acctbal") < 2000, F.array(F.lit("Spotify: timeout"))).otherwise(F.array().cast("array<string>"))
    return c.select("c_custkey", X.provenance_union(old, new).alias("sources"),
                    X.error_text(F.lit("Spotify: 429 Client Error; Genius: x"), errs,
                                 F.col("c_acctbal") > 0).alias("fetch_errors"))


# --------------------------------------------------------------------------
# Multi-source lookup and best match
# --------------------------------------------------------------------------

def _providers(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size", "p_type")
    li = table(spark, sf, "lineitem")
    keyed = J.with_track_key(part, "p_brand", "p_name")
    lyr = (keyed.join(li.filter(F.col("l_returnflag") == "R"), keyed.p_partkey == li.l_partkey, "left_semi")
           .select("artist_key", "title_key", F.lit("found").alias("lyrics_found")))
    feat = (keyed.join(li.filter(F.col("l_linestatus") == "O"), keyed.p_partkey == li.l_partkey, "left_semi")
            .select("artist_key", "title_key", F.col("p_partkey").cast("string").alias("spotify_id")))
    tags = keyed.filter(F.col("p_size") > 25).select("artist_key", "title_key", F.col("p_type").alias("lastfm_tags"))
    return part, lyr, feat, tags


@query("multi_lookup", f"""
WITH k AS (SELECT p_partkey, p_brand, p_name, p_size, {_tk('p_brand', 'p_name')} FROM part),
     lyr AS (SELECT DISTINCT artist_key, title_key FROM k
             WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')),
     feat AS (SELECT DISTINCT artist_key, title_key FROM k
              WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')),
     tg AS (SELECT DISTINCT artist_key, title_key FROM k WHERE p_size > 25),
     j AS (SELECT k.p_partkey, k.p_brand || ' - ' || k.p_name AS nm,
                  EXISTS (SELECT 1 FROM lyr WHERE lyr.artist_key = k.artist_key AND lyr.title_key = k.title_key) AS hl,
                  EXISTS (SELECT 1 FROM feat WHERE feat.artist_key = k.artist_key AND feat.title_key = k.title_key) AS hf,
                  EXISTS (SELECT 1 FROM tg WHERE tg.artist_key = k.artist_key AND tg.title_key = k.title_key) AS ht
           FROM k)
SELECT p_partkey,
       array_to_string(list_filter([CASE WHEN hl THEN 'genius' END, CASE WHEN hf THEN 'spotify' END,
                                    CASE WHEN ht THEN 'lastfm' END], lambda x: x IS NOT NULL), '|') AS sources,
       array_to_string(list_filter([CASE WHEN NOT hl THEN 'Genius: no match for ' || nm END,
                                    CASE WHEN NOT hf THEN 'Spotify: no match for ' || nm END,
                                    CASE WHEN NOT ht THEN 'Last.fm: no match for ' || nm END],
                                   lambda x: x IS NOT NULL), '; ') AS fetch_errors
FROM j
""")
def multi_lookup(spark, sf):
    """Part rows as songs; lyrics known for parts returned (R), features
    for open lines (O), tags for large sizes -- each a keyed provider table."""
    part, lyr, feat, tags = _providers(spark, sf)
    songs = part.select("p_partkey", F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    out = J.multi_lookup(songs, lyr, feat, tags)
    return out.select("p_partkey", "sources", "fetch_errors")


def _asked_title(col: str) -> str:
    return f"CASE WHEN p_size % 5 = 0 THEN {col} || ' (Remastered)' WHEN p_size = 7 THEN '!?' ELSE {col} END"


@query("best_match", f"""
WITH asked AS (SELECT p_partkey, {_asked_title('p_name')} AS title, CASE WHEN p_size > 25 THEN p_brand ELSE 'Unknown' END AS artist FROM part),
     q AS (SELECT p_partkey, nullif({S.norm_key('title')}, '') AS t, {S.norm_key('artist')} AS a,
                  list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS words FROM asked),
     cat AS (SELECT p_partkey AS id, {S.norm_key('p_name')} AS t, {S.norm_key('p_brand')} AS a,
                    list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS words FROM part),
     s1 AS (SELECT t, a, min(id) AS id FROM cat GROUP BY t, a),
     s2 AS (SELECT t, min(id) AS id FROM cat GROUP BY t),
     m AS (SELECT q.*, s1.id AS m1, s2.id AS m2 FROM q LEFT JOIN s1 ON s1.t = q.t AND s1.a = q.a LEFT JOIN s2 ON s2.t = q.t),
     -- what is left meets every row of its artist
     pairs AS (SELECT m.p_partkey, cat.id, len(m.words) AS n, len(list_intersect(m.words, cat.words)) AS shared
               FROM m JOIN cat ON cat.a = m.a WHERE m1 IS NULL AND m2 IS NULL AND m.t IS NOT NULL AND m.a <> ''),
     s3 AS (SELECT p_partkey, id FROM pairs WHERE shared > 0 AND 2 * shared >= n
            QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, id) = 1)
SELECT m.p_partkey, coalesce(m1, m2, s3.id) AS match_id,
       CASE WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 WHEN s3.id IS NOT NULL THEN 3 END AS match_stage
FROM m LEFT JOIN s3 ON s3.p_partkey = m.p_partkey
""")
def best_match(spark, sf):
    """requests = part names, some "(Remastered)" or without a letter, with
    the brand (large sizes) or "Unknown" as artist; catalog = part. Stage 1
    exact name+artist, stage 2 name only, stage 3 most words in common."""
    p = table(spark, sf, "part")
    qs = p.select("p_partkey", F.expr(_asked_title("p_name")).alias("title"),
                  F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("Unknown")).alias("artist"))
    cat = p.select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"),
                   F.col("p_brand").alias("artist"))
    found = J.best_match(qs, cat, query_id="p_partkey")
    return found.select("p_partkey", "match_id", F.col("match_stage").cast("int").alias("match_stage"))
