"""Enrichment joins (J1-J7, J12, J13) and the filters around them.

No join here broadcasts a table whose size grows with the data: AQE turns a
sort-merge join into a broadcast one only after measuring the side at run
time (``spark.sql.adaptive.autoBroadcastJoinThreshold``). Lookup sides are
deduplicated to one row per key first, so every join is N:1 and a hot key on
the probe side cannot multiply rows; AQE's skew-join splits such a key's
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.operators.dedupe import keep_first, keep_last
from versewise.schema import CATALOG_FEATURES, CATALOG_RENAMES

AUDIO_COLS = ["valence", "energy", "tempo", "danceability", "acousticness",
              "instrumentalness", "speechiness", "liveness"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """A string field that is not missing (F8)."""
    return ~X.is_missing(c)


def has_music_data(df: DataFrame, require_audio_file: bool = False,
                   audio_exists: Column | None = None) -> Column:
    """an id and (both labels, a preview or an existing audio file).
    ``audio_exists`` comes from J12; without it a non-blank path counts."""
    cols = set(df.columns)
    sid = present("spotify_id") if "spotify_id" in cols else F.lit(False)
    labels = (L.has_number("valence") & L.has_number("energy")) if {"valence", "energy"} <= cols else F.lit(False)
    preview = present("preview_url") if "preview_url" in cols else F.lit(False)
    if audio_exists is not None:
        audio = audio_exists
    elif "audio_path" in cols:
        audio = present("audio_path")
    else:
        audio = F.lit(False)
    if require_audio_file:
        return sid & audio
    return sid & (labels | preview | audio)


def attach_file_presence(df: DataFrame, listing: DataFrame, path_col: str = "audio_path") -> DataFrame:
    """``audio_exists`` from a left join with a file listing (a
    ``binaryFile`` read's ``path`` column without content, or any path table)."""
    files = listing.select(F.regexp_replace("path", "^file:", "").alias("_p")).distinct()
    j = df.join(files, X.strip(F.col(path_col)) == files["_p"], "left")
    return j.withColumn("audio_exists", present(path_col) & F.col("_p").isNotNull()).drop("_p")


def filter_complete_rows(df: DataFrame, require_audio_file: bool = False,
                         audio_exists: Column | None = None) -> DataFrame:
    """usable lyrics and music data."""
    missing = {"artist", "title"} - set(df.columns)
    if missing:
        raise ValueError(f"complete rows need names; missing: {sorted(missing)}")
    return df.filter(X.has_usable_lyrics("lyrics")
                     & has_music_data(df, require_audio_file, audio_exists))


def fill_vibe(df: DataFrame) -> Column:
    """keep an existing vibe (stripped), else J8 when both labels exist, else ""."""
    existing = X.strip(F.col("vibe")) if "vibe" in df.columns else F.lit(None).cast("string")
    both = L.has_number("valence") & L.has_number("energy")
    return (F.when(present(existing), existing)
             .when(both, L.nearest_anchor("valence", "energy"))
             .otherwise(F.lit("")))


def prepare_catalog(catalog: DataFrame, pos_col: str) -> DataFrame:
    """Catalog side of J1: key (X9), first row per key (W1), renamed columns."""
    missing = {"track_name", "track_artist", "track_id"} - set(catalog.columns)
    if missing:
        raise ValueError(f"catalog missing columns: {sorted(missing)}")
    keyed = catalog.withColumn("_merge_key", X.merge_key("track_artist", "track_name"))
    first = keep_first(keyed, ["_merge_key"], [pos_col])
    feats = [c for c in CATALOG_FEATURES if c in catalog.columns]
    ren = [F.col(s).alias(d) for s, d in CATALOG_RENAMES if s in catalog.columns]
    return first.select(*ren, *feats, "_merge_key")


def merge_with_catalog(songs: DataFrame, catalog_prepared: DataFrame, drop_blank_keys: bool = False) -> DataFrame:
    """Left join on the normalised artist|title key; catalog columns
    replace the song's; ``label_source`` and F14 vibe. With
    ``drop_blank_keys`` names that normalise to nothing match nothing (T6),
    which also keeps them from meeting under one key."""
    stale = [c for c in ["spotify_id", "album", *CATALOG_FEATURES, "label_source"] if c in songs.columns]
    left = songs.drop(*stale).withColumn("_merge_key", X.merge_key(
        F.col("artist") if "artist" in songs.columns else F.lit(None),
        F.col("title") if "title" in songs.columns else F.lit(None)))
    if drop_blank_keys:
        left = left.withColumn("_merge_key", F.nullif("_merge_key", F.lit("|")))
    merged = left.join(catalog_prepared, "_merge_key", "left").drop("_merge_key")
    merged = merged.withColumn("label_source", F.when(present("spotify_id"), "kaggle").otherwise(""))
    return merged.withColumn("vibe", fill_vibe(merged))


def filter_lyrics_and_music(df: DataFrame) -> DataFrame:
    """usable lyrics, an id and both labels."""
    return df.filter(merge_keep_predicate())


def merge_summary(catalog_prepared: DataFrame, merged: DataFrame, keep: Column) -> DataFrame:
    """A2 as one row from one aggregation over the union of the deduplicated
    catalog and the merged rows (``keep`` is the output filter, F4)."""
    cat = catalog_prepared.select(F.lit(True).alias("_cat"), F.lit(False).alias("_hit"),
                                  F.lit(False).alias("_out"))
    mrg = merged.select(F.lit(False).alias("_cat"), (F.col("label_source") == "kaggle").alias("_hit"),
                        keep.alias("_out"))
    return cat.unionByName(mrg).agg(
        F.count_if("_cat").alias("kaggle_unique_tracks"),
        F.count_if(~F.col("_cat")).alias("input_rows"),
        F.count_if("_out").alias("output_rows"),
        F.count_if("_hit").alias("matched_with_features"))


def merge_keep_predicate() -> Column:
    """F4 as a Column (the same test ``filter_lyrics_and_music`` applies)."""
    return (X.has_usable_lyrics("lyrics") & present("spotify_id")
            & L.has_number("valence") & L.has_number("energy"))


def with_track_key(df: DataFrame, artist="artist", title="title") -> DataFrame:
    return (df.withColumn("artist_key", F.lower(X.strip(_col(artist))))
              .withColumn("title_key", F.lower(X.strip(_col(title)))))


def existing_keys(df: DataFrame) -> DataFrame:
    """Distinct track keys of an output table (rows with both names)."""
    return (with_track_key(df.filter(F.col("artist").isNotNull() & F.col("title").isNotNull()))
            .select("artist_key", "title_key").distinct())


def resume_pending(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted tracks whose key is not stored yet (left anti join)."""
    keys = existing_keys(existing)
    return with_track_key(wanted).join(keys, ["artist_key", "title_key"], "left_anti") \
        .drop("artist_key", "title_key")


def store_tracks(df: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The rows with both names as a table bucketed and sorted by track key
    (``artist_key``, ``title_key``), under ``path``: what joins it by that key
    reads it as it lies."""
    rows = with_track_key(df.filter(F.col("artist").isNotNull() & F.col("title").isNotNull()))
    (rows.repartition(buckets, "artist_key", "title_key").write.bucketBy(buckets, "artist_key", "title_key")
     .sortBy("artist_key", "title_key").option("path", path).mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)


def resume_from_store(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """J2 against a table of :func:`store_tracks`: only the wanted rows are
    shuffled, to the stored table's buckets. An anti join needs no distinct keys."""
    return (with_track_key(wanted).join(stored.select("artist_key", "title_key"), ["artist_key", "title_key"], "left_anti")
            .drop("artist_key", "title_key"))


def lookup_outcomes(tracks: DataFrame, table: DataFrame, pos_col: str,
                    info: DataFrame | None = None, skip_existing: bool = True) -> DataFrame:
    """Each listed track against the last stored row per key:
    not_in_csv / skipped / processed, plus ``matched`` when the lookup side
    (``info`` keyed by artist_key, title_key with ``spotify_id``) has an id."""
    named = table.filter(present("artist") & present("title"))
    idx = keep_last(with_track_key(named), ["artist_key", "title_key"], [pos_col])
    idx = idx.select("artist_key", "title_key",
                     X.has_usable_lyrics("lyrics").alias("_usable"),
                     has_music_data(idx).alias("_music"))
    j = with_track_key(tracks).join(idx, ["artist_key", "title_key"], "left")
    skip = ~F.col("_usable") | (F.col("_music") & F.col("_usable")) if skip_existing else ~F.col("_usable")
    outcome = (F.when(F.col("_usable").isNull(), "not_in_csv")
                .when(skip, "skipped").otherwise("processed"))
    j = j.withColumn("outcome", outcome)
    if info is not None:
        inf = keep_first(info.select("artist_key", "title_key", "spotify_id"),
                         ["artist_key", "title_key"], ["spotify_id"])
        j = j.join(inf.withColumnRenamed("spotify_id", "_found"), ["artist_key", "title_key"], "left")
        j = j.withColumn("matched", (F.col("outcome") == "processed") & present("_found")).drop("_found")
    return j.drop("_usable", "_music")


def overlay(df: DataFrame, prefix: str = "info_", audio_path: Column | None = None,
            keep_old_on_null: bool = False) -> DataFrame:
    """Lay looked-up columns (``info_*``, NULL when the lookup failed) over
    the row. Title/artist/album coalesce; id, preview and the eight audio
    columns are replaced even by NULL (unless ``keep_old_on_null``, T15); vibe recomputed when both labels came
    back; sources ordered union; error text rules of X15."""
    p = prefix
    got = L.has_number(f"{p}valence") & L.has_number(f"{p}energy")
    old_vibe = F.coalesce(X.strip(F.col("vibe")), F.lit("")) if "vibe" in df.columns else F.lit("")
    sets = {
        "title": F.coalesce(F.when(present(f"{p}title"), F.col(f"{p}title")), F.col("title")),
        "artist": F.coalesce(F.when(present(f"{p}artist"), F.col(f"{p}artist")), F.col("artist")),
        "spotify_id": F.coalesce(F.col(f"{p}spotify_id"), F.lit("")),
        "preview_url": F.coalesce(F.col(f"{p}preview_url"), F.lit("")),
        "album": F.coalesce(F.when(present(f"{p}album"), F.col(f"{p}album")),
                            F.col("album") if "album" in df.columns else F.lit(None), F.lit("")),
        "vibe": F.when(got, L.nearest_anchor(f"{p}valence", f"{p}energy"))
                 .otherwise(F.when(old_vibe == "", F.lit("")).otherwise(F.col("vibe"))),
        "sources": X.provenance_union(F.col("sources") if "sources" in df.columns else F.lit(None),
                                      F.coalesce(F.col(f"{p}sources"), F.array().cast("array<string>"))),
        "fetch_errors": X.error_text(F.col("fetch_errors") if "fetch_errors" in df.columns else F.lit(None),
                                     F.coalesce(F.col(f"{p}errors"), F.array().cast("array<string>")),
                                     present(f"{p}spotify_id")),
    }
    for c in AUDIO_COLS:
        sets[c] = F.col(f"{p}{c}").cast("double")
    if keep_old_on_null:
        for c in ("spotify_id", "preview_url"):
            if c in df.columns:
                sets[c] = F.coalesce(F.when(present(f"{p}{c}"), F.col(f"{p}{c}")), F.col(c), F.lit(""))
        sets |= {c: F.coalesce(sets[c], F.col(c)) for c in AUDIO_COLS if c in df.columns}
    if audio_path is not None:
        sets["audio_path"] = F.coalesce(audio_path, F.col("audio_path"))
    out = df.withColumns(sets)
    return out.drop(*[c for c in out.columns if c.startswith(p)])


def needs_enrichment(df: DataFrame) -> Column:
    """J5 gate: usable lyrics, no music data yet, valid names."""
    usable = X.has_usable_lyrics("lyrics")
    return usable & ~has_music_data(df) & X.valid_name("artist") & X.valid_name("title")


def enrich_rows(songs: DataFrame, info: DataFrame) -> DataFrame:
    """Only rows that need it are joined with the lookup table (keyed by
    artist_key, title_key, columns ``info_*``); the rest pass through without
    a shuffle."""
    flagged = songs.withColumn("_need", needs_enrichment(songs))
    need = with_track_key(flagged.filter("_need"))
    keep = flagged.filter(~F.col("_need"))
    inf = keep_first(info, ["artist_key", "title_key"],
                     [F.col("info_spotify_id").isNull(), "info_spotify_id"])
    merged = overlay(need.join(inf, ["artist_key", "title_key"], "left")).drop("artist_key", "title_key")
    return merged.unionByName(keep, allowMissingColumns=True).drop("_need")


def backfill_lyrics(songs: DataFrame, lyrics_table: DataFrame) -> DataFrame:
    """Rows without usable lyrics but with valid names take lyrics from
    a lyrics table (artist_key, title_key, new_lyrics, new_url); the url is
    kept when none comes back; "genius" is added to the sources once."""
    lt = keep_first(lyrics_table, ["artist_key", "title_key"], ["new_url"])
    songs = songs.withColumns({c: F.lit(None).cast("string") for c in ("genius_url", "sources")
                               if c not in songs.columns})
    flagged = songs.withColumn("_need", ~X.has_usable_lyrics("lyrics") & X.valid_name("artist")
                               & X.valid_name("title"))
    need = with_track_key(flagged.filter("_need")).join(lt, ["artist_key", "title_key"], "left")
    got = F.col("new_lyrics").isNotNull() & (F.col("new_lyrics") != "")
    src = F.coalesce(F.col("sources"), F.lit(""))
    need = need.withColumns({
        "lyrics": F.when(got, F.col("new_lyrics")).otherwise(F.col("lyrics")),
        "genius_url": F.when(got, F.coalesce(F.when(present("new_url"), F.col("new_url")),
                                             F.col("genius_url"), F.lit(""))).otherwise(F.col("genius_url")),
        "sources": F.when(got & ~F.contains(src, F.lit("genius")),
                          F.when(src == "", F.lit("genius")).otherwise(F.concat(src, F.lit("|genius"))))
                    .otherwise(F.col("sources")),
        "backfilled": got,
    }).drop("artist_key", "title_key", "new_lyrics", "new_url")
    keep = flagged.filter(~F.col("_need")).withColumn("backfilled", F.lit(False))
    return need.unionByName(keep).drop("_need")


def title_tokens(c) -> Column:
    """The distinct words of a title (runs of ``[a-z0-9]``, lower-cased), sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("([a-z0-9]+)"))
    return F.array_sort(F.array_distinct(words))


def share_join(asked: DataFrame, known: DataFrame, share: float = 0.5, list_rows: int = 10_000) -> DataFrame:
    """Set-similarity join within a group: for each of ``asked`` (group, tokens)
    the id of the ``known`` (group, tokens, id) that holds most of its tokens,
    at least ``share`` of them; the smallest id among equals. Rows without a
    partner are left out.

    Both sides are reduced to one row a (group, token set). ``known`` is indexed
    by token; a set is looked up by its prefix alone: ordered by frequency in
    the group, the rarest n - t + 1 of its n tokens, one of which any set with t
    tokens in common holds. Candidates are then verified by their overlap. A
    list of more than ``list_rows`` sets is dealt into parts, and the sets that
    look it up go to each of them."""
    sets = known.filter(F.size("tokens") > 0).groupBy("group", "tokens").agg(F.min("id").alias("id"))
    index = sets.select("group", "tokens", "id", F.explode("tokens").alias("token"))
    lists = index.groupBy("group", "token").agg(F.count(F.lit(1)).alias("rows"))
    one = asked.filter(F.size("tokens") > 0).select("group", "tokens").distinct()
    freq = (one.select("group", "tokens", F.explode("tokens").alias("token")).join(lists, ["group", "token"], "left")
            .groupBy("group", "tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "token"))).alias("rare")))
    least = F.ceil(F.size("tokens") * share - 1e-9).cast("int")
    prefix = freq.select("group", "tokens", least.alias("least"), F.explode(F.slice("rare", 1, F.size("tokens") - F.greatest(least, F.lit(1)) + 1)).alias("p"))
    parts = lambda rows: F.ceil(rows / list_rows).cast("int")
    looked = (prefix.filter("p.rows > 0").select("group", "tokens", "least", F.col("p.token").alias("token"),
                                                 F.explode(F.sequence(F.lit(0), parts(F.col("p.rows")) - 1)).alias("part")))
    dealt = (index.withColumnRenamed("tokens", "has").join(lists, ["group", "token"])
             .withColumn("part", F.pmod(F.xxhash64("id"), parts(F.col("rows"))).cast("int")).drop("rows"))
    pairs = looked.join(dealt, ["group", "token", "part"]).withColumn("shared", F.size(F.array_intersect("tokens", "has")))
    return (pairs.filter((F.col("shared") >= F.col("least")) & (F.col("shared") > 0)).groupBy("group", "tokens")
            .agg(F.min_by("id", F.struct(-F.col("shared"), "id")).alias("id")))


def best_match(queries: DataFrame, catalog: DataFrame, id_col: str = "track_id", query_id: str = "q_id",
               drop_blank_keys: bool = True, share: float = 0.5) -> DataFrame:
    """J6 re-aimed to a catalog table: stage 1 = exact (title, artist) key,
    stage 2 = title key alone, stage 3 = most title words in common among the
    artist's rows, at least ``share`` of those asked for; in each stage the
    catalog row with the smallest id wins.

    Catalog sides of stages 1 and 2 are reduced to one row per key first, so
    the joins emit a row per query. Stage 3 is for what is left and looks up the
    rare words of a title only (:func:`share_join`). ``drop_blank_keys``: names
    that normalise to nothing match nothing."""
    cat = catalog.select(F.col(id_col).alias("match_id"), title_tokens("name").alias("_w"),
                         X.normalize_key("name").alias("_t"), X.normalize_key("artist").alias("_a"))
    q = queries.withColumns({"_t": X.normalize_key("title"), "_a": X.normalize_key("artist"), "_w": title_tokens("title")})
    if drop_blank_keys:
        cat = cat.filter("_t != ''")
        q = q.withColumn("_t", F.nullif("_t", F.lit("")))
    strict = keep_first(cat.drop("_w"), ["_t", "_a"], ["match_id"]).withColumnRenamed("match_id", "_m1")
    loose = keep_first(cat.drop("_a", "_w"), ["_t"], ["match_id"]).withColumnRenamed("match_id", "_m2")
    q = q.join(strict, ["_t", "_a"], "left").join(loose, ["_t"], "left")

    left = q.filter("_m1 IS NULL AND _m2 IS NULL AND _a != ''").select(F.col("_a").alias("group"), F.col("_w").alias("tokens"))
    rows = cat.filter("_a != ''").select(F.col("_a").alias("group"), F.col("_w").alias("tokens"), F.col("match_id").alias("id"))
    found = share_join(left, rows, share).select(F.col("group").alias("_a"), F.col("tokens").alias("_w"), F.col("id").alias("_m3"))
    q = q.join(found, ["_a", "_w"], "left")
    stage = (F.when(F.col("_m1").isNotNull(), 1).when(F.col("_m2").isNotNull(), 2)
             .when(F.col("_m3").isNotNull() & F.col("_t").isNotNull(), 3))
    return (q.withColumns({"match_id": F.coalesce("_m1", "_m2", F.when(F.col("_t").isNotNull(), F.col("_m3"))), "match_stage": stage})
            .drop("_t", "_a", "_w", "_m1", "_m2", "_m3"))


def multi_lookup(songs: DataFrame, lyrics: DataFrame | None, features: DataFrame | None,
                 tags: DataFrame | None) -> DataFrame:
    """Optional lyrics, features and tags providers in turn (left joins
    on the track key), collecting sources and errors in provider order."""
    df = with_track_key(songs)
    src, err = [], []
    name = F.concat(F.col("artist"), F.lit(" - "), F.col("title"))
    if lyrics is not None:
        lt = keep_first(lyrics, ["artist_key", "title_key"], ["lyrics_found"]).withColumn("_l", F.lit(True))
        df = df.join(lt, ["artist_key", "title_key"], "left")
        src.append(F.when(F.col("_l"), F.lit("genius")))
        err.append(F.when(F.col("_l").isNull(), F.concat(F.lit("Genius: no match for "), name)))
    if features is not None:
        ft = keep_first(features, ["artist_key", "title_key"], ["spotify_id"]).withColumn("_f", F.lit(True))
        df = df.join(ft, ["artist_key", "title_key"], "left")
        src.append(F.when(F.col("_f"), F.lit("spotify")))
        err.append(F.when(F.col("_f").isNull(), F.concat(F.lit("Spotify: no match for "), name)))
    if tags is not None:
        tt = keep_first(tags, ["artist_key", "title_key"], ["lastfm_tags"]).withColumn("_g", F.lit(True))
        df = df.join(tt, ["artist_key", "title_key"], "left")
        src.append(F.when(F.col("_g"), F.lit("lastfm")))
        err.append(F.when(F.col("_g").isNull(), F.concat(F.lit("Last.fm: no match for "), name)))
    df = df.withColumns({
        "sources": F.array_join(F.array_compact(F.array(*src)), "|") if src else F.lit(""),
        "fetch_errors": F.array_join(F.array_compact(F.array(*err)), "; ") if err else F.lit(""),
    })
    return df.drop(*[c for c in ["_l", "_f", "_g", "artist_key", "title_key"] if c in df.columns])
