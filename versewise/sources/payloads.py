"""Nested track, tag and search payloads (S11-S13), parsed with explicit
schemas (``from_json``), never inferred per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.operators.dedupe import keep_first
from versewise.operators.lookup import first_tags
from versewise.schema import (SEARCH_PAYLOAD_SCHEMA, TAG_PAYLOAD_ARRAY_SCHEMA, TAG_PAYLOAD_OBJECT_SCHEMA,
                              TRACK_PAYLOAD_SCHEMA)


def first_artist(artists: Column) -> Column:
    """Name of the first artist, "Unknown" when there is none."""
    return F.coalesce(F.try_element_at(artists, F.lit(1)).getField("name"), F.lit("Unknown"))


def flatten_track(df: DataFrame, payload: str) -> DataFrame:
    """A track payload to song columns (id, title, artist, album,
    preview, eight audio features, key, mode)."""
    t = F.from_json(F.col(payload), TRACK_PAYLOAD_SCHEMA)
    d = df.withColumn("_t", t)
    feats = {c: F.col(f"_t.features.{c}") for c in
             ["valence", "energy", "tempo", "danceability", "acousticness", "instrumentalness",
              "speechiness", "liveness", "key", "mode"]}
    return d.withColumns({
        "spotify_id": F.col("_t.id"),
        "title": F.col("_t.name"),
        "artist": first_artist(F.col("_t.artists")),
        "album": F.col("_t.album.name"),
        "preview_url": F.col("_t.preview_url"),
        **feats,
    }).drop("_t")


def flatten_tags(df: DataFrame, payload: str, k: int | None = None, album: str | None = None) -> DataFrame:
    """``toptags.tag`` may be one object or an array of objects; both
    schemas are tried; non-empty names are kept (the first ``k`` if given),
    with the url and the album title. With ``album``, that column takes the
    title where it is empty."""
    arr = F.from_json(F.col(payload), TAG_PAYLOAD_ARRAY_SCHEMA)
    obj = F.from_json(F.col(payload), TAG_PAYLOAD_OBJECT_SCHEMA)
    d = df.withColumns({"_a": arr, "_o": obj})
    names = F.coalesce(F.transform(F.col("_a.track.toptags.tag"), lambda t: t["name"]),
                       F.when(F.col("_o.track.toptags.tag").isNotNull(),
                              F.array(F.col("_o.track.toptags.tag.name"))),
                       F.array().cast("array<string>"))
    return d.withColumns({
        "lastfm_tags": first_tags(names, k),
        "lastfm_url": F.coalesce(F.col("_a.track.url"), F.col("_o.track.url")),
        "lastfm_album": F.coalesce(F.col("_a.track.album.title"), F.col("_o.track.album.title")),
        **({album: F.coalesce(F.nullif(F.col(album), F.lit("")), F.col("_a.track.album.title"), F.col("_o.track.album.title"))}
           if album else {}),
    }).drop("_a", "_o")


def explode_search(df: DataFrame, payload: str, order_cols: list[str], market: Column | None = None,
                   genre_hint: Column | None = None) -> DataFrame:
    """S13 + F6 + W1: search results to candidate rows; items without id or
    name are dropped; the first row per id (in ``order_cols`` then item
    position) is kept."""
    p = F.from_json(F.col(payload), SEARCH_PAYLOAD_SCHEMA)
    d = df.select(*order_cols, *([market.alias("market")] if market is not None else []),
                  *([genre_hint.alias("genre_hint")] if genre_hint is not None else []),
                  F.posexplode(p["tracks"]["items"]).alias("item_pos", "t"))
    d = d.select(*[c for c in d.columns if c != "t"],
                 F.col("t.id").alias("spotify_id"), F.col("t.name").alias("title"),
                 first_artist(F.col("t.artists")).alias("artist"))
    d = d.filter(F.col("spotify_id").isNotNull() & (F.col("spotify_id") != "")
                 & F.col("title").isNotNull() & (F.col("title") != ""))
    return keep_first(d, ["spotify_id"], [*order_cols, "item_pos"])
