"""Queries for predicates, row shaping, keys, ordering, set operations,
track lists and numeric helpers (F2, F5-F7, F9, F15, X10-X12, X16-X19,
O3-O5, U1, U3, U4, S4, S8, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.operators import joins as J
from versewise.plans import sqltext as S
from versewise.plans.queries import query, r6
from versewise.plans.queries_labels import GENRE_WORDS, K_SQL, _k, _pick, _pick_sql
from versewise.schema import SPOTIFY_FEATURES, SPOTIFY_SOURCES, VIBE_ANCHORS, VIBES
from versewise.sources import songs as SG
from versewise.sources.tables import mood_points, table

# --------------------------------------------------------------------------
# predicates
# --------------------------------------------------------------------------

_ARTIST_SQL = ("CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'nan' "
               "ELSE c_mktsegment END")


def _artist():
    n = F.col("c_nationkey") % 5
    return (F.when(n == 0, F.lit(None).cast("string")).when(n == 1, F.lit(" ")).when(n == 2, F.lit("nan"))
             .otherwise(F.col("c_mktsegment")))


@query("name_filters", f"""
SELECT c_custkey,
       CAST(NOT {S.missing(_ARTIST_SQL)} AND NOT {S.missing('c_name')} AS INTEGER) AS valid_names,
       CAST(coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE 'id' || c_custkey END, '') <> ''
            AND CASE WHEN c_nationkey % 7 = 0 THEN '' ELSE c_name END <> '' AS INTEGER) AS valid_candidate,
       CAST(NOT {S.missing("CASE WHEN c_acctbal > 3000 THEN 'sp' || c_custkey ELSE '' END")}
            AND (c_nationkey > 10
                 OR NOT {S.missing("CASE WHEN c_custkey % 4 = 0 THEN 'http://p' ELSE '' END")}
                 OR NOT {S.missing("CASE WHEN c_mktsegment = 'BUILDING' THEN '/a/' || c_custkey ELSE '' END")})
            AS INTEGER) AS has_music
FROM customer
""")
def name_filters(spark, sf):
    """F7 valid names, F6 candidate validity, F2 music data on customers."""
    c = table(spark, sf, "customer")
    songs = c.select(
        "c_custkey", _artist().alias("artist"), F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.concat(F.lit("id"), F.col("c_custkey").cast("string"))).alias("cid"),
        F.when(F.col("c_nationkey") % 7 == 0, F.lit("")).otherwise(F.col("c_name")).alias("cname"),
        F.when(F.col("c_acctbal") > 3000, F.concat(F.lit("sp"), F.col("c_custkey").cast("string"))).otherwise(F.lit("")).alias("spotify_id"),
        F.when(F.col("c_nationkey") > 10, F.lit(0.5)).alias("valence"),
        F.when(F.col("c_nationkey") > 10, F.lit(0.5)).alias("energy"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("http://p")).otherwise(F.lit("")).alias("preview_url"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("/a/"), F.col("c_custkey").cast("string")))
         .otherwise(F.lit("")).alias("audio_path"))
    cand_ok = (F.coalesce(F.col("cid"), F.lit("")) != "") & (F.coalesce(F.col("cname"), F.lit("")) != "")
    return songs.select("c_custkey",
                        (X.valid_name("artist") & X.valid_name("title")).cast("int").alias("valid_names"),
                        cand_ok.cast("int").alias("valid_candidate"),
                        J.has_music_data(songs).cast("int").alias("has_music"))


@query("label_dropna", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_returnflag <> 'N' AND l_linestatus <> 'O'
""")
def label_dropna(spark, sf):
    """valence missing on returnflag N, vibe missing on open lines; rows
    with any label missing are dropped."""
    li = table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                  F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10).alias("valence"),
                  (F.col("l_quantity") / 50).alias("energy"),
                  F.when(F.col("l_linestatus") != "O", F.lit("chill")).alias("vibe"))
    return SG.drop_unlabelled(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --------------------------------------------------------------------------
# song rows and score structs
# --------------------------------------------------------------------------

def _song_info(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.when(F.col("p_size") >= 10, F.repeat(F.concat(F.col("p_name"), F.lit(" ")), 5)).alias("lyrics"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sp"), F.col("p_partkey").cast("string"))).alias("spotify_id"),
        F.when(F.col("p_size") > 20, (F.col("p_retailprice") - 900) / 100).alias("valence"),
        F.when(F.col("p_size") > 10, F.col("p_size") / 50).alias("energy"),
        F.array(F.col("p_type"), F.lower("p_type")).alias("lastfm_tags"))


SONG_INFO_SQL = """
SELECT p_partkey, p_name AS title, p_brand AS artist,
       CASE WHEN p_size >= 10 THEN repeat(p_name || ' ', 5) END AS lyrics,
       CASE WHEN p_partkey % 2 = 0 THEN 'sp' || p_partkey END AS spotify_id,
       CASE WHEN p_size > 20 THEN (p_retailprice - 900) / 100 END AS valence,
       CASE WHEN p_size > 10 THEN p_size / 50 END AS energy,
       [p_type, lower(p_type)] AS lastfm_tags
FROM part"""


@query("song_rows", f"""
SELECT p_partkey, title, artist, coalesce(lyrics, '') AS lyrics, coalesce(spotify_id, '') AS spotify_id,
       round(valence, 6) AS valence, round(energy, 6) AS energy, array_to_string(lastfm_tags, '|') AS lastfm_tags,
       CASE WHEN valence IS NOT NULL AND energy IS NOT NULL THEN {S.nearest_vibe('valence', 'energy')} ELSE '' END AS vibe
FROM ({SONG_INFO_SQL})
""")
def song_rows(spark, sf):
    """part rows as looked-up songs, flattened to table rows."""
    out = SG.dataset_rows(_song_info(spark, sf))
    return out.select("p_partkey", "title", "artist", "lyrics", "spotify_id", r6(F.col("valence")).alias("valence"),
                      r6(F.col("energy")).alias("energy"), "lastfm_tags", "vibe")


@query("score_struct", f"""
SELECT p_partkey,
       to_json({{'title': title, 'artist': artist, 'spotify_id': spotify_id, 'n_tags': len(lastfm_tags),
                'vibe': CASE WHEN valence IS NOT NULL AND energy IS NOT NULL
                             THEN {S.nearest_vibe('valence', 'energy')} END}}) AS song
FROM ({SONG_INFO_SQL})
""")
def score_struct(spark, sf):
    """song identity and the label attached to a result as a struct
    (shown as JSON of strings and integers)."""
    d = _song_info(spark, sf)
    song = F.struct("title", "artist", "spotify_id", F.size("lastfm_tags").alias("n_tags"),
                    L.nearest_anchor("valence", "energy").alias("vibe"))
    return d.select("p_partkey", F.to_json(song, {"ignoreNullFields": "false"}).alias("song"))


# --------------------------------------------------------------------------
# Scraped headers, genre keys, track keys, query text
# --------------------------------------------------------------------------

def _scraped():
    title = F.concat(F.lit("Song "), F.col("doc_id").cast("string"))
    m = F.col("doc_id") % 3
    raw = (F.when(m == 0, F.concat(title, F.lit(" Lyrics\n"), F.col("doc_id").cast("string"),
                                   F.lit(" Contributors Translations\n"), F.col("text")))
            .when(m == 1, F.col("text"))
            .otherwise(F.concat(F.upper(title), F.lit(" lyrics  \n\n"), F.col("text"))))
    return title, raw


def _scraped_sql():
    title = "('Song ' || doc_id)"
    raw = (f"CASE doc_id % 3 WHEN 0 THEN {title} || ' Lyrics' || chr(10) || doc_id || ' Contributors Translations' "
           f"|| chr(10) || text WHEN 1 THEN text ELSE upper({title}) || ' lyrics  ' || chr(10) || chr(10) || text END")
    return title, raw


def _header_sql(raw: str, title: str) -> str:
    t = S.strip(raw)
    after = f"substr({t}, length({title}) + 1)"
    hdr = f"regexp_extract({after}, {S.q('(?i)^' + S.WS + '*Lyrics' + S.WS + '*' + chr(10))}, 0)"
    no_hdr = (f"CASE WHEN starts_with(lower({t}), lower({title})) AND length({hdr}) > 0 "
              f"THEN substr({after}, length({hdr}) + 1) ELSE {t} END")
    no_con = f"regexp_replace({no_hdr}, {S.q('(?i)^[0-9]+' + S.WS + '*Contributors?.*?' + chr(10))}, '')"
    return S.strip(no_con)


@query("scraped_header", f"""
SELECT doc_id, length(c) AS clean_len, md5(c) AS clean_md5
FROM (SELECT doc_id, {_header_sql(_scraped_sql()[1], _scraped_sql()[0])} AS c FROM documents)
""")
def scraped_header(spark, sf):
    """X11: documents with a "<title> Lyrics" header and a contributors line
    (every third), with a differently cased header, or with none."""
    d = table(spark, sf, "documents")
    title, raw = _scraped()
    c = X.strip_scraped_header(raw, title)
    return d.select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("clean_len"),
                                                   F.md5("c").alias("clean_md5"))


def _genre_raw():
    g = _pick(GENRE_WORDS, _k())
    return F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  Genre:"), F.upper(g), F.lit(" "))).otherwise(g)


@query("genre_key", f"""
SELECT event_id, replace(lower({S.strip('g')}), 'genre:', '') AS genre_key
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '  Genre:' || upper({_pick_sql(GENRE_WORDS, K_SQL)}) || ' '
                            ELSE {_pick_sql(GENRE_WORDS, K_SQL)} END AS g FROM events)
""")
def genre_key(spark, sf):
    """X12 on padded, upper-cased ``genre:`` hints."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", X.genre_key(_genre_raw()).alias("genre_key"))


@query("track_key", f"""
SELECT c_custkey, lower({S.strip("' ' || c_mktsegment || chr(9)")}) AS artist_key,
       lower({S.strip("upper(c_name) || '  '")}) AS title_key
FROM customer
""")
def track_key(spark, sf):
    """X10 on padded, re-cased names."""
    c = table(spark, sf, "customer")
    k = X.track_key(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\t")),
                    F.concat(F.upper("c_name"), F.lit("  ")))
    return c.select("c_custkey", k["artist_key"].alias("artist_key"), k["title_key"].alias("title_key"))


@query("query_text", f"""
SELECT c_custkey, 'track:' || c_name || ' artist:' || c_mktsegment AS strict_query,
       c_name || ' ' || c_mktsegment AS loose_query,
       'genre:' || {_pick_sql(GENRE_WORDS[:-1], 'c_custkey')} || ' year:' || (2005 + c_custkey % 21) || '-'
         || (2005 + c_custkey % 21) AS genre_query
FROM customer
""")
def query_text(spark, sf):
    """Strict and loose search strings, and a genre/year query."""
    c = table(spark, sf, "customer")
    year = (F.col("c_custkey") % 21 + 2005).cast("int")
    return c.select("c_custkey", X.search_query("c_name", "c_mktsegment").alias("strict_query"),
                    X.loose_query("c_name", "c_mktsegment").alias("loose_query"),
                    F.format_string("genre:%s year:%d-%d", _pick(GENRE_WORDS[:-1], F.col("c_custkey")), year, year)
                    .alias("genre_query"))


# --------------------------------------------------------------------------
# Sorted scores, taxonomy order, label set
# --------------------------------------------------------------------------

def _score_map(v, e):
    keys = F.array(*[F.lit(n) for n, _, _ in VIBE_ANCHORS])
    vals = []
    for _, av, ae in VIBE_ANCHORS:
        dv, de = v - F.lit(av), e - F.lit(ae)
        vals.append(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * (dv * dv + de * de)))
    return F.map_from_arrays(keys, F.array(*vals))


def _topk_sql() -> str:
    v, e = "l_discount * 10", "l_quantity / 50"
    items = ", ".join(
        f"{{'s': -(1.0 / (1.0 + 10.0 * (({v} - {av}::DOUBLE) * ({v} - {av}::DOUBLE) + ({e} - {ae}::DOUBLE) * "
        f"({e} - {ae}::DOUBLE)))), 'n': {S.q(n)}}}" for n, av, ae in VIBE_ANCHORS)
    cols = ", ".join(f"l[{i}].n AS top{i}, round(-l[{i}].s, 3) AS top{i}_score" for i in (1, 2, 3))
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cols}
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_sort([{items}]) AS l FROM lineitem)"""


@query("topk_scores", _topk_sql())
def topk_scores(spark, sf):
    """O3: per row, the class-score map sorted by raw score (ties by name),
    rounded to 3 places; the first three entries."""
    m = mood_points(spark, sf)
    top = L.sorted_scores(_score_map(F.col("valence"), F.col("energy")))
    d = m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.slice(top, 1, 3).alias("t"))
    cols = []
    for i in range(3):
        cols += [F.col("t")[i]["key"].alias(f"top{i + 1}"), F.col("t")[i]["value"].alias(f"top{i + 1}_score")]
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols)


_VIBE_SQL = S.nearest_vibe("l_discount * 10", "l_quantity / 50")
_PRED_SQL = S.nearest_vibe(S.clip("l_tax / 0.08"), S.clip("l_discount * 10"))
_POS_SQL = "CASE label " + " ".join(f"WHEN {S.q(v)} THEN {i}" for i, v in enumerate(VIBES)) + " ELSE 99 END"


@query("vibe_order", f"""
WITH u AS (SELECT DISTINCT label FROM (SELECT {_VIBE_SQL} AS label FROM lineitem
                                       UNION ALL SELECT {_PRED_SQL} FROM lineitem))
SELECT label, {_POS_SQL} AS pos, row_number() OVER (ORDER BY {_POS_SQL}, label) AS rank FROM u
""")
def vibe_order(spark, sf):
    """Labels seen in truth or prediction, in taxonomy order (unknown last)."""
    m = mood_points(spark, sf)
    m = m.select("valence", "energy", L.clip01("pred_valence").alias("pv"), L.clip01("pred_energy").alias("pe"))
    labs = m.select(F.inline(F.array(F.struct(L.nearest_anchor("valence", "energy").alias("label")),
                                     F.struct(L.nearest_anchor("pv", "pe").alias("label"))))).distinct()
    labs = labs.withColumn("pos", L.vibe_index("label"))
    from pyspark.sql import Window
    w = Window.orderBy("pos", "label")  # over the distinct labels only (bounded by the taxonomy)
    return labs.withColumn("rank", F.row_number().over(w).cast("bigint"))


@query("label_set", f"""
SELECT array_to_string(list_sort(list_distinct(list({_VIBE_SQL}))), '|') AS labels,
       count(DISTINCT {_VIBE_SQL}) AS n_labels
FROM lineitem
""")
def label_set(spark, sf):
    """Sorted distinct labels (collect_set keeps one small set per task)."""
    m = mood_points(spark, sf).select(L.nearest_anchor("valence", "energy").alias("v"))
    return m.agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("labels"),
                 F.countDistinct("v").alias("n_labels"))


# --------------------------------------------------------------------------
# Unions and differences
# --------------------------------------------------------------------------

@query("union_missing", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, round(c_acctbal, 6) AS acctbal,
       c_mktsegment AS segment, 'customer' AS kind FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 6), NULL, 'supplier' FROM supplier
""")
def union_missing(spark, sf):
    """Union by name; columns one side lacks come back NULL."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                            F.col("c_nationkey").alias("nation"), r6(F.col("c_acctbal")).alias("acctbal"),
                                            F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                            F.col("s_nationkey").alias("nation"), r6(F.col("s_acctbal")).alias("acctbal"),
                                            F.lit("supplier").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@query("key_difference", """
SELECT DISTINCT c_custkey AS custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)
""")
def key_difference(spark, sf):
    """Wanted keys that aren't present: every row whose key exists on the
    other side goes (left anti join on distinct keys)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).distinct()
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")).distinct()
    return c.join(o, "custkey", "left_anti")


@query("feature_union", f"""
SELECT doc_id, len(list_distinct(list_concat({S.tokens('text')}, {S.word_runs('text')}, [lang, source])))
  AS features_used
FROM documents
""")
def feature_union(spark, sf):
    """U4: size of the union of three per-row name lists."""
    d = table(spark, sf, "documents")
    u = F.array_distinct(F.concat(X.tokens("text"), X.word_runs("text"), F.array("lang", "source")))
    return d.select("doc_id", F.size(u).alias("features_used"))


# --------------------------------------------------------------------------
# Track lists
# --------------------------------------------------------------------------

@query("track_lines", f"""
SELECT {S.strip(_ARTIST_SQL)} || ' - ' || {S.strip('c_name')} AS line
FROM customer
WHERE NOT {S.missing(_ARTIST_SQL)} AND NOT {S.missing('c_name')}
  AND {S.usable("repeat('la ', (c_nationkey * 2)::INTEGER)")}
""")
def track_lines(spark, sf):
    """``Artist - Title`` for customers with valid names and usable lyrics."""
    c = table(spark, sf, "customer")
    songs = c.select(_artist().alias("artist"), F.col("c_name").alias("title"),
                     F.repeat(F.lit("la "), (F.col("c_nationkey") * 2).cast("int")).alias("lyrics"))
    return SG.track_lines(songs)


_LINE_SQL = ("CASE c_custkey % 7 WHEN 0 THEN c_mktsegment || ' - ' || c_name WHEN 1 THEN c_mktsegment || '|' || c_name "
             "WHEN 2 THEN c_mktsegment || ',' || c_name WHEN 3 THEN '# ' || c_name "
             "WHEN 4 THEN c_mktsegment || ' - ' || c_name || ' - live' WHEN 5 THEN c_mktsegment || ' - ' "
             "ELSE c_mktsegment || ' ' || c_name END")


def _line():
    m = F.col("c_custkey") % 7
    seg, nm = F.col("c_mktsegment"), F.col("c_name")
    return (F.when(m == 0, F.concat(seg, F.lit(" - "), nm)).when(m == 1, F.concat(seg, F.lit("|"), nm))
             .when(m == 2, F.concat(seg, F.lit(","), nm)).when(m == 3, F.concat(F.lit("# "), nm))
             .when(m == 4, F.concat(seg, F.lit(" - "), nm, F.lit(" - live"))).when(m == 5, F.concat(seg, F.lit(" - ")))
             .otherwise(F.concat(seg, F.lit(" "), nm)))


def _parse_sql(line: str):
    s = S.strip(line)
    sep = (f"(CASE WHEN contains({s}, ' - ') THEN ' - ' WHEN contains({s}, '|') THEN '|' "
           f"WHEN contains({s}, ',') THEN ',' END)")
    at = f"instr({s}, {sep})"
    artist = S.strip(f"substr({s}, 1, {at} - 1)")
    title = S.strip(f"substr({s}, {at} + length({sep}))")
    ok = f"(length({s}) > 0 AND NOT starts_with({s}, '#') AND {sep} IS NOT NULL AND length({artist}) > 0 AND length({title}) > 0)"
    return ok, artist, title


_OK, _PA, _PT = _parse_sql("line")


@query("track_pairs", f"""
SELECT c_custkey, {_PA} AS artist, {_PT} AS title
FROM (SELECT c_custkey, {_LINE_SQL} AS line FROM customer)
WHERE {_OK}
""")
def track_pairs(spark, sf):
    """Track lines with every separator form, comments, extra separators,
    empty parts and no separator; parsed on the first separator."""
    c = table(spark, sf, "customer").select("c_custkey", _line().alias("line"))
    p = c.select("c_custkey", SG.parse_track_line(F.col("line")).alias("t")).filter("t IS NOT NULL")
    return p.select("c_custkey", "t.artist", "t.title")


@query("track_map", """
WITH l AS (SELECT c_mktsegment || ' ' || c_nationkey AS artist, min(c_custkey) AS pos,
                  arg_max(string_split(c_name, '#'), c_custkey) AS titles FROM customer GROUP BY 1),
     e AS (SELECT pos, artist, unnest(titles) AS title, unnest(range(0, len(titles))) AS tpos FROM l)
SELECT pos, tpos::INTEGER AS tpos, artist || ' - ' || title AS line FROM e
QUALIFY row_number() OVER (PARTITION BY lower(artist) || '|' || lower(title) ORDER BY pos, tpos) = 1
""")
def track_map(spark, sf):
    """Artist -> titles lists (segment and nation -> parts of the name);
    of an artist's lists the last counts; first line per lower-cased
    artist|title key."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"),
                                            F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("artist"),
                                            F.split("c_name", "#").alias("titles"))
    return SG.track_map(c).select("pos", F.col("tpos").cast("int").alias("tpos"), "line")


# --------------------------------------------------------------------------
# Numeric aliases, file names, rule scores
# --------------------------------------------------------------------------

def _catalog_strings(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") % 4 == 0, F.lit("abc")).otherwise(((F.col("p_retailprice") - 900) / 100).cast("string"))
         .alias("valence"),
        F.when(F.col("p_size") % 3 == 0, (F.col("p_size") / 50).cast("string")).alias("audio_valence"),
        (F.col("p_size") / 50).cast("string").alias("energy"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise((F.col("p_size") * 4).cast("string")).alias("tempo"),
        (F.col("p_size") % 2).cast("string").alias("mode"),
        F.when(F.col("p_size") > 45, F.lit("1")).alias("audio_mode"),
        (F.col("p_size") % 12).cast("string").alias("key"))


_CAT_COLS = {"valence", "audio_valence", "energy", "tempo", "mode", "audio_mode", "key"}


def _alias_sql(feat: str) -> str:
    """X17 in SQL: the last present alias that parses, else 0.0."""
    srcs = [s for s, f in SPOTIFY_SOURCES if f == feat and s in _CAT_COLS]
    if not srcs:
        return "0.0::DOUBLE"
    return "coalesce(" + ", ".join(f"TRY_CAST({s} AS DOUBLE)" for s in reversed(srcs)) + ", 0.0::DOUBLE)"


_ALIAS_COLS = ", ".join(f"round({_alias_sql(f)}, 6) AS {f}" for f in SPOTIFY_FEATURES)


@query("numeric_alias", f"""
WITH c AS (
  SELECT p_partkey,
         CASE WHEN p_size % 4 = 0 THEN 'abc' ELSE CAST((p_retailprice - 900) / 100 AS VARCHAR) END AS valence,
         CASE WHEN p_size % 3 = 0 THEN CAST(p_size / 50 AS VARCHAR) END AS audio_valence,
         CAST(p_size / 50 AS VARCHAR) AS energy,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size * 4 AS VARCHAR) END AS tempo,
         CAST(p_size % 2 AS VARCHAR) AS mode, CASE WHEN p_size > 45 THEN '1' END AS audio_mode,
         CAST(p_size % 12 AS VARCHAR) AS key
  FROM part)
SELECT p_partkey, {_ALIAS_COLS} FROM c
""")
def numeric_alias(spark, sf):
    """Catalog columns as text (some unparseable or blank), aliases that
    win over the main column, absent columns -> 0.0."""
    d = _catalog_strings(spark, sf)
    feats = L.numeric_features(d)
    return d.select("p_partkey", *[r6(v).alias(k) for k, v in feats.items()])


@query("safe_name", """
SELECT c_custkey, translate(c_mktsegment || '/x' || '_' || c_name || ' a b', '/ ', '-_') AS file_name FROM customer
""")
def safe_name(spark, sf):
    """X16."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.safe_file_name(F.concat(F.col("c_mktsegment"), F.lit("/x")),
                                                  F.concat(F.col("c_name"), F.lit(" a b"))).alias("file_name"))


@query("rule_scores", f"""
SELECT event_id, round({S.clip('(value / 250 - 1) * 0.5 + 0.5')}, 6) AS valence,
       round({S.clip(f'0.4 * (value / 180.0) + 0.6 * least(({K_SQL} / 1000) * 10, 1.0)')}, 6) AS energy
FROM events
""")
def rule_scores(spark, sf):
    """compound = value / 250 - 1, tempo = value, rms = props.k / 1000."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", r6(L.rule_valence(F.col("value") / 250 - 1)).alias("valence"),
                     r6(L.rule_energy(F.col("value"), _k() / 1000)).alias("energy"))
