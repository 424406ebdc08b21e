"""Queries for the label cascade, payloads, discovery, splits and
evaluation tables (J9-J11, S11-S13, O1, O2, W3, W4, A11, W6, A3-A8, A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.operators import lookup as LK
from versewise.operators import metrics as M
from versewise.operators import sampling as SM
from versewise.plans import sqltext as S
from versewise.plans.queries import query, r6
from versewise.schema import GENRE_ESTIMATES, MARKET_GENRES, MAX_TAGS, TAG_ANCHORS, VIBES
from versewise.sources import payloads as P
from versewise.sources.tables import mood_points, table

# Fixture vocabularies indexed by the props "k" value, user id and event id.
TAG_WORDS = [t for t, _, _ in TAG_ANCHORS] + ["unknown"]
GENRE_WORDS = [g for g, _, _ in GENRE_ESTIMATES] + [""]
MARKET_WORDS = [m for m, _ in MARKET_GENRES] + ["US", "gb"]


def _k():
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _arr_sql(words) -> str:
    return "[" + ", ".join(S.q(w) for w in words) + "]"


def _pick(words, idx):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (idx % len(words) + 1).cast("int"))


def _pick_sql(words, idx: str) -> str:
    return f"{_arr_sql(words)}[(({idx}) % {len(words)}) + 1]"


def _tags():
    k = _k()
    return F.array(F.col("event_type"), F.concat(F.lit(" "), F.upper(_pick(TAG_WORDS, k)), F.lit(" ")),
                   _pick(TAG_WORDS, k + 3))


TAGS_SQL = (f"[event_type, ' ' || upper({_pick_sql(TAG_WORDS, K_SQL)}) || ' ', "
            f"{_pick_sql(TAG_WORDS, K_SQL + ' + 3')}]")


def _tag_case(t: str, which: int) -> str:
    return "CASE " + " ".join(f"WHEN {t} = {S.q(n)} THEN {row[which]}::DOUBLE"
                              for n, *row in TAG_ANCHORS) + " END"


def _tag_mood_sql(tags: str) -> str:
    hits = f"list_filter(list_transform({tags}, lambda t: lower({S.strip('t')})), lambda t: {_tag_case('t', 0)} IS NOT NULL)"
    v = f"list_sum(list_transform({hits}, lambda t: {_tag_case('t', 0)})) / len({hits})"
    e = f"list_sum(list_transform({hits}, lambda t: {_tag_case('t', 1)})) / len({hits})"
    return f"CASE WHEN len({hits}) > 0 THEN {v} END", f"CASE WHEN len({hits}) > 0 THEN {e} END"


@query("tag_mood", f"""
SELECT event_id, round(v, 6) AS valence, round(e, 6) AS energy
FROM (SELECT event_id, {_tag_mood_sql(TAGS_SQL)[0]} AS v, {_tag_mood_sql(TAGS_SQL)[1]} AS e FROM events)
""")
def tag_mood(spark, sf):
    """Each event's tags = its type, a tag word chosen by props.k
    (upper-cased, padded) and another by k + 3."""
    ev = table(spark, sf, "events").select("event_id", _tags().alias("tags"))
    m = LK.tag_mood(F.col("tags"))
    return ev.select("event_id", r6(m["valence"]).alias("valence"), r6(m["energy"]).alias("energy"))


def _candidates(spark, sf):
    ev = table(spark, sf, "events")
    k = _k()
    own = F.col("event_type") == "purchase"
    tags = (F.when(F.col("event_type") == "view", _tags())
             .when(F.col("event_type") == "click", F.array(F.lit("unknown"), F.lit("foo")))
             .otherwise(F.array().cast("array<string>")))
    hint = _pick(GENRE_WORDS, F.col("user_id"))
    hint = F.when((F.col("user_id") % 2 == 0) & (hint != ""), F.concat(F.lit("genre:"), hint)).otherwise(hint)
    return ev.select("event_id",
                     F.when(own, F.col("value") / 500).alias("valence"),
                     F.when(own, (k % 100) / 100).alias("energy"),
                     tags.alias("lastfm_tags"), hint.alias("genre_hint"),
                     _pick(MARKET_WORDS, F.col("event_id")).alias("market"))


def _cascade_sql() -> str:
    own = "event_type = 'purchase'"
    tags = (f"CASE WHEN event_type = 'view' THEN {TAGS_SQL} WHEN event_type = 'click' THEN ['unknown', 'foo'] "
            f"ELSE []::VARCHAR[] END")
    hint0 = _pick_sql(GENRE_WORDS, "user_id")
    hint = f"CASE WHEN user_id % 2 = 0 AND {hint0} <> '' THEN 'genre:' || {hint0} ELSE {hint0} END"
    market = _pick_sql(MARKET_WORDS, "event_id")
    tv, te = _tag_mood_sql("tags")

    def gcase(g, which):
        key = f"replace(lower({S.strip(g)}), 'genre:', '')"
        return "CASE " + " ".join(f"WHEN {key} = {S.q(n)} THEN {row[which]}::DOUBLE"
                                  for n, *row in GENRE_ESTIMATES) + " END"

    mg = "CASE " + " ".join(f"WHEN upper(market) = {S.q(m)} THEN {S.q(g)}" for m, g in MARKET_GENRES) + " ELSE 'pop' END"
    return f"""
WITH c AS (
  SELECT event_id, CASE WHEN {own} THEN value / 500 END AS valence,
         CASE WHEN {own} THEN ({K_SQL} % 100) / 100 END AS energy,
         {tags} AS tags, {hint} AS genre_hint, {market} AS market
  FROM events),
m AS (
  SELECT event_id, valence, energy, {tv} AS tv, {te} AS te,
         CASE WHEN genre_hint IS NOT NULL AND genre_hint <> '' THEN {gcase('genre_hint', 0)} END AS gv,
         CASE WHEN genre_hint IS NOT NULL AND genre_hint <> '' THEN {gcase('genre_hint', 1)} END AS ge,
         {gcase(mg, 0)} AS mv, {gcase(mg, 1)} AS me
  FROM c),
x AS (
  SELECT event_id,
         CASE WHEN valence IS NOT NULL AND energy IS NOT NULL THEN valence WHEN tv IS NOT NULL THEN tv
              WHEN gv IS NOT NULL THEN gv ELSE mv END AS v,
         CASE WHEN valence IS NOT NULL AND energy IS NOT NULL THEN energy WHEN tv IS NOT NULL THEN te
              WHEN gv IS NOT NULL THEN ge ELSE me END AS e,
         CASE WHEN valence IS NOT NULL AND energy IS NOT NULL THEN 'spotify' WHEN tv IS NOT NULL THEN 'lastfm'
              WHEN gv IS NOT NULL THEN 'genre_estimate' ELSE 'market_estimate' END AS label_source
  FROM m)
SELECT event_id, round(v, 6) AS valence, round(e, 6) AS energy, label_source,
       {S.nearest_vibe('v', 'e')} AS vibe
FROM x"""


@query("label_cascade", _cascade_sql())
def label_cascade(spark, sf):
    """Purchases carry their own labels, views carry tags, clicks
    carry only unknown tags, the rest fall to the genre hint (by user) or
    the market (by event)."""
    out = LK.label_cascade(_candidates(spark, sf))
    return out.select("event_id", r6(F.col("valence")).alias("valence"), r6(F.col("energy")).alias("energy"),
                      "label_source", "vibe")


# --------------------------------------------------------------------------
# payloads
# --------------------------------------------------------------------------

def _payloads(spark, sf):
    ev = table(spark, sf, "events")
    k = _k()
    artists = F.when(F.col("value") < 50, F.array().cast("array<struct<name:string>>")).otherwise(
        F.array(F.struct(F.concat(F.lit("artist"), F.col("user_id").cast("string")).alias("name")),
                F.struct(F.lit("feat").alias("name"))))
    track = F.to_json(F.struct(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.concat_ws("-", F.col("event_type"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("value") <= 100, F.lit("http://p")).alias("preview_url"),
        artists.alias("artists"),
        F.struct(F.col("event_type").alias("name")).alias("album"),
        F.struct((F.col("value") / 500).alias("valence"), ((k % 100) / 100).alias("energy")).alias("features")))
    tag_objs = F.transform(F.sequence(F.lit(0), k % 13), lambda i: F.struct(
        F.when(i % 5 == 4, F.lit("")).otherwise(_pick(TAG_WORDS, i + k)).alias("name")))
    arr_json = F.to_json(F.struct(F.struct(F.lit("http://t").alias("url"),
                                           F.struct(tag_objs.alias("tag")).alias("toptags"),
                                           F.struct(F.col("event_type").alias("title")).alias("album")).alias("track")))
    obj_json = F.to_json(F.struct(F.struct(F.lit("http://t").alias("url"),
                                           F.struct(F.struct(_pick(TAG_WORDS, k).alias("name")).alias("tag")).alias("toptags"),
                                           ).alias("track")))
    tags = F.when(k % 2 == 0, arr_json).otherwise(obj_json)
    return ev.select("event_id", "user_id", track.alias("track_json"), tags.alias("tag_json"))


@query("json_flatten", f"""
WITH b AS (SELECT event_id, user_id, event_type, value, {K_SQL} AS k FROM events)
SELECT event_id, 'e' || event_id AS spotify_id, event_type || '-' || user_id AS title,
       CASE WHEN value < 50 THEN 'Unknown' ELSE 'artist' || user_id END AS artist,
       event_type AS album, CASE WHEN value <= 100 THEN 'http://p' END AS preview_url,
       round(value / 500, 6) AS valence,
       CASE WHEN k % 2 = 0 THEN array_to_string(list_slice(list_filter(list_transform(range(0, (k % 13) + 1),
                 lambda i: CASE WHEN i % 5 = 4 THEN '' ELSE {_pick_sql(TAG_WORDS, 'i + k')} END),
                 lambda x: x <> ''), 1, 10), '|')
            ELSE {_pick_sql(TAG_WORDS, 'k')} END AS tags,
       CASE WHEN k % 2 = 0 THEN event_type END AS tag_album
FROM b
""")
def json_flatten(spark, sf):
    """S11 + S12: each event rendered as a track payload and a tag payload
    (tags an array for even k, a single object for odd k), parsed back."""
    p = _payloads(spark, sf)
    t = P.flatten_tags(P.flatten_track(p, "track_json"), "tag_json", k=MAX_TAGS)
    return t.select("event_id", "spotify_id", "title", "artist", "album", "preview_url",
                    r6(F.col("valence")).alias("valence"), F.array_join("lastfm_tags", "|").alias("tags"),
                    F.col("lastfm_album").alias("tag_album"))


@query("search_explode", f"""
WITH b AS (SELECT event_id, user_id, {K_SQL} AS k FROM events),
it AS (SELECT event_id, user_id, unnest(range(0, k % 4)) AS item_pos FROM b),
c AS (SELECT event_id, item_pos,
             CASE WHEN item_pos = 2 THEN '' ELSE 'u' || user_id || '-' || item_pos END AS spotify_id,
             'song' || item_pos AS title, 'artist' || user_id AS artist
      FROM it)
SELECT spotify_id, title, artist, event_id, item_pos::INTEGER AS item_pos FROM c
WHERE spotify_id <> ''
QUALIFY row_number() OVER (PARTITION BY spotify_id ORDER BY event_id, item_pos) = 1
""")
def search_explode(spark, sf):
    """S13 + F6 + W1: each event's search payload holds k % 4 items (the third
    has no id); ids repeat across a user's events, the first one wins."""
    ev = table(spark, sf, "events")
    k = _k()
    items = F.transform(F.sequence(F.lit(0), k % 4 - 1), lambda i: F.struct(
        F.when(i == 2, F.lit("")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"),
                                                     i.cast("string"))).alias("id"),
        F.concat(F.lit("song"), i.cast("string")).alias("name"),
        F.array(F.struct(F.concat(F.lit("artist"), F.col("user_id").cast("string")).alias("name"))).alias("artists")))
    items = F.when(k % 4 > 0, items).otherwise(F.array())
    payload = F.to_json(F.struct(F.struct(items.alias("items")).alias("tracks")))
    d = ev.select("event_id", payload.alias("search_json"))
    out = P.explode_search(d, "search_json", ["event_id"])
    return out.select("spotify_id", "title", "artist", "event_id", F.col("item_pos").cast("int").alias("item_pos"))


# --------------------------------------------------------------------------
# Discovery sample
# --------------------------------------------------------------------------

POOL_N = 2500
ACCEPT_N = 100
PER_ARTIST = 2
SEED = 42

POOL_SQL = f"""
SELECT event_id, user_id, value,
       row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '|{SEED}'), event_id) AS pool_pos
FROM events
QUALIFY pool_pos <= {POOL_N}"""

ACCEPT_SQL = f"""
SELECT * FROM (
  SELECT * FROM ({POOL_SQL}) WHERE value > 5
  QUALIFY row_number() OVER (PARTITION BY lower('u' || user_id) ORDER BY pool_pos) <= {PER_ARTIST})
ORDER BY pool_pos LIMIT {ACCEPT_N}"""


def _pool(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return SM.seeded_pool(ev, "event_id", SEED, POOL_N).withColumn(
        "artist", F.concat(F.lit("u"), F.col("user_id").cast("string")))


@query("seeded_pool", f"SELECT event_id, pool_pos FROM ({POOL_SQL})")
def seeded_pool(spark, sf):
    return _pool(spark, sf).select("event_id", F.col("pool_pos").cast("bigint").alias("pool_pos"))


@query("artist_cap", f"SELECT event_id, pool_pos FROM ({ACCEPT_SQL})")
def artist_cap(spark, sf):
    """W3 + W4: accept events worth more than 5, at most two per user, stop
    after 100 acceptances."""
    pool = _pool(spark, sf)
    acc = SM.accept_until(pool, F.col("value") > 5, "artist", "pool_pos", ACCEPT_N, PER_ARTIST)
    return acc.select("event_id", F.col("pool_pos").cast("bigint").alias("pool_pos"))


@query("discover_summary", f"""
WITH a AS ({ACCEPT_SQL}), p AS ({POOL_SQL})
SELECT count(*) AS tracks_saved, {ACCEPT_N}::BIGINT AS target,
       CASE WHEN count(*) >= {ACCEPT_N} THEN max(pool_pos) ELSE (SELECT count(*) FROM p) END AS candidates_scanned,
       (SELECT count(*) FROM p) AS pool_size,
       CASE WHEN count(*) >= {ACCEPT_N} THEN max(pool_pos) ELSE (SELECT count(*) FROM p) END - count(*) AS skipped,
       count(DISTINCT 'u' || user_id) AS unique_artists
FROM a
""")
def discover_summary(spark, sf):
    pool = _pool(spark, sf)
    acc = SM.accept_until(pool, F.col("value") > 5, "artist", "pool_pos", ACCEPT_N, PER_ARTIST)
    return SM.discover_summary(pool, acc, "pool_pos", ACCEPT_N)


# --------------------------------------------------------------------------
# Exact stratified split and class counts
# --------------------------------------------------------------------------

TEST_PCT = 20


@query("class_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def class_counts(spark, sf):
    return SM.class_counts(table(spark, sf, "documents"), "lang")


@query("stratified_split", f"""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT sum(n) AS total, (sum(n) * {TEST_PCT} + 99) // 100 AS test_n FROM c),
q AS (SELECT c.lang, (c.n * t.test_n) // t.total AS base, (c.n * t.test_n) % t.total AS rem,
             t.test_n - sum((c.n * t.test_n) // t.total) OVER () AS extra
      FROM c, t),
qq AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, lang) <= extra THEN 1 ELSE 0 END AS quota
       FROM q)
SELECT d.doc_id, d.lang,
       CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY md5(CAST(d.doc_id AS VARCHAR) || '|{SEED}'), d.doc_id)
                 <= qq.quota THEN 'test' ELSE 'train' END AS split
FROM documents d JOIN qq ON d.lang = qq.lang
""")
def stratified_split(spark, sf):
    """20 % test, stratified by language, md5(id|42) order."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return SM.stratified_split(d, "lang", "doc_id", test_pct=TEST_PCT, seed=SEED)


@query("split_null_labels", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang FROM documents),
c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
t AS (SELECT sum(n) AS total, (sum(n) * {TEST_PCT} + 99) // 100 AS test_n FROM c),
q AS (SELECT c.lang, (c.n * t.test_n) // t.total AS base, (c.n * t.test_n) % t.total AS rem,
             t.test_n - sum((c.n * t.test_n) // t.total) OVER () AS extra FROM c, t),
qq AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, lang NULLS FIRST) <= extra THEN 1 ELSE 0 END AS quota FROM q)
SELECT d.doc_id, d.lang,
       CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY md5(CAST(d.doc_id AS VARCHAR) || '|{SEED}'), d.doc_id)
                 <= qq.quota THEN 'test' ELSE 'train' END AS split
FROM d JOIN qq ON d.lang IS NOT DISTINCT FROM qq.lang
""")
def split_null_labels(spark, sf):
    """Rows without a label are a class of their own and all stay."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    return SM.stratified_split(d, "lang", "doc_id", test_pct=TEST_PCT, seed=SEED)


# --------------------------------------------------------------------------
# Evaluation tables on lineitem truth / prediction pairs
# --------------------------------------------------------------------------

def _pairs(spark, sf):
    m = mood_points(spark, sf)
    m = m.select("valence", "energy", L.clip01("pred_valence").alias("pv"), L.clip01("pred_energy").alias("pe"))
    return m.select("valence", "energy", "pv", "pe", L.nearest_anchor("valence", "energy").alias("vibe"),
                    L.nearest_anchor("pv", "pe").alias("pred_vibe"))


PAIRS_SQL = f"""
SELECT l_discount * 10 AS valence, l_quantity / 50 AS energy, {S.clip('l_tax / 0.08')} AS pv,
       {S.clip('l_discount * 10')} AS pe,
       {S.nearest_vibe('l_discount * 10', 'l_quantity / 50')} AS vibe,
       {S.nearest_vibe(S.clip('l_tax / 0.08'), S.clip('l_discount * 10'))} AS pred_vibe
FROM lineitem"""


def _reg_sql(t: str, p: str) -> str:
    return (f"count(*) AS n, round(avg(abs({t} - {p})), 6) AS mae, "
            f"round(1.0 - sum(({t} - {p}) * ({t} - {p})) / nullif(var_pop({t}) * count(*), 0.0), 6) AS r2")


@query("regression_metrics", f"""
SELECT 'valence' AS target, {_reg_sql('valence', 'pv')} FROM ({PAIRS_SQL})
UNION ALL
SELECT 'energy' AS target, {_reg_sql('energy', 'pe')} FROM ({PAIRS_SQL})
""")
def regression_metrics(spark, sf):
    """A4: MAE and R^2 of clipped predictions, per target, one pass."""
    p = _pairs(spark, sf)
    stacked = p.select(F.inline(F.array(
        F.struct(F.lit("valence").alias("target"), F.col("valence").alias("y"), F.col("pv").alias("p")),
        F.struct(F.lit("energy").alias("target"), F.col("energy").alias("y"), F.col("pe").alias("p")))))
    out = M.regression_metrics(stacked, "y", "p", ["target"])
    return out.select("target", "n", r6(F.col("mae")).alias("mae"), r6(F.col("r2")).alias("r2"))


_CR_SQL = f"""
WITH p AS ({PAIRS_SQL}),
pc AS (SELECT vibe AS actual, pred_vibe AS predicted, count(*) AS n FROM p GROUP BY 1, 2),
labs AS (SELECT actual AS label FROM pc UNION SELECT predicted FROM pc),
per AS (
  SELECT l.label,
         coalesce((SELECT sum(n) FROM pc WHERE actual = l.label), 0) AS support,
         coalesce((SELECT sum(n) FROM pc WHERE predicted = l.label), 0) AS pn,
         coalesce((SELECT sum(n) FROM pc WHERE actual = l.label AND predicted = l.label), 0) AS tp
  FROM labs l),
m AS (SELECT label, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support
FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 sum(support)::BIGINT FROM f"""


@query("class_report", _CR_SQL)
def class_report(spark, sf):
    """Per-class precision / recall / F1 / support and the three summary rows."""
    rep = M.class_report(_pairs(spark, sf), "vibe", "pred_vibe")
    return rep.select("label", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                      r6(F.col("f1")).alias("f1"), "support")


VIBE_POS_SQL = "CASE vibe " + " ".join(f"WHEN {S.q(v)} THEN {i}" for i, v in enumerate(VIBES)) + " ELSE 99 END"


@query("confusion", f"""
WITH p AS ({PAIRS_SQL})
SELECT vibe AS actual, {VIBE_POS_SQL} AS actual_pos,
       {', '.join(f"count(*) FILTER (WHERE pred_vibe = {S.q(v)}) AS {v}" for v in VIBES)},
       count(*) FILTER (WHERE pred_vibe NOT IN ({', '.join(map(S.q, VIBES))})) AS other
FROM p GROUP BY vibe
""")
def confusion(spark, sf):
    """Actual x predicted counts over the taxonomy."""
    return M.confusion(_pairs(spark, sf), "vibe", "pred_vibe")


@query("confusion_other_class", f"""
WITH p AS ({PAIRS_SQL}),
q AS (SELECT vibe, CASE pred_vibe WHEN 'dark' THEN 'weird' WHEN 'chill' THEN NULL ELSE pred_vibe END AS pred_vibe FROM p)
SELECT vibe AS actual, {VIBE_POS_SQL} AS actual_pos,
       {', '.join(f"count(*) FILTER (WHERE pred_vibe = {S.q(v)}) AS {v}" for v in VIBES)},
       count(*) FILTER (WHERE pred_vibe IS NULL OR pred_vibe = 'weird') AS other
FROM q GROUP BY vibe
""")
def confusion_other_class(spark, sf):
    """Predictions outside the taxonomy, or none, stay in the table."""
    p = _pairs(spark, sf)
    odd = F.when(F.col("pred_vibe") == "dark", "weird").when(F.col("pred_vibe") != "chill", F.col("pred_vibe"))
    return M.confusion(p.withColumn("pred_vibe", odd), "vibe", "pred_vibe")


@query("ablation", f"""
WITH b AS (SELECT l_discount * 10 AS valence, l_quantity / 50 AS energy,
                  l_tax / 0.08 AS a, l_discount * 10 AS c FROM lineitem),
v AS (SELECT 'full' AS variant, valence, energy, {S.clip('0.5 * a + 0.5 * c')} AS pv, {S.clip('c')} AS pe FROM b
      UNION ALL
      SELECT 'zeroed', valence, energy, {S.clip('0.5 * a')}, {S.clip('0.0')} FROM b)
SELECT variant, round(avg(abs(valence - pv)), 6) AS valence_mae, round(avg(abs(energy - pe)), 6) AS energy_mae,
       round(avg(CAST({S.nearest_vibe('valence', 'energy')} = {S.nearest_vibe('pv', 'pe')} AS DOUBLE)), 6) AS accuracy
FROM v GROUP BY variant
""")
def ablation(spark, sf):
    """A8 + F11: the same metrics with the catalog-like input zeroed."""
    li = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("valence"),
                                             (F.col("l_quantity") / 50).alias("energy"),
                                             (F.col("l_tax") / 0.08).alias("a"), (F.col("l_discount") * 10).alias("c"))
    both = li.select(F.inline(F.array(
        F.struct(F.lit("full").alias("variant"), "valence", "energy", "a", "c"),
        F.struct(F.lit("zeroed").alias("variant"), "valence", "energy", "a", F.lit(0.0).alias("c")))))
    both = both.withColumns({"pv": L.clip01(F.lit(0.5) * F.col("a") + F.lit(0.5) * F.col("c")),
                             "pe": L.clip01(F.col("c"))})
    hit = (L.nearest_anchor("valence", "energy") == L.nearest_anchor("pv", "pe")).cast("double")
    return both.groupBy("variant").agg(r6(F.avg(F.abs(F.col("valence") - F.col("pv")))).alias("valence_mae"),
                                       r6(F.avg(F.abs(F.col("energy") - F.col("pe")))).alias("energy_mae"),
                                       r6(F.avg(hit)).alias("accuracy"))


@query("mood_hist", """
SELECT least(floor(l_discount * 10 * 10), 9)::INTEGER AS v_bin, least(floor(l_quantity / 50 * 10), 9)::INTEGER AS e_bin,
       count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def mood_hist(spark, sf):
    """A10: bounded 10 x 10 chart data of (valence, energy)."""
    return M.mood_histogram(mood_points(spark, sf), "valence", "energy")
