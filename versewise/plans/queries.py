"""Query registry: every operator of the blueprint as a job over the driver
tables, each with an equivalent DuckDB SQL oracle (or none, for model and
streaming jobs, which get a row-count check).

Each query reads whole tables. Float outputs are rounded to 6 places in both
engines so that summation order cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.operators import features as FT
from versewise.plans import sqltext as S
from versewise.schema import EMOTION_LABELS, ENERGY_BUCKETS, THEMES, VALENCE_BUCKETS
from versewise.sources.tables import mood_points, songs_from_documents, table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c):
    return F.round(c.cast("double"), 6)


# Test phrases appended to each document by doc_id % 8, so that the theme,
# emotion, punctuation and section-mark paths see real hits (the invented
# prose has none). All rows keep their whole text.
PHRASES = [
    "[Chorus] Love my heart, baby! Dance all night?",
    "[Verse 1] I cry tears, so lonely and sad... Why?",
    "[Bridge] Fight the rage, I hate this war! Angry and mad!",
    "[Outro] Rise and shine, dream of hope; free to fly in the light.",
    "[Intro] Dark shadow, death and blood, the devil in hell.",
    "Happy joy, smile and laugh, so much fun! Wow, what a surprise?",
    "[Hook] Afraid and scared, fear and terror; disgust, gross, sick.",
    "Sadé sad don't cry, blue hurt; kiss me, darling [x2]",
]


def marked_text(id_col: str = "doc_id", text_col: str = "text"):
    ph = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col(id_col) % 8 + 1).cast("int"))
    return F.concat_ws(" ", F.col(text_col), ph)


def sql_marked(id_col: str = "doc_id", text_col: str = "text") -> str:
    arr = "[" + ", ".join(S.q(p) for p in PHRASES) + "]"
    return f"concat_ws(' ', {text_col}, {arr}[({id_col} % 8) + 1])"


# --------------------------------------------------------------------------
# Flagship: documents as songs -> X1, X2, X3, X5 -> J8 -> profile per vibe
# --------------------------------------------------------------------------

def vibe_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", marked_text().alias("t"))
    d = d.select(F.lower(X.clean_lyrics(F.col("t"))).alias("low"))
    # regex scans of the text rather than a lambda for each token
    d = d.select(X.tokens("low").alias("toks"), X.token_chars(F.col("low")).alias("chars"),
                 X.lexicon_hits(F.col("low"), THEMES).alias("hits"))
    n = F.size("toks")
    feats = d.select(X.word_count(F.col("toks")).alias("wc"),
                     X.unique_word_ratio(F.col("toks")).alias("valence"),
                     F.least(F.when(n > 0, F.col("chars") / n).otherwise(F.lit(0.0)) / 10.0, F.lit(1.0)).alias("energy"),
                     X.theme_scores(F.col("toks"), hits=F.col("hits"))["kw_love_romance"].alias("kw"))
    feats = feats.withColumn("vibe", L.nearest_anchor("valence", "energy"))
    return feats.groupBy("vibe").agg(F.count(F.lit(1)).alias("n_songs"),
                                     r6(F.avg("wc")).alias("mean_word_count"),
                                     r6(F.avg("kw")).alias("mean_kw_love_romance"))


_T = S.tokens(S.clean(sql_marked()))
query("vibe_profile", f"""
WITH f AS (
  SELECT len(toks)::DOUBLE AS wc,
         len(list_distinct(toks)) / greatest(len(toks), 1) AS valence,
         least(CASE WHEN len(toks) > 0 THEN list_sum(list_transform(toks, lambda x: length(x))) / len(toks)
               ELSE 0.0 END / 10.0, 1.0) AS energy,
         {S.count_in('toks', THEMES[0][1])} / greatest(len(toks), 1) AS kw
  FROM (SELECT {_T} AS toks FROM documents))
SELECT vibe, count(*) AS n_songs, round(avg(wc), 6) AS mean_word_count,
       round(avg(kw), 6) AS mean_kw_love_romance
FROM (SELECT *, {S.nearest_vibe('valence', 'energy')} AS vibe FROM f)
GROUP BY vibe
""")(vibe_profile)


# --------------------------------------------------------------------------
# Usable text and complete rows
# --------------------------------------------------------------------------

@query("usable_text", f"""
SELECT doc_id, lang,
       CAST({S.usable('text')} AS INTEGER) AS is_usable,
       CAST(NOT {S.missing('text')} AS INTEGER) AS has_text,
       length({S.strip('text')}) AS stripped_len
FROM documents
""")
def usable_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", X.has_usable_lyrics("text").cast("int").alias("is_usable"),
                    (~X.is_missing("text")).cast("int").alias("has_text"),
                    F.length(X.strip("text")).alias("stripped_len"))


@query("complete_rows", f"""
SELECT d.doc_id, d.lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE {S.usable('d.text')}
  AND l.doc_id IS NOT NULL
  AND ((l.quality IS NOT NULL AND l.toxic IS NOT NULL) OR d.source LIKE '%1')
""")
def complete_rows(spark, sf):
    """F3 = F1 and F2 on documents joined with labels: spotify_id = the label
    row's doc_id, valence/energy = quality/toxic, preview = a source ending in 1."""
    from versewise.operators.joins import filter_complete_rows
    d = songs_from_documents(spark, sf)
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                            F.col("doc_id").cast("string").alias("spotify_id"),
                                            F.col("quality").cast("double").alias("valence"),
                                            F.col("toxic").cast("double").alias("energy"))
    songs = d.join(lab, "id", "left").withColumns({
        "title": F.col("id").cast("string"),
        "preview_url": F.when(F.col("artist").endswith("1"), F.lit("http://p")).otherwise(F.lit("")),
    })
    return filter_complete_rows(songs).select(F.col("id").alias("doc_id"), F.col("market").alias("lang"))


# --------------------------------------------------------------------------
# Text statistics, punctuation, themes, emotion rules, sentiment
# --------------------------------------------------------------------------

@query("text_stats", f"""
SELECT doc_id, len(toks)::DOUBLE AS word_count,
       round(len(list_distinct(toks)) / greatest(len(toks), 1), 6) AS unique_word_ratio,
       round(CASE WHEN len(toks) > 0 THEN list_sum(list_transform(toks, lambda x: length(x))) / len(toks)
             ELSE 0.0 END, 6) AS avg_word_len,
       length(c) AS clean_len
FROM (SELECT doc_id, c, {S.tokens('c')} AS toks
      FROM (SELECT doc_id, {S.clean(sql_marked())} AS c FROM documents))
""")
def text_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.clean_lyrics(marked_text()).alias("c"))
    d = d.withColumn("toks", X.tokens(F.col("c")))
    t = F.col("toks")
    return d.select("doc_id", X.word_count(t).alias("word_count"),
                    r6(X.unique_word_ratio(t)).alias("unique_word_ratio"),
                    r6(X.avg_word_len(t, F.lower("c"))).alias("avg_word_len"),
                    F.length("c").alias("clean_len"))


@query("punct_ratio", f"""
SELECT doc_id,
       round((length(c) - length(replace(c, '!', ''))) / greatest(length(c), 1), 6) AS exclamation_ratio,
       round((length(c) - length(replace(c, '?', ''))) / greatest(length(c), 1), 6) AS question_ratio
FROM (SELECT doc_id, {S.clean(sql_marked())} AS c FROM documents)
""")
def punct_ratio(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.clean_lyrics(marked_text()).alias("c"))
    return d.select("doc_id", r6(X.char_ratio("c", "!")).alias("exclamation_ratio"),
                    r6(X.char_ratio("c", "?")).alias("question_ratio"))


_theme_sql = ", ".join(f"round({S.count_in('toks', w)} / greatest(len(toks), 1), 6) AS kw_{n}" for n, w in THEMES)


@query("theme_scores", f"""
SELECT doc_id, {_theme_sql}
FROM (SELECT doc_id, {S.tokens(S.clean(sql_marked()))} AS toks FROM documents)
""")
def theme_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lower(X.clean_lyrics(marked_text())).alias("low"))
    d = FT.with_lexicon_hits(d.withColumn("toks", X.tokens(F.col("low"))), "low")
    return d.select("doc_id", *[r6(v).alias(k) for k, v in X.theme_scores(F.col("toks"), hits=F.col("_th")).items()])


def _emo_sql(runs: str) -> str:
    from versewise.schema import EMOTION_RULES
    exprs = {lab: f"least({S.count_in(runs, w)} / 10.0, 1.0)" for lab, w in EMOTION_RULES}
    total = None
    for lab, _ in EMOTION_RULES:
        total = exprs[lab] if total is None else f"({total} + {exprs[lab]})"
    exprs["neutral"] = f"greatest(0.0, 1.0 - {total})"
    return ", ".join(f"round({exprs[lab]}, 6) AS emo_{lab}" for lab in EMOTION_LABELS)


@query("emotion_rules", f"""
SELECT doc_id, {_emo_sql('runs')}
FROM (SELECT doc_id, {S.word_runs(S.clean(sql_marked()))} AS runs FROM documents)
""")
def emotion_rules(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lower(X.clean_lyrics(marked_text())).alias("low"))
    d = FT.with_lexicon_hits(d, "low")
    return d.select("doc_id", *[r6(v).alias(k) for k, v in X.emotion_rule_scores(None, hits=F.col("_eh")).items()])


# --------------------------------------------------------------------------
# Nearest vibe, buckets, clipping
# --------------------------------------------------------------------------

@query("nearest_vibe", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(l_discount * 10, 6) AS valence, round(l_quantity / 50, 6) AS energy,
       {S.nearest_vibe('l_discount * 10', 'l_quantity / 50')} AS vibe
FROM lineitem
""")
def nearest_vibe(spark, sf):
    m = mood_points(spark, sf)
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    r6(F.col("valence")).alias("valence"), r6(F.col("energy")).alias("energy"),
                    L.nearest_anchor("valence", "energy").alias("vibe"))


@query("mood_buckets", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {S.bucket('l_discount * 10', VALENCE_BUCKETS)} AS valence_label,
       {S.bucket('l_quantity / 50', ENERGY_BUCKETS)} AS energy_label,
       round({S.clip('l_tax / 0.08')}, 3) AS pred_valence,
       {S.bucket(S.clip('l_tax / 0.08'), VALENCE_BUCKETS)} AS pred_valence_label
FROM lineitem
""")
def mood_buckets(spark, sf):
    m = mood_points(spark, sf)
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    L.valence_bucket("valence").alias("valence_label"),
                    L.energy_bucket("energy").alias("energy_label"),
                    L.clip_round("pred_valence").alias("pred_valence"),
                    L.valence_bucket(L.clip01("pred_valence")).alias("pred_valence_label"))


QUERY_MODULES = ["queries_sources", "queries_joins", "queries_labels", "queries_misc", "queries_features", "queries_signal", "queries_models", "queries_jobs"]


def _load():
    import importlib
    for m in QUERY_MODULES:
        importlib.import_module(f"versewise.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}


__all__ = ["REGISTRY", "queries", "oracle_sql", "vibe_profile", "FT"]


@query("quality_counters", f"""
SELECT count(*) AS input_rows,
       count(*) FILTER (WHERE {S.usable('d.text')}) AS rows_with_lyrics,
       count(*) FILTER (WHERE l.doc_id IS NOT NULL AND ((l.quality IS NOT NULL AND l.toxic IS NOT NULL)
                                                         OR d.source LIKE '%1')) AS rows_with_music_data
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def quality_counters(spark, sf):
    """A1: the clean job's counters over the documents-as-songs table, one pass."""
    from versewise.operators import joins as J
    from versewise.operators import metrics as M
    d = songs_from_documents(spark, sf)
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                            F.col("doc_id").cast("string").alias("spotify_id"),
                                            F.col("quality").cast("double").alias("valence"),
                                            F.col("toxic").cast("double").alias("energy"))
    songs = d.join(lab, "id", "left").withColumn(
        "preview_url", F.when(F.col("artist").endswith("1"), F.lit("http://p")).otherwise(F.lit("")))
    return M.quality_counters(songs, J.has_music_data(songs))
