"""Queries for sentiment, chunked scoring, scaler statistics and the full
feature table (X6b, W5, X7, A12, A9, X24, X25, F12, F13)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from versewise.functions import text as X
from versewise.operators import features as FT
from versewise.plans import sqltext as S
from versewise.plans.queries import marked_text, query, r6, sql_marked
from versewise.schema import (EMOTION_LABELS, EMOTION_RULES, SPOTIFY_FEATURES, THEMES,
                              audio_feature_names, lyrics_feature_names)
from versewise.session import scratch_path
from versewise.sources.tables import table

# Test lexicon over tokens that occur in the tables (the invented prose has
# no sentiment words of its own) plus the words of the appended phrases.
LEXICON = {"the": 0.5, "of": -0.3, "and": 0.8, "de": 1.2, "la": -1.1, "en": 0.4, "le": -0.6,
           "und": 0.9, "die": -1.5, "is": 0.2, "love": 3.2, "sad": -2.1, "hate": -2.7,
           "happy": 2.7, "fear": -2.2, "cry": -2.0, "kiss": 1.8}
CHUNK_STRIDE = 64


def _lex_sql(x: str) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN {x} = {S.q(k)} THEN {v}::DOUBLE" for k, v in sorted(LEXICON.items())) \
        + " END, 0.0::DOUBLE)"


def _sentiment_sql(toks: str) -> dict[str, str]:
    negs = S.in_list(FT.DEFAULT_NEGATORS)
    boost = {k: v for k, v in FT.DEFAULT_BOOSTERS.items() if k not in LEXICON}
    case = "CASE {p} " + " ".join(f"WHEN {S.q(k)} THEN {v}::DOUBLE" for k, v in boost.items()) + " ELSE 0.0 END"
    lifts = " + ".join(f"CASE WHEN i > {k} THEN {case.format(p=f'{toks}[(i - {k})::INTEGER]')} * {fade} ELSE 0.0 END"
                       for k, fade in enumerate(FT.BOOST_FADE, 1))
    raised = f"({_lex_sql('x')} + sign({_lex_sql('x')}) * ({lifts}))"
    vals = (f"list_transform({toks}, lambda x, i: CASE WHEN {_lex_sql('x')} = 0 THEN 0.0 "
            f"WHEN len(list_filter(list_slice({toks}, greatest(i - 3, 1), i - 1), lambda p: p IN {negs})) > 0 "
            f"THEN {raised} * {FT.NEGATION_SCALAR} ELSE {raised} END)")
    s = f"coalesce(list_sum({vals}), 0.0)"
    pos = f"coalesce(list_sum(list_transform({vals}, lambda v: CASE WHEN v > 0 THEN v + 1 ELSE 0.0 END)), 0.0)"
    neg = f"coalesce(list_sum(list_transform({vals}, lambda v: CASE WHEN v < 0 THEN v - 1 ELSE 0.0 END)), 0.0)"
    neu = f"len(list_filter({vals}, lambda v: v = 0))::DOUBLE"
    tot = f"({pos} + abs({neg}) + {neu})"
    return {
        "vader_compound": f"(round({s} / sqrt({s} * {s} + {FT.NORMALIZE_ALPHA}), 4) + 0.0)",
        "vader_pos": f"CASE WHEN {tot} > 0 THEN round(abs({pos} / {tot}), 3) ELSE 0.0 END",
        "vader_neg": f"CASE WHEN {tot} > 0 THEN round(abs({neg} / {tot}), 3) ELSE 0.0 END",
        "vader_neu": f"CASE WHEN {tot} > 0 THEN round(abs({neu} / {tot}), 3) ELSE 0.0 END",
    }


@query("sentiment", f"""
SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _sentiment_sql('toks').items())}
FROM (SELECT doc_id, {S.tokens(S.clean(sql_marked()))} AS toks FROM documents)
""")
def sentiment(spark, sf):
    """Lexicon valences with look-back for boosters and negators,
    normalised compound and pos/neg/neu shares."""
    d = table(spark, sf, "documents").select("doc_id", X.tokens(X.clean_lyrics(marked_text())).alias("toks"))
    return FT.with_sentiment(d, "toks", LEXICON).select("doc_id", "vader_compound", "vader_pos", "vader_neg",
                                                        "vader_neu")


def _chunk_sql() -> str:
    runs = S.word_runs(S.clean(sql_marked()))
    out = []
    exprs = {}
    for lab, words in EMOTION_RULES:
        exprs[lab] = f"least({S.count_in('ch', words)} / 10.0, 1.0)"
    total = None
    for lab, _ in EMOTION_RULES:
        total = exprs[lab] if total is None else f"({total} + {exprs[lab]})"
    exprs["neutral"] = f"greatest(0.0, 1.0 - {total})"
    for lab in EMOTION_LABELS:
        out.append(f"round(CASE WHEN len(chunks) > 0 THEN list_sum(list_transform(chunks, lambda ch: {exprs[lab]})) "
                   f"/ len(chunks) ELSE 0.0 END, 6) AS emo_{lab}")
    return f"""
SELECT doc_id, len(chunks)::BIGINT AS n_chunks, {', '.join(out)}
FROM (SELECT doc_id, list_transform(range(0, len(runs), {CHUNK_STRIDE}),
                                    lambda s: list_slice(runs, s + 1, s + {CHUNK_STRIDE})) AS chunks
      FROM (SELECT doc_id, {runs} AS runs FROM documents))"""


def _word_model():
    """A stand-in for a model: joy = share of "e", fear = length up to 1."""
    def scorer(texts):
        return [{"joy": t.count("e") / len(t), "fear": min(len(t) / 1000, 1.0)} for t in texts]
    return scorer


@query("chunk_model", f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS x FROM conversations),
c AS (SELECT conv_id, turn, substr(coalesce(x, ''), 1 + 100 * unnest(range(0, greatest((length(coalesce(x, '')) + 99) // 100, 1))), 100) AS ch FROM t),
s AS (SELECT conv_id, turn, trim(ch, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS full_, ch FROM c)
SELECT conv_id, turn, count(*) AS n_chunks,
       round(avg(CASE WHEN full_ THEN (length(ch) - length(replace(ch, 'e', '')))::DOUBLE / length(ch) ELSE 0 END), 6) AS emo_joy,
       round(avg(CASE WHEN full_ THEN least(length(ch) / 1000.0, 1.0)::DOUBLE ELSE 0 END), 6) AS emo_fear
FROM s GROUP BY conv_id, turn
""")
def chunk_model(spark, sf):
    """X7 with a model scorer on 100-character chunks; some texts are NULL."""
    d = table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("t"))
    out = FT.chunk_model_scores(d.withColumn("id", F.to_json("id")), "t", "id", 100, _word_model)
    key = F.from_json("id", "conv_id long, turn long")
    return out.select(key["conv_id"].alias("conv_id"), key["turn"].alias("turn"), "n_chunks",
                      r6(F.col("emo_joy")).alias("emo_joy"), r6(F.col("emo_fear")).alias("emo_fear"))


@query("chunk_classifier", """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS x FROM conversations),
c AS (SELECT conv_id, turn, substr(coalesce(x, ''), 1 + 100 * unnest(range(0, greatest((length(coalesce(x, '')) + 99) // 100, 1))), 100) AS ch FROM t),
s AS (SELECT conv_id, turn, trim(ch, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS full_ FROM c)
SELECT conv_id, turn, count(*) AS n_chunks, round(avg(CASE WHEN full_ THEN 1 ELSE 0 END), 6) AS total, true AS known FROM s GROUP BY conv_id, turn
""")
def chunk_classifier(spark, sf):
    """X7 with a fitted classifier: who says a turn, learnt from the words of
    other turns, saved to the shared folder, loaded and applied to
    100-character chunks. A turn's scores add up to its share of chunks with text."""
    d = table(spark, sf, "conversations")
    path = scratch_path(spark, "text-model")
    FT.fit_text_model(d.filter("conv_id % 2 = 0"), "text", "role", iterations=10).write().save(path)
    model = PipelineModel.load(path)
    rows = d.select(F.to_json(F.struct("conv_id", "turn")).alias("id"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("t"))
    out = FT.chunk_classifier_scores(rows, "t", "id", 100, model)
    names = [c for c in out.columns if c.startswith("emo_")]
    key = F.from_json("id", "conv_id long, turn long")
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return out.select(key["conv_id"].alias("conv_id"), key["turn"].alias("turn"), "n_chunks", r6(total).alias("total"),
                      F.lit(len(names) > 1).alias("known"))


@query("chunk_mean", _chunk_sql())
def chunk_mean(spark, sf):
    """W5 + X7 (rule scorer) + A12: 64-word chunks of the whole text, label
    scores per chunk, mean over chunks."""
    d = table(spark, sf, "documents").select("doc_id", marked_text().alias("t"))
    out = FT.chunk_rule_scores(d, "t", "doc_id", CHUNK_STRIDE)
    return out.select("doc_id", "n_chunks", *[r6(F.col(f"emo_{e}")).alias(f"emo_{e}") for e in EMOTION_LABELS])


STAT_FEATURES = ["lyrics_word_count", "lyrics_unique_word_ratio", "lyrics_avg_word_len",
                 "lyrics_exclamation_ratio", "lyrics_question_ratio"]


def _text_feature_sql(clean: str, toks: str) -> dict[str, str]:
    out = {
        "lyrics_word_count": f"len({toks})::DOUBLE",
        "lyrics_unique_word_ratio": f"len(list_distinct({toks})) / greatest(len({toks}), 1)",
        "lyrics_avg_word_len": (f"CASE WHEN len({toks}) > 0 THEN list_sum(list_transform({toks}, lambda x: length(x)))"
                                f" / len({toks}) ELSE 0.0 END"),
        "lyrics_exclamation_ratio": f"(length({clean}) - length(replace({clean}, '!', ''))) / greatest(length({clean}), 1)",
        "lyrics_question_ratio": f"(length({clean}) - length(replace({clean}, '?', ''))) / greatest(length({clean}), 1)",
    }
    out.update(_sentiment_sql(toks))
    tot = f"greatest(len({toks}), 1)"
    for name, words in THEMES:
        out[f"kw_{name}"] = f"{S.count_in(toks, words)} / {tot}"
    runs = S.word_runs(clean)
    exprs = {lab: f"least({S.count_in(runs, w)} / 10.0, 1.0)" for lab, w in EMOTION_RULES}
    total = None
    for lab, _ in EMOTION_RULES:
        total = exprs[lab] if total is None else f"({total} + {exprs[lab]})"
    exprs["neutral"] = f"greatest(0.0, 1.0 - {total})"
    for lab in EMOTION_LABELS:
        out[f"emo_{lab}"] = exprs[lab]
    return out


@query("scaler_stats", f"""
WITH f AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _text_feature_sql('c', 'toks').items() if k in STAT_FEATURES)}
           FROM (SELECT c, {S.tokens('c')} AS toks FROM (SELECT {S.clean(sql_marked())} AS c FROM documents)))
{' UNION ALL '.join(f"SELECT {S.q(k)} AS feature, round(avg({k}), 6) AS mean, round(stddev_pop({k}), 6) AS std FROM f"
                    for k in STAT_FEATURES)}
""")
def scaler_stats(spark, sf):
    """Mean and population standard deviation of each text statistic,
    one aggregation pass, unpivoted to one row per feature."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), marked_text().alias("lyrics"))
    f = FT.lyrics_features(d, "lyrics")
    agg = f.agg(*[F.avg(c).alias(f"m_{c}") for c in STAT_FEATURES],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in STAT_FEATURES])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), r6(F.col(f"m_{c}")).alias("mean"),
                              r6(F.col(f"s_{c}")).alias("std")) for c in STAT_FEATURES])
    return agg.select(F.inline(rows))


def _feature_table_sql() -> str:
    tf = _text_feature_sql("c", "toks")
    sp = {f: "0.0::DOUBLE" for f in SPOTIFY_FEATURES}
    sp["sp_valence"] = "coalesce(TRY_CAST(valence AS DOUBLE), 0.0::DOUBLE)"
    sp["sp_energy"] = "coalesce(TRY_CAST(energy AS DOUBLE), 0.0::DOUBLE)"
    cols = [f"round(coalesce({tf[k]}, 0.0), 6) AS {k}" for k in lyrics_feature_names()]
    cols += [f"0.0::DOUBLE AS {k}" for k in audio_feature_names()]
    cols += [f"round({sp[k]}, 6) AS {k}" for k in SPOTIFY_FEATURES]
    return f"""
SELECT id, round(valence, 6) AS valence, round(energy, 6) AS energy, {', '.join(cols)}
FROM (SELECT id, valence, energy, c, {S.tokens('c')} AS toks
      FROM (SELECT d.doc_id AS id, {S.clean(sql_marked('d.doc_id', 'd.text'))} AS c,
                   l.quality::DOUBLE AS valence, l.toxic::DOUBLE AS energy
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""


@query("feature_table", _feature_table_sql())
def feature_table(spark, sf):
    """X24/X25 + F13: 22 text, 51 signal (0.0, no audio here) and 13 catalog
    features in catalogue order, with the labels; labels joined from
    ``labels`` (quality, toxic as valence, energy)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), marked_text().alias("lyrics"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("valence"),
                                            F.col("toxic").cast("double").alias("energy"))
    # the text becomes narrow numbers before the join, so no text is shuffled
    ft = FT.feature_table(d, "id", "lyrics", lexicon=LEXICON, labels=lab)
    feats = lyrics_feature_names() + audio_feature_names() + list(SPOTIFY_FEATURES)
    return ft.select("id", r6(F.col("valence")).alias("valence"), r6(F.col("energy")).alias("energy"),
                     *[r6(F.col(c)).alias(c) for c in feats])
