"""Text features, chunked scoring and the fixed-order feature table
(X1-X7, W5, A12, X24, X25, F11-F13).

Every text feature is a Column expression over the row's own text, so the
whole feature table is one narrow projection (no shuffle, no Python).
Python runs only in the optional model scorer slot of X7, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.functions.text import words_pattern
from versewise.schema import (EMOTION_LABELS, EMOTION_RULES, SPOTIFY_FEATURES, THEMES, audio_feature_names,
                              lyrics_feature_names)

# Sentiment (X6b): lexicon rule of Hutto & Gilbert (2014): token valences
# from a lexicon, raised or lowered by boosters among the three previous
# tokens (weaker the farther), x -0.74 if one of those is a negator;
# compound = s / sqrt(s^2 + 15), pos/neg/neu shares.
# Fixed values of the method:
NEGATION_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
BOOST = 0.293
BOOST_FADE = (1.0, 0.95, 0.9)
DEFAULT_NEGATORS = ["not", "no", "never", "nothing", "nobody", "none", "nor", "neither",
                    "don't", "doesn't", "didn't", "can't", "won't", "isn't", "ain't", "without"]
DEFAULT_BOOSTERS = {"absolutely": BOOST, "completely": BOOST, "extremely": BOOST, "really": BOOST, "so": BOOST,
                    "such": BOOST, "totally": BOOST, "very": BOOST, "almost": -BOOST, "barely": -BOOST,
                    "hardly": -BOOST, "partly": -BOOST, "slightly": -BOOST, "somewhat": -BOOST}
#: Words a lexicon may have: it is part of the plan, so its size is checked.
MAX_LEXICON_WORDS = 100_000
#: Words of a lexicon up to which a word's value is found by comparison, not by search.
FEW_WORDS = 100


def lexicon_dict(lexicon) -> dict[str, float]:
    """A lexicon given as a dict or as a table (token, valence), at most
    ``MAX_LEXICON_WORDS`` words."""
    if isinstance(lexicon, DataFrame):
        rows = lexicon.limit(MAX_LEXICON_WORDS + 1).collect()
        lexicon = {r[0]: float(r[1]) for r in rows if r[0] is not None and r[1] is not None}
    if len(lexicon) > MAX_LEXICON_WORDS:
        raise ValueError(f"a lexicon may have {MAX_LEXICON_WORDS} words")
    return {k: float(v) for k, v in lexicon.items()}


def looked_up(word: Column, table: dict[str, float]) -> Column:
    """Value of a word of ``table``: a binary search in its sorted words, as a
    map column is searched from its beginning."""
    words = sorted(table, key=lambda w: w.encode())
    keys, values = F.array(*[F.lit(w) for w in words]), F.array(*[F.lit(table[w]) for w in words])
    steps = F.array(*[F.lit(1 << b) for b in range(len(words).bit_length() - 1, -1, -1)])
    # how many words are not above it; beyond the last one get() is null and the step isn't taken
    upto = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(keys, at + s - 1) <= word, s).otherwise(F.lit(0)))
    return F.get(values, upto - 1)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def sentiment_sums(toks: Column, lexicon: dict[str, float], negators=DEFAULT_NEGATORS, boosters=None) -> Column:
    """struct<s, pos, neg, neu>: sum of valences, positive and negative sums
    (each hit counts one more), number of neutral tokens.

    The tokens, joined by spaces, are cut at the lexicon's words by one regex;
    each word found looks back on the three tokens before it, which are in the
    pieces since the third word before it, if one of those turns or strengthens
    it. So lambdas run a word found, not a token. A token holds no space."""
    lex = {k: v for k, v in lexicon.items() if v and k and " " not in k}
    boost = {k: v for k, v in (DEFAULT_BOOSTERS if boosters is None else boosters).items() if k not in lexicon}
    n = F.size(F.coalesce(toks, F.array().cast("array<string>"))).cast("double")
    if not lex:
        return F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), n.alias("neu"))
    def any_of(words) -> str:
        return f"{X.first_letters(words)}(?<![^ ])(?:{words_pattern(words)})(?![^ ])" if words else r"\b\B"

    found, turned = any_of(lex), any_of([w for w in [*negators, *boost] if w and " " not in w])
    joined = F.coalesce(F.array_join(toks, " "), F.lit(""))
    plain = (lambda w: looked_up_exactly(w, lex)) if len(lex) <= FEW_WORDS else (lambda w: looked_up(w, lex))

    def changed(v: Column, before: Column) -> Column:
        # by the three tokens before it, the nearest last
        up = F.lit(0.0)
        for k, fade in enumerate(BOOST_FADE):
            up = up + (F.coalesce(looked_up_exactly(F.get(before, F.size(before) - 1 - k), boost), F.lit(0.0)) * F.lit(fade))
        negated = F.arrays_overlap(before, F.array(*[F.lit(w) for w in negators])) if negators else F.lit(False)
        return (v + F.signum(v) * up) * F.when(negated, F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))

    def turned_values(hits: Column, gaps: Column) -> Column:
        def part(a: Column, i: Column) -> Column:
            return F.coalesce(F.get(a, i), F.lit(""))

        def value(word: Column, j: Column) -> Column:
            text = F.concat(part(hits, j - 3), part(gaps, j - 2), part(hits, j - 2), part(gaps, j - 1), part(hits, j - 1), part(gaps, j))
            return _once(F.substring_index(F.trim(text), " ", -3), lambda last: F.when(
                last.rlike(turned), _once(plain(word), lambda v: changed(v, F.split(last, " ")))).otherwise(plain(word)))

        return F.transform(hits, value)

    def values(text: Column) -> Column:
        # texts without a negator or booster, most of them, need no look-back
        cut = F.struct(F.regexp_extract_all(text, F.lit(found), 0).alias("hits"), F.split(text, found, -1).alias("gaps"))
        alone = F.transform(F.regexp_extract_all(text, F.lit(found), 0), lambda w: plain(w))
        if not negators and not boost:
            return alone
        return F.when(text.rlike(turned), _once(cut, lambda c: turned_values(c["hits"], c["gaps"]))).otherwise(alone)

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0.0).alias("hits"))
    total = F.aggregate(_once(joined, values), zero, lambda a, v: F.struct(
        (a["s"] + v).alias("s"), (a["pos"] + F.when(v > 0, v + 1).otherwise(F.lit(0.0))).alias("pos"),
        (a["neg"] + F.when(v < 0, v - 1).otherwise(F.lit(0.0))).alias("neg"),
        (a["hits"] + F.when(v != 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("hits")))
    return _once(total, lambda r: F.struct(r["s"].alias("s"), r["pos"].alias("pos"), r["neg"].alias("neg"), (n - r["hits"]).alias("neu")))


def looked_up_exactly(word: Column, table: dict[str, float]) -> Column:
    """Value of a word in a short table, null if it isn't there."""
    out = F.lit(None).cast("double")
    for value in sorted(set(table.values())):
        out = F.when(word.isin(*[w for w, v in table.items() if v == value]), F.lit(value)).otherwise(out)
    return out


def sentiment_scores(sums: str) -> dict[str, Column]:
    """X6b from the sums: compound (4 places), pos, neg, neu (3)."""
    s, pos, neg, neu = (F.col(f"{sums}.{c}") for c in ("s", "pos", "neg", "neu"))
    total = pos + F.abs(neg) + neu
    nz = total > 0
    return {
        # + 0.0 turns a rounded -0.0 into 0.0
        "vader_compound": F.round(s / F.sqrt(s * s + NORMALIZE_ALPHA), 4) + F.lit(0.0),
        "vader_pos": F.when(nz, F.round(F.abs(pos / total), 3)).otherwise(F.lit(0.0)),
        "vader_neg": F.when(nz, F.round(F.abs(neg / total), 3)).otherwise(F.lit(0.0)),
        "vader_neu": F.when(nz, F.round(F.abs(neu / total), 3)).otherwise(F.lit(0.0)),
    }


def with_sentiment(df: DataFrame, toks: str, lexicon, negators=DEFAULT_NEGATORS, boosters=None) -> DataFrame:
    """X6b as columns, one way for every lexicon size: no shuffle, no id, and
    streams take it too."""
    sums = sentiment_sums(F.col(toks), lexicon_dict(lexicon), negators, boosters)
    return df.withColumn("_sent", sums).withColumns(sentiment_scores("_sent")).drop("_sent")


def lyrics_features(df: DataFrame, text_col: str = "lyrics", lexicon=None, on_empty: str = "error") -> DataFrame:
    """The 22 text features of each row, in catalogue order.

    ``on_empty`` decides what happens to rows whose cleaned text is empty:
    "error" fails the job (as the one-song path does), "drop" removes them,
    "null" keeps them with NULL features.
    """
    clean = X.clean_lyrics(F.col(text_col))
    df = df.withColumn("_clean", clean)
    empty = F.length("_clean") == 0
    if on_empty == "error":
        df = df.withColumn("_clean", F.when(empty, F.raise_error(F.lit("a row has no words left after cleaning")))
                           .otherwise(F.col("_clean")))
    elif on_empty == "drop":
        df = df.filter(~empty)
    df = df.withColumn("_low", F.lower(F.col("_clean")))
    df = df.withColumn("_toks", X.tokens(F.col("_low")))
    df = with_sentiment(df, "_toks", lexicon if lexicon is not None else {})
    # one regex scan per lexicon group, kept as columns (not re-run per label)
    df = with_lexicon_hits(df, "_low")
    t, low = F.col("_toks"), F.col("_low")
    cols = {
        "lyrics_word_count": X.word_count(t),
        "lyrics_unique_word_ratio": X.unique_word_ratio(t).cast("double"),
        "lyrics_avg_word_len": X.avg_word_len(t, low).cast("double"),
        "lyrics_exclamation_ratio": X.char_ratio(F.col("_clean"), "!").cast("double"),
        "lyrics_question_ratio": X.char_ratio(F.col("_clean"), "?").cast("double"),
    }
    cols.update({k: v.cast("double") for k, v in X.theme_scores(t, hits=F.col("_th")).items()})
    cols.update({k: v.cast("double") for k, v in X.emotion_rule_scores(None, hits=F.col("_eh")).items()})
    if on_empty == "null":
        cols = {k: F.when(~empty, v) for k, v in cols.items()}
        cols.update({k: F.when(~empty, F.col(k)) for k in
                     ["vader_compound", "vader_pos", "vader_neg", "vader_neu"]})
    out = df.withColumns(cols)
    tmp = ("_clean", "_low", "_toks", "_th", "_eh")
    out = out.select(*[c for c in out.columns if c not in tmp])
    ordered = [c for c in df.columns if c not in tmp and c not in lyrics_feature_names()]
    return out.select(*ordered, *lyrics_feature_names())


def with_lexicon_hits(df: DataFrame, low: str) -> DataFrame:
    """Columns ``_th`` (theme words, token boundaries) and ``_eh`` (emotion
    words, word boundaries): the short arrays of lexicon hits of the
    lower-cased text, each from one regex scan."""
    return df.withColumns({"_th": X.lexicon_hits(F.col(low), THEMES),
                           "_eh": X.lexicon_hits(F.col(low), EMOTION_RULES, X.WORD_CLASS)})


def chunk_texts(lower_text: Column, stride: int) -> Column:
    """W5 on word runs by one regex: each match spans up to ``stride`` runs
    (with the separators after them), so the i-th match holds runs
    i*stride+1 .. (i+1)*stride and the last one is short."""
    pattern = f"(?:{X.WORD_CLASS}+[^\\p{{L}}\\p{{N}}_]*){{1,{stride}}}"
    return F.regexp_extract_all(lower_text, F.lit(pattern), 0)


def chunk_rule_scores(df: DataFrame, text_col: str, id_col: str, stride: int) -> DataFrame:
    """X7 with the default rule scorer, A12 mean over chunks: per chunk the
    X6 scores (regex counts over the chunk), summed and divided by the chunk
    count. The lambda runs once per chunk, not once per word; no explode and
    no shuffle."""
    low = F.lower(X.clean_lyrics(F.col(text_col)))
    d = df.select(id_col, chunk_texts(low, stride).alias("_chunks"))
    n = F.size("_chunks")
    found = F.transform("_chunks", lambda c: X.lexicon_hits(c, EMOTION_RULES, X.WORD_CLASS))
    d = d.withColumn("_found", found)   # one scan per chunk, kept as a column
    d = d.withColumn("_hits", F.transform("_found", _chunk_label_scores))
    per_label = {label: F.transform("_hits", _field(label)) for label, _ in EMOTION_RULES}
    per_label["neutral"] = F.transform("_hits", lambda h: F.greatest(F.lit(0.0), F.lit(1.0) - _sum_fields(h)))
    out = {"n_chunks": n.cast("long")}
    for label in EMOTION_LABELS:
        s = F.aggregate(per_label[label], F.lit(0.0), lambda a, x: a + x)
        out[f"emo_{label}"] = F.when(n > 0, s / n).otherwise(F.lit(0.0))
    return d.select(id_col, *[v.alias(k) for k, v in out.items()])


def _chunk_label_scores(found: Column) -> Column:
    """Per-label scores of one chunk from its array of rule-word hits."""
    return F.struct(*[F.least(X.count_in(found, words) / F.lit(10.0), F.lit(1.0)).alias(label)
                      for label, words in EMOTION_RULES])


def _field(name: str):
    def get(h: Column) -> Column:
        return h[name]
    return get


def _sum_fields(h: Column) -> Column:
    total = None
    for label, _ in EMOTION_RULES:
        total = h[label] if total is None else total + h[label]
    return total


def char_chunks(df: DataFrame, text_col: str, id_col: str, max_chars: int) -> DataFrame:
    """W5 by characters: id and ``chunk``, a row each; a NULL text is one blank chunk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(max_chars))
    return df.select(id_col, F.explode(F.transform(starts, lambda s: F.substring(text, s, max_chars))).alias("chunk"))


def fit_text_model(train: DataFrame, text_col: str, label_col: str, bits: int = 16, reg: float = 1e-3,
                   iterations: int = 50) -> PipelineModel:
    """A classifier of texts for the chunk scores: counts of lower-cased
    words in 2^bits hashed slots, multinomial logistic regression, fitted by
    Spark. Rows without a text or label aren't learnt. Saved and loaded like any
    Spark ML model; its last stage holds the labels."""
    rows = train.select(F.col(text_col).alias("chunk"), F.col(label_col).cast("string").alias("_label")).dropna()
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    words = RegexTokenizer(inputCol="chunk", outputCol="_words", pattern="[\\p{L}\\p{N}_]+", gaps=False)
    slots = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=1 << bits)
    lr = LogisticRegression(featuresCol="_tf", labelCol="_y", probabilityCol="_p", predictionCol="_k", rawPredictionCol="_raw",
                            family="multinomial", regParam=reg, maxIter=iterations)
    back = IndexToString(inputCol="_k", outputCol="_best", labels=index.labels)
    fitted = Pipeline(stages=[words, slots, lr]).fit(index.transform(rows))
    return PipelineModel([*fitted.stages, back])


def chunk_classifier_scores(df: DataFrame, text_col: str, id_col: str, max_chars: int, model: PipelineModel) -> DataFrame:
    """X7 with a model of :func:`fit_text_model`, A12: the mean of each label's
    probability over all character chunks (blank ones score 0 but count), as
    ``emo_<label>``. The model stays in the JVM."""
    scored = model.transform(char_chunks(df, text_col, id_col, max_chars)).withColumn("_p", vector_to_array("_p"))
    full = F.length(X.strip("chunk")) > 0
    labels = model.stages[-1].getLabels()
    return scored.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"), *[
        F.avg(F.when(full, F.col("_p")[k]).otherwise(F.lit(0.0))).alias(f"emo_{name}") for k, name in enumerate(labels)])


def chunk_model_scores(df: DataFrame, text_col: str, id_col: str, max_chars: int,
                       load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]) -> DataFrame:
    """X7 with a pluggable model: character chunks (W5) are exploded, scored in
    Arrow batches and averaged per id over all chunks (blank chunks score 0
    but count; a NULL text is one blank chunk). ``load`` runs once a task and
    returns the scorer, so a model isn't sent with the plan."""
    chunks = char_chunks(df, text_col, id_col, max_chars)
    names = [f"emo_{e}" for e in EMOTION_LABELS]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] +
                          [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches):
        scorer = load()
        for pdf in batches:
            texts = pdf["chunk"].tolist()
            scored = iter(scorer([t for t in texts if t.strip()]))
            found = [next(scored) if t.strip() else {} for t in texts]
            out = pd.DataFrame([[float(s.get(e, 0.0)) for e in EMOTION_LABELS] for s in found], columns=names)
            out.insert(0, id_col, pdf[id_col].values)
            yield out

    scored = chunks.mapInPandas(run, schema)
    return scored.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"), *[F.avg(n).alias(n) for n in names])


def zero_columns(df: DataFrame, cols=SPOTIFY_FEATURES) -> DataFrame:
    """one modality set to 0.0 (ablation)."""
    return df.withColumns({c: F.lit(0.0) for c in cols if c in df.columns})


def project_features(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """fixed order, absent or NULL -> 0.0."""
    present = set(df.columns)
    sel = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c)
           for c in cols]
    return df.select(*(keep or []), *sel)


def feature_table(songs: DataFrame, id_col: str, text_col: str = "lyrics",
                  audio: DataFrame | None = None, include_catalog: bool = True,
                  lexicon=None, on_empty: str = "error",
                  keep: list[str] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """22 text + 51 signal (0.0 without audio) + 13 catalog features
    per row, in catalogue order, plus ids and labels. ``audio`` (signal
    features) and ``labels`` (label and catalog columns) are tables keyed by
    ``id_col``; they are joined after the text has become numbers and is
    dropped."""
    df = lyrics_features(songs, text_col, lexicon, on_empty).drop(text_col)
    if labels is not None:
        df = df.join(labels, id_col, "left")
    if include_catalog:
        df = df.withColumns(L.numeric_features(df))
    if audio is not None:
        df = df.join(audio, id_col, "left")
    cols = lyrics_feature_names() + audio_feature_names() + (list(SPOTIFY_FEATURES) if include_catalog else [])
    named = [c for c in ["vibe", "valence", "energy", "tempo"] if c in df.columns]
    return project_features(df, cols, [id_col, *(keep or []), *named])
