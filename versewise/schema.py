"""Schemas and fixed lookup values.

Everything under "Fixed values" must equal the published taxonomy for
results to agree, so it is stated plainly and in its natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (taxonomy, anchors, lexicons, thresholds). Do not reorder:
# list order is the tie-break order of the nearest-anchor rule.
# ---------------------------------------------------------------------------

VIBES = ["chill", "happy", "energetic", "melancholic", "aggressive", "romantic", "uplifting", "dark"]

VIBE_ANCHORS = [
    ("chill", 0.55, 0.25),
    ("happy", 0.85, 0.60),
    ("energetic", 0.70, 0.90),
    ("melancholic", 0.25, 0.30),
    ("aggressive", 0.20, 0.85),
    ("romantic", 0.75, 0.35),
    ("uplifting", 0.80, 0.70),
    ("dark", 0.15, 0.55),
]

LOW_CUT = 0.35
HIGH_CUT = 0.65
ENERGY_BUCKETS = ("low", "medium", "high")
VALENCE_BUCKETS = ("negative", "neutral", "positive")

TAG_ANCHORS = [
    ("happy", 0.85, 0.60),
    ("cheerful", 0.82, 0.55),
    ("uplifting", 0.80, 0.70),
    ("party", 0.75, 0.85),
    ("dance", 0.72, 0.88),
    ("energetic", 0.70, 0.90),
    ("chill", 0.55, 0.25),
    ("relaxing", 0.58, 0.22),
    ("mellow", 0.52, 0.28),
    ("romantic", 0.75, 0.35),
    ("love", 0.78, 0.40),
    ("sad", 0.22, 0.28),
    ("melancholy", 0.25, 0.30),
    ("melancholic", 0.25, 0.30),
    ("depressive", 0.18, 0.25),
    ("dark", 0.15, 0.55),
    ("aggressive", 0.20, 0.85),
    ("angry", 0.18, 0.82),
    ("heavy", 0.25, 0.75),
]

GENRE_ESTIMATES = [
    ("pop", 0.65, 0.55),
    ("rock", 0.55, 0.65),
    ("hip-hop", 0.50, 0.70),
    ("r-n-b", 0.60, 0.45),
    ("soul", 0.62, 0.40),
    ("latin", 0.72, 0.75),
    ("reggaeton", 0.70, 0.80),
    ("k-pop", 0.68, 0.72),
    ("indie", 0.58, 0.50),
    ("folk", 0.55, 0.35),
    ("country", 0.60, 0.45),
    ("metal", 0.30, 0.85),
    ("punk", 0.35, 0.80),
    ("blues", 0.40, 0.35),
    ("dance", 0.72, 0.88),
    ("electronic", 0.55, 0.75),
    ("afrobeat", 0.70, 0.78),
    ("reggae", 0.65, 0.55),
    ("bollywood", 0.70, 0.65),
    ("spanish", 0.68, 0.60),
    ("french", 0.62, 0.50),
    ("german", 0.55, 0.55),
    ("jazz", 0.55, 0.40),
    ("classical", 0.50, 0.30),
]

MARKET_GENRES = [
    ("KR", "k-pop"),
    ("JP", "pop"),
    ("ES", "spanish"),
    ("MX", "latin"),
    ("BR", "latin"),
    ("AR", "latin"),
    ("CO", "latin"),
    ("FR", "french"),
    ("DE", "german"),
    ("IN", "bollywood"),
    ("NG", "afrobeat"),
    ("ZA", "afrobeat"),
    ("JM", "reggae"),
    ("IT", "pop"),
    ("TR", "pop"),
    ("TH", "pop"),
    ("ID", "pop"),
    ("PH", "pop"),
]
DEFAULT_MARKET_GENRE = "pop"

THEMES = [
    ("love_romance", ["love", "heart", "kiss", "baby", "darling", "romance"]),
    ("party_energy", ["dance", "party", "night", "club", "fire", "wild"]),
    ("sadness", ["cry", "tears", "lonely", "pain", "hurt", "goodbye", "miss"]),
    ("anger", ["fight", "rage", "hate", "burn", "war", "kill"]),
    ("hope", ["rise", "shine", "dream", "hope", "free", "fly", "light"]),
    ("darkness", ["dark", "shadow", "death", "blood", "devil", "hell"]),
]

EMOTION_LABELS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
EMOTION_RULES = [
    ("anger", ["angry", "rage", "hate", "fight", "mad"]),
    ("disgust", ["disgust", "gross", "sick"]),
    ("fear", ["afraid", "scared", "fear", "terror"]),
    ("joy", ["joy", "happy", "smile", "laugh", "fun"]),
    ("sadness", ["sad", "cry", "tears", "lonely", "blue", "hurt"]),
    ("surprise", ["wow", "shock", "surprise"]),
]
EMOTION_HIT_SCALE = 10.0

MIN_LYRICS_LEN = 40
INSTRUMENTAL_MARKERS = ["instrumental", "[instrumental]", "(instrumental)"]
MISSING_TOKENS = ["", "nan"]
RATE_LIMIT_PHRASE = "Spotify: 429 Client Error"

LABEL_SOURCES = ("spotify", "lastfm", "genre_estimate", "market_estimate")
MAX_TAGS = 10

SPOTIFY_FEATURES = [
    "sp_valence", "sp_energy", "sp_tempo", "sp_danceability", "sp_acousticness",
    "sp_instrumentalness", "sp_speechiness", "sp_liveness", "sp_loudness", "sp_key",
    "sp_mode", "sp_time_signature", "sp_duration_ms",
]
# source column -> feature; a later alias of the same feature wins
SPOTIFY_SOURCES = [
    ("valence", "sp_valence"),
    ("audio_valence", "sp_valence"),
    ("energy", "sp_energy"),
    ("tempo", "sp_tempo"),
    ("danceability", "sp_danceability"),
    ("acousticness", "sp_acousticness"),
    ("instrumentalness", "sp_instrumentalness"),
    ("speechiness", "sp_speechiness"),
    ("liveness", "sp_liveness"),
    ("loudness", "sp_loudness"),
    ("key", "sp_key"),
    ("mode", "sp_mode"),
    ("audio_mode", "sp_mode"),
    ("time_signature", "sp_time_signature"),
    ("song_duration_ms", "sp_duration_ms"),
]
CATALOG_FEATURES = ["valence", "energy", "tempo", "danceability", "acousticness",
                    "instrumentalness", "speechiness", "liveness", "key", "mode"]
CATALOG_RENAMES = [("track_id", "spotify_id"), ("track_name", "kaggle_track_name"),
                   ("track_artist", "kaggle_artist"), ("track_album_name", "album")]
LEAKING_FEATURE = {"valence": "sp_valence", "energy": "sp_energy", "tempo": "sp_tempo"}

MODEL_DEFAULTS = {"n_estimators": 300, "max_depth": 8, "learning_rate": 0.05, "random_state": 42}
SMALL_TRAIN_ROWS = 150
SMALL_MODEL_CAPS = {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.08}
MIN_LABELS_TO_TRAIN = 10

SAMPLE_RATE = 22050
N_MFCC = 20
ROLLOFF_PERCENT = 0.85

# ---------------------------------------------------------------------------
# Feature-name catalogue (generated, fixed order)
# ---------------------------------------------------------------------------


def lyrics_feature_names() -> list[str]:
    base = ["lyrics_word_count", "lyrics_unique_word_ratio", "lyrics_avg_word_len",
            "lyrics_exclamation_ratio", "lyrics_question_ratio",
            "vader_compound", "vader_pos", "vader_neg", "vader_neu"]
    return base + [f"kw_{t}" for t, _ in THEMES] + [f"emo_{e}" for e in EMOTION_LABELS]


def audio_feature_names(n_mfcc: int = N_MFCC) -> list[str]:
    base = ["tempo_bpm", "rms_mean", "rms_std", "zcr_mean", "spectral_centroid_mean",
            "spectral_centroid_std", "spectral_bandwidth_mean", "spectral_rolloff_mean",
            "spectral_contrast_mean", "chroma_mean", "chroma_std"]
    return base + [f"mfcc_{i}_{s}" for i in range(n_mfcc) for s in ("mean", "std")]


def feature_column_names(include_spotify: bool = True, n_mfcc: int = N_MFCC) -> list[str]:
    cols = lyrics_feature_names() + audio_feature_names(n_mfcc)
    return cols + list(SPOTIFY_FEATURES) if include_spotify else cols


def feature_cols_for_target(target: str, include_spotify: bool = True, leak_guard: bool = False) -> list[str]:
    """Per-target inputs without the column that would leak the target.
    ``leak_guard`` also keeps from the vibe, a function of valence and energy,
    the catalog's valence and energy (T9)."""
    cols = lyrics_feature_names() + audio_feature_names()
    if not include_spotify:
        return cols
    drop = {LEAKING_FEATURE.get(target)}
    if leak_guard and target == "vibe":
        drop |= {LEAKING_FEATURE["valence"], LEAKING_FEATURE["energy"]}
    return cols + [c for c in SPOTIFY_FEATURES if c not in drop]


LABELLED_SONG_SCHEMA = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("lyrics", T.StringType()),
    T.StructField("audio_path", T.StringType()),
    T.StructField("vibe", T.StringType()),
    T.StructField("valence", T.DoubleType()),
    T.StructField("energy", T.DoubleType()),
])

TRACK_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("preview_url", T.StringType()),
    T.StructField("artists", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("album", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("features", T.StructType(
        [T.StructField(c, T.DoubleType()) for c in
         ["valence", "energy", "tempo", "danceability", "acousticness",
          "instrumentalness", "speechiness", "liveness"]]
        + [T.StructField("key", T.IntegerType()), T.StructField("mode", T.IntegerType())])),
])

_TAG = T.StructType([T.StructField("name", T.StringType())])
TAG_PAYLOAD_ARRAY_SCHEMA = T.StructType([T.StructField("track", T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("toptags", T.StructType([T.StructField("tag", T.ArrayType(_TAG))])),
    T.StructField("album", T.StructType([T.StructField("title", T.StringType())])),
]))])
TAG_PAYLOAD_OBJECT_SCHEMA = T.StructType([T.StructField("track", T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("toptags", T.StructType([T.StructField("tag", _TAG)])),
    T.StructField("album", T.StructType([T.StructField("title", T.StringType())])),
]))])

SEARCH_PAYLOAD_SCHEMA = T.StructType([T.StructField("tracks", T.StructType([
    T.StructField("items", T.ArrayType(TRACK_PAYLOAD_SCHEMA))]))])
