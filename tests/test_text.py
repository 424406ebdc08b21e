"""Column text functions on edge rows (FIXTURES.md part 3)."""

from pyspark.sql import functions as F

from versewise.functions import text as X


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_strip_is_unicode(spark):
    assert one(spark, X.strip("v"), "   abc \t　") == "abc"
    assert one(spark, X.strip("v"), "\x1c x \x1f") == "x"


def test_missing_spellings(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("nan",), ("NaN",), ("x",)], "v string")
    got = [r[0] for r in df.select(X.is_missing("v")).collect()]
    assert got == [True, True, True, True, True, False]
    assert one(spark, X.nullify_missing("v"), " nan ") is None


def test_clean_lyrics_marks_and_space(spark):
    assert one(spark, X.clean_lyrics("v"), "[Verse 1]\nHello   world [Chorus]\n\tagain ") == "Hello world again"
    # a bracket over a newline is kept, U+2028 inside brackets is removed
    assert one(spark, X.clean_lyrics("v"), "a [b\nc] d") == "a [b c] d"
    assert one(spark, X.clean_lyrics("v"), "a [b c] d") == "a d"
    assert one(spark, X.clean_lyrics("v"), "[Intro] [Outro]") == ""


def test_tokens(spark):
    assert one(spark, X.tokens("v"), "Don't stop, Sadé!") == ["don't", "stop", "sad"]
    assert one(spark, X.tokens("v"), "123 ...") == []


def test_text_stats(spark):
    df = spark.createDataFrame([("love love me",), ("",)], "v string").select(X.tokens("v").alias("t"))
    rows = df.select(X.word_count(F.col("t")), X.unique_word_ratio(F.col("t")), X.avg_word_len(F.col("t"))).collect()
    assert tuple(rows[0]) == (3.0, 2 / 3, 10 / 3)
    assert tuple(rows[1]) == (0.0, 0.0, 0.0)


def test_theme_scores_count_duplicates(spark):
    df = spark.createDataFrame([("love, love my heart! lovely",)], "v string")
    low = F.lower(F.col("v"))
    r = df.select(X.theme_scores(X.tokens("v"), lower_text=low)["kw_love_romance"],
                  X.theme_scores(X.tokens("v"))["kw_love_romance"]).first()
    assert r[0] == r[1] == 3 / 5


def test_emotion_word_boundaries(spark):
    # "sadé" is one word: only the two bare "sad" count
    s = X.emotion_rule_scores(F.col("v"))
    r = spark.createDataFrame([("sad sadé sad",)], "v string").select(s["emo_sadness"], s["emo_neutral"]).first()
    assert r[0] == 0.2 and abs(r[1] - 0.8) < 1e-12


def test_emotion_cap_and_neutral_floor(spark):
    text = " ".join(["angry"] * 12 + ["happy"] * 10)
    s = X.emotion_rule_scores(F.col("v"))
    r = spark.createDataFrame([(text,)], "v string").select(s["emo_anger"], s["emo_joy"], s["emo_neutral"]).first()
    assert tuple(r) == (1.0, 1.0, 0.0)


def test_usable_lyrics(spark):
    df = spark.createDataFrame([("x" * 39,), ("x" * 40,), (" (Instrumental) ",), (None,), ("   " + "y" * 40,)],
                               "v string")
    assert [r[0] for r in df.select(X.has_usable_lyrics("v")).collect()] == [False, True, False, False, True]


def test_keys(spark):
    assert one(spark, X.normalize_key("v"), "Rosalía – Don’t Go!") == "rosaladontgo"
    assert one(spark, X.merge_key(F.lit(None).cast("string"), F.lit("")), None) == "|"
    k = one(spark, X.track_key(F.lit("  AC/DC "), F.col("v")), " Thunder\t")
    assert (k["artist_key"], k["title_key"]) == ("ac/dc", "thunder")


def test_scraped_header(spark):
    raw = "My Song Lyrics\n12 Contributors\nfirst line\nsecond"
    df = spark.createDataFrame([(raw, "my song")], "v string, t string")
    assert df.select(X.strip_scraped_header("v", "t")).first()[0] == "first line\nsecond"
    df2 = spark.createDataFrame([("Other\ntext", "my song")], "v string, t string")
    assert df2.select(X.strip_scraped_header("v", "t")).first()[0] == "Other\ntext"


def test_genre_key_and_names(spark):
    assert one(spark, X.genre_key("v"), "  Genre:K-Pop ") == "k-pop"
    assert one(spark, X.safe_file_name(F.lit("AC/DC"), F.col("v")), "Back in Black") == "AC-DC_Back_in_Black"
    assert one(spark, X.search_query(F.col("v"), F.lit("B")), "A") == "track:A artist:B"


def test_error_text(spark):
    old = "Spotify: 429 Client Error; Last.fm: x"
    df = spark.createDataFrame([(old,)], "v string")
    empty = F.array().cast("array<string>")
    assert df.select(X.error_text("v", empty, F.lit(True))).first()[0] == "Last.fm: x"
    assert df.select(X.error_text("v", empty, F.lit(False))).first()[0] == old
    assert df.select(X.error_text("v", F.array(F.lit("a"), F.lit("b")), F.lit(True))).first()[0] == "a; b"


def test_provenance_union_keeps_order(spark):
    df = spark.createDataFrame([("genius||lastfm",)], "v string")
    new = F.array(F.lit("spotify"), F.lit("genius"), F.lit("spotify"))
    assert df.select(X.provenance_union("v", new)).first()[0] == "genius|lastfm|spotify"


def test_lexicon_hits_are_those_of_the_plain_pattern(spark):
    """The pattern looks ahead for first letters; what it finds is what whole words are."""
    import re
    groups = [("a", ["dance", "dan", "don't"]), ("b", ["fly", "flying"])]
    texts = ["dance dan dancer don't don't.", "a fly flying, flyings 'fly fly_ éfly", "", "no hit"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for cls in (X.TOKEN_CLASS, X.WORD_CLASS):
        plain = re.compile(X.word_pattern(["dance", "dan", "don't", "fly", "flying"], cls.replace(r"\p{L}\p{N}_", r"\w")))
        hits = d.select(X.lexicon_hits(F.col("t"), groups, cls).alias("h"))
        assert [r["h"] for r in hits.collect()] == [plain.findall(t) for t in texts]
        assert X.first_letters(["fly", "dan"]) == "(?=[df])"
