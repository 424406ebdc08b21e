"""Write-then-read queries for the sources, sinks and table shapes (S1-S3, S6,
S9, S14, S16, S17, J12, F11, F12, X20): driver tables are written to the shared
folder in the format concerned and read back by the library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewise.operators import features as FT
from versewise.operators import joins as J
from versewise.plans.queries import query, r6
from versewise.schema import SPOTIFY_FEATURES, feature_column_names, feature_cols_for_target
from versewise.session import scratch_path
from versewise.sources import songs as SG
from versewise.sources.tables import table


@query("songs_csv", """
SELECT doc_id, md5(coalesce(text, '')) AS text_md5, source AS artist,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE round(doc_id / 10, 6) END AS valence
FROM documents
""")
def songs_csv(spark, sf):
    """Whole texts with line feeds and quotes as CSV cells, missing
    spellings, an aliased column; written and read back."""
    d = table(spark, sf, "documents")
    path = scratch_path(spark, "songs-csv")
    SG.write_table(d.select("doc_id", F.col("text").alias("lyrics"), F.col("source").alias("artist"),
                            F.when(F.col("doc_id") % 3 == 0, "NaN").otherwise((F.col("doc_id") / 10).cast("string")).alias("audio_valence")),
                   path, "csv")
    schema = T.StructType([T.StructField("doc_id", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in ("lyrics", "artist", "audio_valence")])
    back = SG.alias_columns(SG.read_song_csv(spark, path, schema))
    SG.require_columns(back, ["lyrics", "artist", "valence"])
    return back.select("doc_id", F.md5(F.coalesce("lyrics", F.lit("")).cast("binary")).alias("text_md5"), "artist",
                       r6(F.col("valence").cast("double")).alias("valence"))


@query("song_rejects", """
WITH r AS (SELECT c_custkey, round(c_acctbal, 2) AS valence,
                  CASE WHEN c_custkey % 7 = 0 THEN 'wrong number' WHEN c_custkey % 11 = 0 THEN 'too many' WHEN c_custkey % 13 = 0 THEN 'too few'
                       WHEN c_custkey % 3 = 0 THEN 'missing' ELSE 'good' END AS kind FROM customer)
SELECT kind NOT IN ('good', 'missing') AS rejected, count(*) AS n, count(CASE WHEN kind = 'good' THEN 1 END) AS with_valence,
       sum(c_custkey)::BIGINT AS ids, round(sum(CASE WHEN kind = 'good' THEN valence ELSE 0 END)::DOUBLE, 2) AS valence FROM r GROUP BY 1
""")
def song_rejects(spark, sf):
    """A CSV in which some rows have a cell too many or too few or a cell
    that is no number; every row is a song or a reject."""
    k, bal = F.col("c_custkey"), F.round("c_acctbal", 2).cast("decimal(12,2)").cast("string")
    head = F.concat_ws(",", k, F.concat(F.lit('"'), "c_name", F.lit(', the\n""first""\"')))
    line = (F.when(k % 7 == 0, F.concat_ws(",", head, F.lit("n.a. yet"))).when(k % 11 == 0, F.concat_ws(",", head, bal, F.lit("x")))
            .when(k % 13 == 0, head).when(k % 3 == 0, F.concat_ws(",", head, F.lit("NaN"))).otherwise(F.concat_ws(",", head, bal)))
    path = scratch_path(spark, "csv-lines")
    rows = table(spark, sf, "customer").select(line.alias("value"))
    rows.write.option("lineSep", "\n").text(path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("title", T.StringType()), T.StructField("valence", T.DoubleType())])
    good, bad = SG.read_song_csv_checked(spark, path, schema, header=False)
    key = F.regexp_extract("line", "^([0-9]+),", 1).cast("long")
    every = good.select(F.lit(False).alias("rejected"), "c_custkey", "valence").unionByName(
        bad.select(F.lit(True).alias("rejected"), key.alias("c_custkey"), F.lit(None).cast("double").alias("valence")))
    return every.groupBy("rejected").agg(F.count(F.lit(1)).alias("n"), F.count("valence").alias("with_valence"), F.sum("c_custkey").alias("ids"),
                                         F.round(F.coalesce(F.sum("valence"), F.lit(0.0)), 2).alias("valence"))


@query("split_tables", """
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang
""")
def split_tables(spark, sf):
    """A table written in parts by a column and read back."""
    path = scratch_path(spark, "by-lang")
    SG.write_table(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), path, partition_by=["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("run_summary", """
SELECT count(*) AS songs, count(DISTINCT lang) AS markets, max(n_chars) AS longest FROM documents
""")
def run_summary(spark, sf):
    """A one-row JSON summary written and read back."""
    path = scratch_path(spark, "summary")
    SG.write_summary(spark, table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("songs"), F.countDistinct("lang").alias("markets"),
                                                              F.max("n_chars").alias("longest")), path)
    return spark.read.schema("songs long, markets long, longest long").json(path)


@query("whole_texts", "SELECT item_id, text AS lyrics FROM benchmark")
def whole_texts(spark, sf):
    """A file for each lyric, its folder naming it; read whole."""
    path = scratch_path(spark, "lyrics")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value"))
    b.write.partitionBy("item_id").text(path)
    back = SG.read_whole_texts(spark, f"{path}/*/*.txt")
    return back.select(F.regexp_extract("id", "item_id=(-?[0-9]+)", 1).cast("long").alias("item_id"),
                       F.regexp_replace("lyrics", "\\n$", "").alias("lyrics"))


@query("paired_lists", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS artist, unnest(list_transform(string_split(p_name, ' '), lambda x: upper(x))) AS title
FROM part
""")
def paired_lists(spark, sf):
    """Parallel artist and title lists zipped to rows."""
    words = F.split("p_name", " ")
    p = table(spark, sf, "part").select("p_partkey", words.alias("a"), F.transform(words, F.upper).alias("t"))
    return p.select("p_partkey", F.inline(SG.pair_lists(F.col("a"), F.col("t"))))


@query("audio_present", """
SELECT n_nationkey, n_nationkey % 2 = 0 AS audio_exists FROM nation
""")
def audio_present(spark, sf):
    """Paths that name a file among those listed (even nations have one)."""
    path = scratch_path(spark, "audio")
    n = table(spark, sf, "nation")
    n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("x").alias("value")).write.partitionBy("n_nationkey").text(path)
    files = spark.read.format("binaryFile").load(f"{path}/*/*.txt").select("path")
    listed = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    here = F.concat(F.lit(path.removeprefix("file:").replace("//", "/")), F.lit("/n_nationkey="), "n_nationkey")
    plain = listed.select(F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^/+", "/").alias("path"))
    songs = n.select("n_nationkey", here.alias("audio_path"))
    return J.attach_file_presence(songs, plain).select("n_nationkey", "audio_exists")


_ZERO = [c for c in SPOTIFY_FEATURES if c in ("sp_valence", "sp_energy")]


@query("zeroed_catalog", f"""
SELECT p_partkey, round(p_retailprice, 6) AS price, {', '.join(f'0.0::DOUBLE AS {c}' for c in _ZERO)} FROM part
""")
def zeroed_catalog(spark, sf):
    """the catalog features at zero, other columns as they are."""
    p = table(spark, sf, "part").select("p_partkey", r6(F.col("p_retailprice")).alias("price"),
                                        *[(F.col("p_size") / 50).alias(c) for c in _ZERO])
    return FT.zero_columns(p)


_TARGETS = {t: feature_cols_for_target(t) for t in ("valence", "energy", "tempo", "vibe")}


@query("target_features", f"""
SELECT count(*) AS songs, {len(feature_column_names())} AS n_features,
       {', '.join(f"{len(c)} AS n_{t}" for t, c in _TARGETS.items())}, 'sp_valence' AS left_out
FROM documents
""")
def target_features(spark, sf):
    """Features of each target, without the one that would give it
    away, as columns of a projected table."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    wide = FT.project_features(d, feature_column_names(), ["id"])
    of = {t: FT.project_features(wide, feature_cols_for_target(t)) for t in _TARGETS}
    gone = sorted(set(wide.columns) - {"id"} - set(of["valence"].columns))
    return wide.agg(F.count(F.lit(1)).alias("songs"), F.lit(len(wide.columns) - 1).alias("n_features"),
                    *[F.lit(len(v.columns)).alias(f"n_{t}") for t, v in of.items()], F.lit("|".join(gone)).alias("left_out"))
