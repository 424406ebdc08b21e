"""Song-table sources and sinks.

CSV with multi-line quoted lyrics cannot be split, so it is read once and
should be written back as Parquet for anything large.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewise.functions import text as X
from versewise.session import stage_table

# pandas-style missing spellings a CSV may carry (T1); callers may keep
# "NA" or "None" as real names by passing their own list.
CSV_NA_TOKENS = ["", "nan", "NaN", "NA", "N/A", "NULL", "null", "None", "<NA>"]


def read_song_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  na_tokens: list[str] | None = None) -> DataFrame:
    """Quoted CSV with multi-line fields; string cells in ``na_tokens``
    become NULL (F8 at the source)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    toks = CSV_NA_TOKENS if na_tokens is None else na_tokens
    fix = {f.name: F.when(F.col(f.name).isin(*toks), F.lit(None)).otherwise(F.col(f.name))
           for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(fix)


def read_song_csv_checked(spark: SparkSession, path: str, schema: T.StructType | None = None,
                          na_tokens: list[str] | None = None, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 with a channel for rows that don't fit: (songs, rejects). A row with
    too few or too many cells, or with a cell that isn't of its column's type,
    goes to ``rejects`` as ``line``, its text; every row of the files is in one
    of the two. Without a schema all columns are text, named by the header. The
    rows are parsed once and written."""
    toks = CSV_NA_TOKENS if na_tokens is None else na_tokens
    r = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    wanted = schema or r.csv(path).schema
    # numbers are read as text first: a spelling of "missing" isn't an error
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields] + [T.StructField("_line", T.StringType())])
    rows = stage_table(r.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path), "csv-rows")
    cells = {f.name: F.when(~F.col(f"`{f.name}`").isin(*toks), F.col(f"`{f.name}`")) for f in wanted.fields}
    typed = {f.name: cells[f.name] if isinstance(f.dataType, T.StringType) else cells[f.name].try_cast(f.dataType) for f in wanted.fields}
    wrong = F.col("_line").isNotNull()
    for f in wanted.fields:
        wrong = wrong | (cells[f.name].isNotNull() & typed[f.name].isNull())
    line = F.coalesce(F.col("_line"), F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in wanted.fields])))
    return (rows.filter(~wrong).select(*[typed[f.name].alias(f.name) for f in wanted.fields]),
            rows.filter(wrong).select(line.alias("line")))


def require_columns(df: DataFrame, required, what: str = "Dataset") -> None:
    """Raise when a required column is absent (no job runs)."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"{what} missing columns: {sorted(missing)}")


def alias_columns(df: DataFrame, aliases=(("audio_valence", "valence"), ("audio_mode", "mode"))) -> DataFrame:
    """S3: copy an alias column under the main name when the main one is absent."""
    for src, dst in aliases:
        if dst not in df.columns and src in df.columns:
            df = df.withColumn(dst, F.col(src))
    return df


def parse_track_line(line: Column) -> Column:
    """``artist - title``, else ``artist|title``, else ``artist,title``
    (first separator only, parts trimmed); NULL for blank, ``#`` or
    separator-less lines and when a part is empty."""
    s = X.strip(line)
    sep = (F.when(F.contains(s, F.lit(" - ")), F.lit(" - "))
            .when(F.contains(s, F.lit("|")), F.lit("|"))
            .when(F.contains(s, F.lit(",")), F.lit(",")))
    at = F.instr(s, sep)
    artist = X.strip(F.substring(s, F.lit(1), at - 1))
    title = X.strip(F.substring(s, at + F.length(sep), F.lit(1 << 30)))
    ok = (F.length(s) > 0) & ~F.startswith(s, F.lit("#")) & sep.isNotNull() \
        & (F.length(artist) > 0) & (F.length(title) > 0)
    return F.when(ok, F.struct(artist.alias("artist"), title.alias("title")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, pos (from 0 in each file),
    value. Files are read in splits, as large as the session makes them; a split's
    lines are counted, the counts summed up along the file, and a line's place is
    the sum before its split and its place in it. Row numbers are consecutive
    within a task, so no line moves; the lines are written first, so that all
    steps see the same splits."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("row"), "value")
    lines = stage_table(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    # a row a split: the window holds a file's splits, not its lines
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("pos"), "value")


def read_track_list(spark: SparkSession, path: str) -> DataFrame:
    """One track per line with its (file, line) position."""
    t = numbered_lines(spark, path).select("file", "pos", parse_track_line(F.col("value")).alias("t")).filter("t IS NOT NULL")
    return t.select("file", "pos", "t.artist", "t.title")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table directory."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def track_lines(df: DataFrame, require_lyrics: bool = True) -> DataFrame:
    """``Artist - Title`` lines for rows with valid names (and usable lyrics)."""
    ok = X.valid_name("artist") & X.valid_name("title")
    if require_lyrics:
        ok = ok & X.has_usable_lyrics("lyrics")
    return df.filter(ok).select(F.concat_ws(" - ", X.strip("artist"), X.strip("title")).alias("line"))


def write_summary(spark: SparkSession, summary: DataFrame, path: str) -> dict:
    """A one-row aggregate written as JSON, returned as a dict."""
    row = summary.first()
    d = row.asDict() if row is not None else {}
    spark.createDataFrame([(json.dumps(d, default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return d


def track_map(artist_titles: DataFrame) -> DataFrame:
    """(artist, titles array, pos) -> one line per title, first per
    lower(artist)|lower(title) key in (pos, title position) order. As in a
    map, an artist listed again keeps the first place and the last list."""
    artist_titles = artist_titles.groupBy("artist").agg(F.min("pos").alias("_first"), F.max_by("titles", "pos").alias("titles")) \
        .select("artist", F.col("_first").alias("pos"), "titles")
    ex = artist_titles.select("artist", "pos", F.posexplode("titles").alias("tpos", "title"))
    ex = ex.withColumn("_k", F.concat_ws("|", F.lower("artist"), F.lower("title")))
    firsts = ex.groupBy("_k").agg(F.min_by(F.struct("artist", "title", "pos", "tpos"),
                                           F.struct("pos", "tpos")).alias("r"))
    return firsts.select("r.pos", "r.tpos", F.concat_ws(" - ", "r.artist", "r.title").alias("line"))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one lyric; the file name is its id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"),
                                                        F.col("value").alias("lyrics"))


def pair_lists(artists: Column, titles: Column) -> Column:
    """Zip two parallel arrays; unequal lengths raise."""
    return F.when(F.size(artists) != F.size(titles),
                  F.raise_error(F.lit("artist and title lists differ in length"))) \
        .otherwise(F.arrays_zip(artists.alias("artist"), titles.alias("title")))


def dataset_rows(df: DataFrame) -> DataFrame:
    """a song struct flattened to a table row: missing strings -> "",
    tag and source lists ``|``-joined, vibe from both labels (J8) or ""."""
    from versewise.functions.labels import nearest_anchor
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name != "vibe":
            out[f.name] = F.coalesce(F.col(f.name), F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.array_join(F.coalesce(F.col(f.name), F.array().cast("array<string>")), "|")
    both = F.col("valence").isNotNull() & F.col("energy").isNotNull()
    out["vibe"] = F.when(both, nearest_anchor("valence", "energy")).otherwise(F.lit(""))
    return df.withColumns(out)


def drop_unlabelled(df: DataFrame, cols=("valence", "energy", "vibe")) -> DataFrame:
    """rows with every label present."""
    return df.dropna(subset=list(cols))
