"""Label cascade over constant lookup tables.

The tag, genre and market tables are fixed and tiny (19, 24 and 18 rows),
so they are map literals evaluated inside each row's expression: no join,
no shuffle, nothing to broadcast per query. Arrays of tags are handled with
higher-order functions instead of explode + group by, so a song's tags
never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.functions import text as X
from versewise.schema import DEFAULT_MARKET_GENRE, GENRE_ESTIMATES, MARKET_GENRES, TAG_ANCHORS


def _pair_map(rows) -> Column:
    keys = F.array(*[F.lit(k) for k, _, _ in rows])
    vals = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(e).alias("e")) for _, v, e in rows])
    return F.map_from_arrays(keys, vals)


def tag_mood(tags: Column, table=TAG_ANCHORS) -> Column:
    """Mean (valence, energy) of the tags found in the tag table after
    trim + lower; repeated tags count each time; NULL when none match."""
    m = _pair_map(table)
    hits = F.filter(F.transform(tags, lambda t: F.try_element_at(m, F.lower(X.strip(t)))),
                    lambda x: x.isNotNull())
    n = F.size(hits)
    sv = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x["v"])
    se = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x["e"])
    return F.when(n > 0, F.struct((sv / n).alias("valence"), (se / n).alias("energy")))


def genre_mood(genre: Column, table=GENRE_ESTIMATES) -> Column:
    """(valence, energy) of a genre key (X12), NULL when unknown."""
    s = F.try_element_at(_pair_map(table), X.genre_key(genre))
    return F.when(s.isNotNull(), F.struct(s["v"].alias("valence"), s["e"].alias("energy")))


def market_genre(market: Column) -> Column:
    keys = F.array(*[F.lit(k) for k, _ in MARKET_GENRES])
    vals = F.array(*[F.lit(g) for _, g in MARKET_GENRES])
    g = F.try_element_at(F.map_from_arrays(keys, vals), F.upper(market))
    return F.coalesce(g, F.lit(DEFAULT_MARKET_GENRE))


def market_mood(market: Column) -> Column:
    """Market -> genre hint (pop by default) -> (valence, energy)."""
    return genre_mood(market_genre(F.coalesce(market, F.lit(""))))


def first_tags(tags: Column, k: int | None = None) -> Column:
    """S12 helper: non-empty tag names, the first k if given."""
    named = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    return named if k is None else F.slice(named, 1, k)


def label_cascade(df: DataFrame, tags: str = "lastfm_tags", genre_hint: str = "genre_hint",
                  market: str = "market") -> DataFrame:
    """Own labels (both present) -> tags -> genre hint -> market, with
    ``label_source`` spotify / lastfm / genre_estimate / market_estimate and
    the vibe of the chosen pair. Tags that match nothing fall through."""
    own = L.has_number("valence") & L.has_number("energy")
    hint = F.col(genre_hint)
    # each lookup is a column of its own, so its array functions run once a row
    d = df.withColumns({"_tag": tag_mood(F.coalesce(F.col(tags), F.array().cast("array<string>"))),
                        "_gen": F.when(hint.isNotNull() & (hint != ""), genre_mood(hint)),
                        "_mkt": market_mood(F.col(market))})

    def pair(of: str, source: str) -> Column:
        return F.struct(F.col(f"{of}valence").cast("double").alias("valence"), F.col(f"{of}energy").cast("double").alias("energy"),
                        F.lit(source).alias("label_source"))
    chosen = (F.when(own, pair("", "spotify")).when(F.col("_tag").isNotNull(), pair("_tag.", "lastfm"))
              .when(F.col("_gen").isNotNull(), pair("_gen.", "genre_estimate")).otherwise(pair("_mkt.", "market_estimate")))
    out = d.withColumn("_lab", chosen)
    return out.withColumns({
        "valence": F.col("_lab.valence"),
        "energy": F.col("_lab.energy"),
        "label_source": F.col("_lab.label_source"),
        "vibe": L.nearest_anchor("_lab.valence", "_lab.energy"),
    }).drop("_lab", "_tag", "_gen", "_mkt")
