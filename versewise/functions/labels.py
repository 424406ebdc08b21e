"""Mood labels as Column expressions: nearest anchor, buckets, clipping,
numeric aliases and rule scores. All per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.schema import (ENERGY_BUCKETS, HIGH_CUT, LOW_CUT, SPOTIFY_FEATURES,
                              SPOTIFY_SOURCES, VALENCE_BUCKETS, VIBE_ANCHORS, VIBES)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dist(v: Column, e: Column, av: float, ae: float) -> Column:
    dv = v - F.lit(av)
    de = e - F.lit(ae)
    return dv * dv + de * de


def has_number(c) -> Column:
    """A number that is neither NULL nor NaN."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def nearest_anchor(valence, energy, anchors=VIBE_ANCHORS) -> Column:
    """Name of the closest (valence, energy) anchor; the first anchor wins
    ties. A theta join against the anchor table written as the least of eight
    (distance, place, name): each distance is computed once, no row key, no
    shuffle. NULL or NaN input gives NULL.

    Each input appears in every distance term: pass column references (put a
    computed input in its own projection first), not long expressions."""
    v, e = _col(valence).cast("double"), _col(energy).cast("double")
    best = F.least(*[F.struct(_dist(v, e, av, ae).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("name"))
                     for i, (label, av, ae) in enumerate(anchors)])
    bad = v.isNull() | e.isNull() | F.isnan(v) | F.isnan(e)
    return F.when(~bad, best["name"])


def bucket(c, names=ENERGY_BUCKETS, low: float = LOW_CUT, high: float = HIGH_CUT) -> Column:
    """Three buckets cut at 0.35 and 0.65."""
    c = _col(c)
    return F.when(c < low, names[0]).when(c < high, names[1]).when(c.isNotNull(), names[2])


def energy_bucket(c) -> Column:
    return bucket(c, ENERGY_BUCKETS)


def valence_bucket(c) -> Column:
    return bucket(c, VALENCE_BUCKETS)


def clip01(c) -> Column:
    """Clip to [0, 1]; NULL stays NULL (``greatest`` alone skips it)."""
    x = _col(c).cast("double")
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def clip_round(c, places: int = 3) -> Column:
    return F.round(clip01(c), places)


def vibe_index(c) -> Column:
    """Taxonomy position of a vibe, unknown last (99)."""
    c = _col(c)
    expr = F.lit(99)
    for i, name in reversed(list(enumerate(VIBES))):
        expr = F.when(c == name, F.lit(i)).otherwise(expr)
    return expr


def numeric_features(df: DataFrame, sources=SPOTIFY_SOURCES, features=SPOTIFY_FEATURES) -> dict[str, Column]:
    """Catalog feature columns read with aliases; unparseable -> skip,
    absent -> 0.0; a later alias of the same feature wins over an earlier one."""
    present = set(df.columns)
    out: dict[str, Column] = {}
    for feat in features:
        srcs = [s for s, f in sources if f == feat and s in present]
        vals = [F.expr(f"try_cast(`{s}` AS DOUBLE)") for s in reversed(srcs)]
        out[feat] = F.coalesce(*vals, F.lit(0.0)) if vals else F.lit(0.0)
    return out


def rule_valence(compound) -> Column:
    """Valence without a model = clip(compound / 2 + 1/2)."""
    return clip01(_col(compound) * 0.5 + 0.5)


def rule_energy(tempo_bpm, rms_mean) -> Column:
    """Energy without a model = clip(0.4 tempo/180 + 0.6 min(10 rms, 1))."""
    return clip01(F.lit(0.4) * (_col(tempo_bpm) / 180.0)
                  + F.lit(0.6) * F.least(_col(rms_mean) * 10, F.lit(1.0)))


def sorted_scores(scores: Column, places: int = 3) -> Column:
    """O3: map of class -> score as (class, rounded score) entries sorted by the
    raw score, highest first (ties keep key order)."""
    entries = F.map_entries(scores)
    ordered = F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1)
                           .when(a["value"] < b["value"], 1)
                           .when(a["key"] < b["key"], -1)
                           .when(a["key"] > b["key"], 1).otherwise(0))
    return F.transform(ordered, lambda x: F.struct(x["key"].alias("key"),
                                                   F.round(x["value"], places).alias("value")))
