"""Queries for framed-signal features on ``embeddings`` (each 64-float
vector read as a signal; frame 16, hop 8 -> 7 frames)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.operators import signal as SG
from versewise.plans.queries import query, r6
from versewise.sources.tables import table

FRAME, HOP, SR = 16, 8, 22050
FRAMING = SG.Framing(FRAME, HOP, SR)


def _frames_sql(e: str) -> str:
    return (f"CASE WHEN len({e}) >= {FRAME} THEN list_transform(range(0, len({e}) - {FRAME} + 1, {HOP}), "
            f"lambda s: list_slice({e}, s + 1, s + {FRAME})) ELSE [] END")


_RMS = "list_transform(frs, lambda f: sqrt(list_sum(list_transform(f, lambda x: x * x)) / len(f)))"
_ZCR = ("list_transform(frs, lambda f: len(list_filter(range(1, len(f)), "
        "lambda j: (f[j] < 0) <> (f[j + 1] < 0))) / len(f))")


@query("signal_frames", f"""
WITH a AS (SELECT vec_id, {_RMS} AS rms, {_ZCR} AS zcr
           FROM (SELECT vec_id, {_frames_sql('embedding::DOUBLE[]')} AS frs FROM embeddings)),
m AS (SELECT vec_id, rms, zcr, CASE WHEN len(rms) > 0 THEN list_sum(rms) / len(rms) ELSE 0.0 END AS rm FROM a)
SELECT vec_id, round(rm, 6) AS rms_mean,
       round(CASE WHEN len(rms) > 0 THEN sqrt(list_sum(list_transform(rms, lambda r: (r - rm) * (r - rm))) / len(rms))
             ELSE 0.0 END, 6) AS rms_std,
       round(CASE WHEN len(zcr) > 0 THEN list_sum(zcr) / len(zcr) ELSE 0.0 END, 6) AS zcr_mean
FROM m
""")
def signal_frames(spark, sf):
    """X21 + A13: RMS mean/std and zero-crossing rate over frames."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    t = SG.signal_features(e, "embedding", FRAMING, ("time",))
    return t.select("vec_id", *[r6(F.col(c)).alias(c) for c in SG.TIME])


_TWO_PI = "(2 * pi())"
_WIN = f"(0.5 - 0.5 * cos({_TWO_PI} * (j - 1) / {FRAME}))"
_MAG = (f"list_transform(range(0, {FRAME // 2 + 1}), lambda k: sqrt("
        f"pow(list_sum(list_transform(f, lambda x, j: x * {_WIN} * cos({_TWO_PI} * (j - 1) * k / {FRAME}))), 2) + "
        f"pow(list_sum(list_transform(f, lambda x, j: x * {_WIN} * sin({_TWO_PI} * (j - 1) * k / {FRAME}))), 2)))")
_HZ = f"{SR}.0 / {FRAME}"


@query("signal_spectrum", f"""
WITH fr AS (SELECT vec_id, unnest(frs) AS f
            FROM (SELECT vec_id, {_frames_sql('embedding::DOUBLE[]')} AS frs FROM embeddings)),
mg AS (SELECT vec_id, {_MAG} AS mag FROM fr),
sp AS (SELECT vec_id, mag, list_sum(mag) AS tot,
              list_sum(list_transform(mag, lambda m, k: m * (k - 1) * {_HZ})) AS num FROM mg),
c AS (SELECT *, CASE WHEN tot > 0 THEN num / tot ELSE 0.0 END AS cen FROM sp),
b AS (SELECT vec_id, cen,
             CASE WHEN tot > 0 THEN sqrt(list_sum(list_transform(mag, lambda m, k: m * ((k - 1) * {_HZ} - cen)
                                                                                   * ((k - 1) * {_HZ} - cen))) / tot)
                  ELSE 0.0 END AS bw,
             CASE WHEN tot > 0 THEN (list_filter(range(1, {FRAME // 2 + 2}),
                                                 lambda k: list_sum(list_slice(mag, 1, k)) >= 0.85 * tot)[1] - 1) * {_HZ}
                  ELSE 0.0 END AS roll
      FROM c)
SELECT e.vec_id, round(coalesce(avg(cen), 0.0), 3) AS spectral_centroid_mean,
       round(coalesce(stddev_pop(cen), 0.0), 3) AS spectral_centroid_std,
       round(coalesce(avg(bw), 0.0), 3) AS spectral_bandwidth_mean,
       round(coalesce(avg(roll), 0.0), 3) AS spectral_rolloff_mean
FROM embeddings e LEFT JOIN b ON e.vec_id = b.vec_id GROUP BY e.vec_id
""")
def signal_spectrum(spark, sf):
    """Hann-windowed magnitude spectrum per frame; centroid mean/std, bandwidth and 85 % roll-off means (Hz,
    rounded to 3 places since FFT and direct sums differ in the last bits)."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    t = SG.signal_features(e, "embedding", FRAMING, ("spectral",))
    return t.select("vec_id", *[F.round(F.col(c), 3).alias(c) for c in SG.SPECTRAL])


def _matrix_sql(m) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row.tolist()) + "]" for row in m) + "]"


def _mfcc_sql() -> str:
    means = ", ".join(f"round(coalesce(avg(mf[{i + 1}]), 0.0), 3) + 0.0 AS mfcc_{i}_mean, "
                      f"round(coalesce(stddev_pop(mf[{i + 1}]), 0.0), 3) + 0.0 AS mfcc_{i}_std" for i in range(20))
    return f"""
WITH k AS (SELECT {_matrix_sql(FRAMING.fb)} AS fb, {_matrix_sql(FRAMING.dct)} AS dct),
fr AS (SELECT vec_id, unnest(frs) AS f
       FROM (SELECT vec_id, {_frames_sql('embedding::DOUBLE[]')} AS frs FROM embeddings)),
mg AS (SELECT vec_id, list_transform({_MAG}, lambda x: x * x) AS p FROM fr),
lm AS (SELECT vec_id, list_transform(fb, lambda w: 10.0 * log10(greatest(list_dot_product(w, p), 1e-10))) AS l, dct FROM mg, k),
mf AS (SELECT vec_id, list_transform(dct, lambda w: list_dot_product(w, l)) AS mf FROM lm)
SELECT e.vec_id, {means} FROM embeddings e LEFT JOIN mf ON e.vec_id = mf.vec_id GROUP BY e.vec_id
"""


@query("mfcc", _mfcc_sql())
def mfcc(spark, sf):
    """20 MFCC means and standard deviations per signal."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    t = SG.signal_features(e, "embedding", FRAMING, ("mfcc",))
    return t.select("vec_id", *[(F.round(F.col(c), 3) + 0.0).alias(c) for c in SG.mfcc_names(20)])
