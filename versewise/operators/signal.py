"""Framed-signal features.

A signal is an ``array<float>`` column (decoded upstream). Features run in an
Arrow ``pandas_udf``: the signals of a batch that have one length are stacked,
framed as a view without copies and go through numpy together, so a row costs
time in proportion to its frames. Only the parts asked for are computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewise.schema import ROLLOFF_PERCENT, SAMPLE_RATE

TIME = ["rms_mean", "rms_std", "zcr_mean"]
SPECTRAL = ["spectral_centroid_mean", "spectral_centroid_std", "spectral_bandwidth_mean", "spectral_rolloff_mean"]
#: Samples in frames that are held at once.
BLOCK = 1 << 22


def mfcc_names(n_mfcc: int) -> list[str]:
    return [f"mfcc_{i}_{s}" for i in range(n_mfcc) for s in ("mean", "std")]


def to_mel(hz, scale: str = "htk"):
    """Hz to mel: ``htk`` is logarithmic throughout, ``slaney`` linear up to
    1000 Hz and logarithmic above."""
    hz = np.asarray(hz, dtype=np.float64)
    if scale == "htk":
        return 2595.0 * np.log10(1.0 + hz / 700.0)
    return np.where(hz < 1000.0, hz * 3 / 200.0, 15.0 + 27.0 * np.log(np.maximum(hz, 1.0) / 1000.0) / np.log(6.4))


def from_mel(m, scale: str = "htk"):
    m = np.asarray(m, dtype=np.float64)
    if scale == "htk":
        return 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    return np.where(m < 15.0, m * 200.0 / 3, 1000.0 * np.exp(np.log(6.4) * (m - 15.0) / 27.0))


def mel_filterbank(n_fft: int, sr: int, n_mels: int, scale: str = "htk") -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale, 0 .. sr/2; on the
    slaney scale each has unit area."""
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    pts = from_mel(np.linspace(to_mel(0.0, scale), to_mel(sr / 2.0, scale), n_mels + 2), scale)
    lo, c, hi = pts[:-2, None], pts[1:-1, None], pts[2:, None]
    up = (bins - lo) / np.maximum(c - lo, 1e-12)
    down = (hi - bins) / np.maximum(hi - c, 1e-12)
    fb = np.maximum(0.0, np.minimum(up, down))
    return fb * (2.0 / np.maximum(hi - lo, 1e-12)) if scale == "slaney" else fb


def dct_matrix(n_mfcc: int, n_mels: int) -> np.ndarray:
    """Orthonormal DCT-II rows 0 .. n_mfcc - 1."""
    k = np.arange(n_mfcc)[:, None]
    n = np.arange(n_mels)[None, :]
    m = np.cos(np.pi * k * (2 * n + 1) / (2 * n_mels)) * np.sqrt(2.0 / n_mels)
    m[0] /= np.sqrt(2.0)
    return m


class Framing:
    """How signals become features. ``center`` pads half a frame of zeros at
    both ends; ``top_db`` lifts log-mel powers to so many dB below the
    signal's loudest. ``REFERENCE`` has the settings of common audio tools."""

    def __init__(self, frame: int, hop: int, sr: int = SAMPLE_RATE, n_mels: int = 20, n_mfcc: int = 20,
                 roll_percent: float = ROLLOFF_PERCENT, center: bool = False, mel_scale: str = "htk",
                 top_db: float | None = None):
        self.frame, self.hop, self.center, self.top_db, self.roll_percent, self.n_mfcc = frame, hop, center, top_db, roll_percent, n_mfcc
        self.window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)  # periodic Hann
        self.freqs = np.arange(frame // 2 + 1) * sr / frame
        self.fb = mel_filterbank(frame, sr, n_mels, mel_scale)
        self.dct = dct_matrix(n_mfcc, n_mels)

    def names(self, parts) -> list[str]:
        of = {"time": TIME, "spectral": SPECTRAL, "mfcc": mfcc_names(self.n_mfcc)}
        return [n for p in parts for n in of[p]]

    def features(self, x: np.ndarray, parts) -> np.ndarray:
        """Rows of signals of one length -> rows of features."""
        if self.center:
            x = np.pad(x, ((0, 0), (self.frame // 2, self.frame // 2)))
        if x.shape[1] < self.frame:
            return np.zeros((len(x), len(self.names(parts))))
        fr = np.lib.stride_tricks.sliding_window_view(x, self.frame, axis=1)[:, ::self.hop]
        out = []
        if "time" in parts:
            rms = np.sqrt((fr * fr).mean(axis=2))
            zcr = ((fr[..., 1:] < 0) != (fr[..., :-1] < 0)).sum(axis=2) / self.frame
            out += [rms.mean(1), rms.std(1), zcr.mean(1)]
        if "spectral" in parts or "mfcc" in parts:
            mag = np.abs(np.fft.rfft(fr * self.window, axis=2))
        if "spectral" in parts:
            tot = mag.sum(axis=2)
            safe = np.where(tot > 0, tot, 1.0)
            cen = (mag * self.freqs).sum(axis=2) / safe
            bw = np.sqrt((mag * (self.freqs - cen[..., None]) ** 2).sum(axis=2) / safe)
            at = np.argmax(np.cumsum(mag, axis=2) >= self.roll_percent * tot[..., None], axis=2)
            roll = np.where(tot > 0, self.freqs[at], 0.0)
            out += [cen.mean(1), cen.std(1), bw.mean(1), roll.mean(1)]
        if "mfcc" in parts:
            logmel = 10.0 * np.log10(np.maximum(mag ** 2 @ self.fb.T, 1e-10))
            if self.top_db is not None:
                logmel = np.maximum(logmel, logmel.max(axis=(1, 2), keepdims=True) - self.top_db)
            mf = logmel @ self.dct.T
            out += list(np.stack([mf.mean(1), mf.std(1)], axis=2).reshape(len(x), -1).T)
        return np.stack(out, axis=1)


#: Centred frames, 128 mel filters of unit area, 80 dB floor.
REFERENCE = dict(frame=2048, hop=512, n_mels=128, center=True, mel_scale="slaney", top_db=80.0)


def signal_udf(framing: Framing, parts=("time", "spectral", "mfcc")):
    """X21-X23 as a pandas_udf over a signal column; a NULL signal counts as
    empty, and one shorter than a frame gives zeros."""
    names = framing.names(parts)
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def features(sig: pd.Series) -> pd.DataFrame:
        signals = [np.zeros(0) if s is None else np.asarray(s, dtype=np.float64) for s in sig]
        out = np.zeros((len(signals), len(names)))
        size = np.array([len(s) for s in signals])
        for n in np.unique(size):
            rows = np.nonzero(size == n)[0]
            step = max(1, BLOCK // max(1, framing.frame * (n // framing.hop + 1)))
            for at in range(0, len(rows), step):
                lot = rows[at:at + step]
                out[lot] = framing.features(np.stack([signals[i] for i in lot]), parts)
        return pd.DataFrame(out, columns=names)

    return features


def signal_features(df: DataFrame, sig: str, framing: Framing, parts=("time", "spectral", "mfcc")) -> DataFrame:
    """The rows with their signal features."""
    d = df.withColumn("_sig", signal_udf(framing, parts)(F.col(sig)))
    return d.select(*df.columns, "_sig.*")
