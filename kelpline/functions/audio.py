"""Audio features: names, windows, and the extraction behind an optional library."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spectral features with mean and variance, in the order of the vector.
SPECTRAL = "chroma_stft rms spectral_centroid spectral_bandwidth rolloff zero_crossing_rate harmony perceptr".split()
N_MFCC = 20
FEATURES = [
    *[f"{name}_{stat}" for name in SPECTRAL for stat in ("mean", "var")],
    "tempo",
    *[f"mfcc{i}_mean" for i in range(1, N_MFCC + 1)],
    *[f"mfcc{i}_var" for i in range(1, N_MFCC + 1)],
]
SAMPLE_RATE = 22_050


def window_bounds(n_samples: Column, rate: int = SAMPLE_RATE, seconds: float = 3.0, least: float = 0.5) -> Column:
    """Array of struct(start, stop) of the tumbling windows of a clip.

    A clip of up to one window is one segment; the last fragment is dropped when it is shorter than
    ``least`` seconds, else kept short.
    """
    width, shortest = int(rate * seconds), int(rate * least)
    n = n_samples.cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(width).cast("long"))
    every = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + width, n).alias("stop")))
    kept = F.filter(every, lambda w: w["stop"] - w["start"] >= shortest)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("stop")))
    return F.when(n <= 0, F.slice(whole, 1, 0)).when(n <= width, whole).otherwise(kept)


def features_of_samples(samples: np.ndarray, rate: int = SAMPLE_RATE) -> np.ndarray:
    """The 57 features of one segment; variances are population variances."""
    try:
        import librosa
    except ImportError as e:
        raise RuntimeError("audio features need librosa; pass precomputed features instead") from e
    harmonic, percussive = librosa.effects.hpss(samples)
    series = [
        librosa.feature.chroma_stft(y=samples, sr=rate),
        librosa.feature.rms(y=samples),
        librosa.feature.spectral_centroid(y=samples, sr=rate),
        librosa.feature.spectral_bandwidth(y=samples, sr=rate),
        librosa.feature.spectral_rolloff(y=samples, sr=rate),
        librosa.feature.zero_crossing_rate(samples),
        harmonic,
        percussive,
    ]
    tempo = float(np.atleast_1d(librosa.beat.beat_track(y=samples, sr=rate)[0])[0])
    mfcc = librosa.feature.mfcc(y=samples, sr=rate, n_mfcc=N_MFCC)
    pairs = [stat for s in series for stat in (np.mean(s), np.var(s))]
    return np.array([*pairs, tempo, *mfcc.mean(axis=1), *mfcc.var(axis=1)], dtype=np.float32)


def clip_features(content: Column) -> Column:
    """n x 57 features of the windows of encoded audio clips."""

    @F.pandas_udf("array<array<float>>")
    def extract(data: pd.Series) -> pd.Series:
        try:
            import librosa
        except ImportError as e:
            raise RuntimeError("decoding audio needs librosa; pass precomputed features instead") from e

        def one(d: bytes):
            samples, rate = librosa.load(io.BytesIO(d), sr=SAMPLE_RATE, mono=True)
            width = 3 * rate
            parts = [samples] if len(samples) <= width else [samples[a : a + width] for a in range(0, len(samples), width)]
            parts = [p for p in parts if len(samples) <= width or len(p) >= rate // 2]
            return [features_of_samples(p, rate).tolist() for p in parts]

        return data.map(one)

    return extract(content)
