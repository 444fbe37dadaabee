"""Image features.  Decoding needs an optional library; colour histograms need only numpy.

Every function that needs a library that is missing raises RuntimeError with its name, so the path of
precomputed descriptors works without any of them.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger images are scaled down to this before features are taken.
LONGEST_SIDE = 512
HUE_BINS, SATURATION_BINS, VALUE_BINS = 16, 8, 8
#: Hue is counted for pixels that are more saturated than this.
LEAST_SATURATION = 25


def decode_rgb(data: bytes) -> np.ndarray:
    """(height, width, 3) of encoded image bytes; empty input and undecodable bytes raise ValueError."""
    if not data:
        raise ValueError("empty image")
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding images needs Pillow") from e
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except Exception as e:
        raise ValueError("not an image") from e


def scaled_size(height: int, width: int, longest: int = 512, enlarge: bool = True) -> tuple[int, int]:
    """Size after scaling the longest side to ``longest``; without ``enlarge`` small images stay."""
    side = max(height, width)
    if side == longest or side < longest and not enlarge:
        return height, width
    return max(1, round(height * longest / side)), max(1, round(width * longest / side))


def _spans(n: int, to: int) -> np.ndarray:
    """(to, n) shares of ``n`` cells that each of ``to`` equal spans covers."""
    edges = np.linspace(0, n, to + 1)
    cell = np.arange(n)
    over = np.clip(np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell), 0, None)
    return over / over.sum(1, keepdims=True)


def shrunk(rgb: np.ndarray, longest: int = LONGEST_SIDE) -> np.ndarray:
    """The image with its longest side cut down to ``longest`` by area averages; smaller ones stay.  Sides are rounded down."""
    height, width = rgb.shape[:2]
    side = max(height, width)
    if side <= longest:
        return rgb
    h, w = max(1, int(height * (longest / side))), max(1, int(width * (longest / side)))
    mean = np.einsum("ah,hwc->awc", _spans(height, h), rgb.astype(np.float64))
    return np.floor(np.einsum("bw,awc->abc", _spans(width, w), mean) + 0.5).astype(np.uint8)


def hsv_of_rgb(rgb: np.ndarray) -> np.ndarray:
    """Hue in [0, 180), saturation and value in [0, 256), per pixel."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    high, low = x.max(1), x.min(1)
    span = high - low
    safe = np.where(span == 0, 1, span)
    r, g, b = x.T
    hue = np.select([high == r, high == g], [60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.where(span == 0, 0, hue % 360) / 2
    saturation = np.where(high == 0, 0, 255 * span / np.where(high == 0, 1, high))
    return np.column_stack([np.floor(hue + 0.5) % 180, np.floor(saturation + 0.5), high])


def hsv_histogram(hsv: np.ndarray) -> np.ndarray:
    """32 bins (16 hue, 8 saturation, 8 value) of unit length; zeros stay zeros."""
    h, s, v = hsv.reshape(-1, 3).T
    vivid = s > LEAST_SATURATION
    bins = [
        np.histogram(h[vivid], bins=HUE_BINS, range=(0, 180))[0],
        np.histogram(s, bins=SATURATION_BINS, range=(0, 256))[0],
        np.histogram(v, bins=VALUE_BINS, range=(0, 256))[0],
    ]
    out = np.concatenate(bins).astype(np.float64)
    length = np.linalg.norm(out)
    return out / length if length else out


def colour_histogram(content: Column, longest: int = LONGEST_SIDE) -> Column:
    """Colour histogram of encoded images, scaled down first; null for what cannot be decoded."""

    @F.pandas_udf("array<double>")
    def extract(data: pd.Series) -> pd.Series:
        def one(d: bytes | None):
            try:
                return hsv_histogram(hsv_of_rgb(shrunk(decode_rgb(d or b""), longest)))
            except ValueError:
                return None

        return data.map(one)

    return extract(content)


def sift_descriptors(content: Column, max_features: int = 0, longest: int = 512) -> Column:
    """n x 128 local descriptors of encoded images; an empty array where there is none."""

    @F.pandas_udf("array<array<float>>")
    def extract(data: pd.Series) -> pd.Series:
        try:
            import cv2
        except ImportError as e:
            raise RuntimeError("local descriptors need OpenCV; pass precomputed descriptors instead") from e
        detector = cv2.SIFT_create(nfeatures=max_features)

        def one(d: bytes | None):
            grey = cv2.imdecode(np.frombuffer(d or b"\0", np.uint8), cv2.IMREAD_GRAYSCALE)
            if grey is None:
                return None
            h, w = scaled_size(*grey.shape, longest)
            how = cv2.INTER_AREA if h < grey.shape[0] else cv2.INTER_CUBIC
            _, found = detector.detectAndCompute(cv2.resize(grey, (w, h), interpolation=how), None)
            return [] if found is None else found.tolist()

        return data.map(one)

    return extract(content)
