"""Colour features of player crops, as Arrow kernels over a table of crops.

crops: crop_id, height, width, pixels (binary, height * width RGB bytes). Colour spaces have 8-bit
ranges: hue 0..179, Lab with an offset of 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value of RGB bytes."""
    c = rgb.astype(float)
    top, span = c.max(axis=-1), np.ptp(c, axis=-1)
    r, g, b = np.moveaxis(c, -1, 0)
    safe = np.where(span > 0, span, 1)
    turn = np.select([top == r, top == g], [60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.round(np.where(span > 0, turn % 360, 0) / 2) % 180
    return np.stack([hue, np.round(255 * span / np.maximum(top, 1)), top], axis=-1)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab under D65 of RGB bytes, L scaled to 0..255."""
    c = rgb / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / (0.950456, 1.0, 1.088754)
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def jersey(image: np.ndarray) -> np.ndarray:
    """Mean Lab of shirt and shorts over the middle 40 % of the width, green damped by its hue; zeros where too little is left."""
    height, width = image.shape[:2]
    out = np.zeros(6)
    if height < 15 or width < 5:
        return out
    middle = image[:, int(width * 0.3) : width - int(width * 0.3)]
    for k, (a, b) in enumerate(((0.1, 0.5), (0.4, 0.9))):
        part = middle[int(height * a) : int(height * b)].reshape(-1, 3)
        h, s, _ = hsv(part).T
        apart = np.abs(h - 60)
        weight = np.clip(np.minimum(apart, 180 - apart) / 30, 0, 1) * (1 - s / 510)
        use = weight > 0.2
        if use.sum() >= 5:
            out[3 * k : 3 * k + 3] = np.average(lab(part[use]), axis=0, weights=weight[use])
    return out


def two_means(points: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Two centres and the label of each point; starts from the ends of the widest axis."""
    axis = points.var(axis=0).argmax()
    centres = points[[points[:, axis].argmin(), points[:, axis].argmax()]].astype(float)
    label = np.zeros(len(points), dtype=int)
    for _ in range(rounds):
        label = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        made = np.stack([points[label == k].mean(axis=0) if (label == k).any() else centres[k] for k in range(2)])
        if np.allclose(made, centres):
            break
        centres = made
    return centres, label


def dominant(image: np.ndarray) -> np.ndarray:
    """The two main Lab colours of the middle half that aren't grass, the upper one first; zeros on failure."""
    height, width = image.shape[:2]
    if height < 20 or width < 10:
        return np.zeros(6)
    crop = image[:, int(width * 0.25) : width - int(width * 0.25)]
    h, s, _ = np.moveaxis(hsv(crop), -1, 0)
    rows, columns = np.nonzero(~((h >= 35) & (h <= 85) & (s > 50)))
    if len(rows) < 20:
        return np.zeros(6)
    centres, label = two_means(lab(crop[rows, columns]))
    if len(set(label.tolist())) < 2:
        return np.zeros(6)
    return np.concatenate(centres[np.argsort([rows[label == k].mean() for k in range(2)])])


def torso(image: np.ndarray) -> np.ndarray:
    """Mean hue, saturation and value of the upper 60 %."""
    part = image[: int(image.shape[0] * 0.6)].reshape(-1, 3)
    return hsv(part).mean(axis=0) if len(part) else np.zeros(3)


def histogram(image: np.ndarray, bins: tuple[int, int, int] = (8, 12, 8), masked: bool = True) -> np.ndarray:
    """The HSV histogram of a crop's jersey, of unit length."""
    height, width = image.shape[:2]
    values = hsv(image)
    use = np.ones((height, width), dtype=bool)
    if masked:
        margin = int(width * 0.2)
        use[:] = False
        use[int(height * 0.1) : int(height * 0.5), margin : width - margin] = True
        h, s, v = np.moveaxis(values, -1, 0)
        use &= ~((h >= 35) & (h <= 85) & (s >= 40) & (v >= 40))
    count = np.histogramdd(values[use], bins=bins, range=((0, 180), (0, 256), (0, 256)))[0].ravel()
    return count / max(np.linalg.norm(count), 1e-12)


def features(crops: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """crop_id and colour, the kernel's vector, NULL where it is all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                image = np.frombuffer(row["pixels"] or b"", np.uint8).reshape(row["height"], row["width"], 3)
                vector = kernel(image) if image.size else np.zeros(1)
                made.append(vector.tolist() if np.any(vector) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.list_(pa.float64()))], names=["crop_id", "colour"])

    return crops.select("crop_id", "height", "width", "pixels").mapInArrow(run, "crop_id bigint, colour array<double>")
