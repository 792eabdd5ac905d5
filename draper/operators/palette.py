"""Dominant colours of image regions: seeded k-means in Lab over all regions of a batch at once.

A region is an (image, mask class). Pixels become counted colours, one ``unique`` over the
batch, and colours the weighted points of every region's k-means: each Lloyd round is a few sums over
all points of the regions that still move, so there is no loop over images or regions and no row is shuffled.
Starts follow k-means++; a point is drawn by the least of ``-log(u) / mass``, u being a hash
of its colour, the seed and the draw, so a region's result does not depend on what else
is in its batch. Every pixel counts in the fit, by its colour's weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draper.functions import color as geometry
from draper.functions import vocab as V

ROUNDS, STILL = 50, 1e-9
#: Pixels that are clustered together; images are never cut.
BLOCK = 4 << 20
CLUSTERS = "image_id string, slot string, label int, n long, lab_l double, lab_a double, lab_b double, source string"


def lab_pixels(rgb: np.ndarray) -> np.ndarray:
    """n x 3 bytes to n x 3 Lab."""
    c = rgb.astype(np.float64) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(geometry.MATRIX).T / np.array(geometry.WHITE)
    x, y, z = np.where(t > geometry.E, np.cbrt(t), (t * geometry.K + 16) / 116).T
    return np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=1)


def uniform(codes: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """In (0, 1), from a mixed hash of the code, the seed and the draw."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + draw * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Regions:
    """Weighted points of many regions: flat arrays, region g from bounds[g] to bounds[g + 1]; none is empty."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, codes: np.ndarray, bounds: np.ndarray):
        self.points, self.weights, self.codes, self.bounds = points, weights.astype(np.float64), codes, bounds
        self.of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def of_regions(self, chosen: np.ndarray) -> tuple[Regions, np.ndarray]:
        """Those regions alone, renumbered, and the places of their points."""
        at = np.flatnonzero(chosen[self.of])
        sizes = np.diff(self.bounds)[chosen]
        return Regions(self.points[at], self.weights[at], self.codes[at], np.r_[0, np.cumsum(sizes)]), at

    def draw(self, mass: np.ndarray, seed: int, nth: int) -> np.ndarray:
        """A point of each region, with a chance in proportion to its mass; without mass the first."""
        with np.errstate(divide="ignore"):
            race = np.where(mass > 0, -np.log(uniform(self.codes, seed, nth)) / np.where(mass > 0, mass, 1), np.inf)
        least = np.minimum.reduceat(race, self.bounds[:-1])
        hits = np.flatnonzero(race == least[self.of])
        return hits[np.unique(self.of[hits], return_index=True)[1]]

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each point's nearest centre of its region (regions x k x 3); the first among equals."""
        best, own = np.full(len(self.points), np.inf), np.zeros(len(self.points), np.int64)
        for j in range(centres.shape[1]):
            d = ((self.points - centres[self.of, j]) ** 2).sum(1)
            nearer = d < best
            best[nearer], own[nearer] = d[nearer], j
        return own, best

    def means(self, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight (regions x k) and mean (regions x k x 3) of the points of each centre."""
        cell, size = self.of * k + own, (len(self.bounds) - 1) * k
        weight = np.bincount(cell, self.weights, size)
        sums = np.stack([np.bincount(cell, self.weights * self.points[:, c], size) for c in range(3)], 1)
        return weight.reshape(-1, k), (sums / np.maximum(weight, 1)[:, None]).reshape(-1, k, 3)

    def starts(self, k: int, seed: int, attempt: int) -> np.ndarray:
        centres = np.empty((len(self.bounds) - 1, k, 3))
        far = np.ones(len(self.points))
        for j in range(k):
            centres[:, j] = self.points[self.draw(self.weights * far, seed, attempt * k + j)]
            d = ((self.points - centres[self.of, j]) ** 2).sum(1)
            far = d if j == 0 else np.minimum(far, d)
        return centres

    def lloyd(self, centres: np.ndarray) -> np.ndarray:
        """Centres after rounds of means; a region that has come to rest is left out of the next."""
        centres, moving = centres.copy(), np.ones(len(centres), bool)
        part, _ = self.of_regions(moving)
        for _ in range(ROUNDS):
            now = centres[moving]
            weight, mean = part.means(part.nearest(now)[0], centres.shape[1])
            moved = np.where(weight[:, :, None] > 0, mean, now)
            centres[moving] = moved
            still = np.abs(moved - now).max((1, 2)) <= STILL
            if still.any():
                moving[np.flatnonzero(moving)[still]] = False
                if not moving.any():
                    break
                part, _ = self.of_regions(moving)
        return centres

    def clusters(self, k: int, seed: int, attempts: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights (regions x k, 0: no cluster) and means; a region of at most k points has each as a cluster of its own."""
        sizes = np.diff(self.bounds)
        weights, means = np.zeros((len(sizes), k)), np.zeros((len(sizes), k, 3))
        nth = np.arange(len(self.of)) - self.bounds[:-1][self.of]
        few = sizes[self.of] <= k
        weights[self.of[few], nth[few]], means[self.of[few], nth[few]] = self.weights[few], self.points[few]
        many = sizes > k
        if many.any():
            part, _ = self.of_regions(many)
            least, best = np.full(many.sum(), np.inf), np.zeros((many.sum(), k, 3))
            for attempt in range(attempts):
                centres = part.lloyd(part.starts(k, seed, attempt))
                inertia = np.bincount(part.of, part.weights * part.nearest(centres)[1], many.sum())
                better = inertia < least
                least[better], best[better] = inertia[better], centres[better]
            weights[many], means[many] = part.means(part.nearest(best)[0], k)
        return weights, means


def clusters(region: np.ndarray, settings: dict = V.PALETTE) -> list[tuple[int, np.ndarray]]:
    """(pixels, mean Lab) of each cluster of one region; no more clusters than distinct colours."""
    colors, counts = np.unique(region, axis=0, return_counts=True)
    found = Regions(colors, counts, np.arange(len(colors)), np.array([0, len(colors)]))
    weights, means = found.clusters(settings["n_clusters"], settings["seed"], settings["n_init"])
    return [(int(n), lab) for n, lab in zip(weights[0], means[0]) if n]


def _block(ids: list, rgbs: list[bytes], masks: list[bytes | None], settings: dict) -> pd.DataFrame:
    """Clusters of each garment class of each image; of the whole image where no usable mask is."""
    slot_of = {c: slot for slot, classes in V.MASK_CLASSES.items() for c in classes}
    garment = np.zeros(256, bool)
    garment[list(slot_of)] = True
    sizes = np.array([len(r) // 3 for r in rgbs])
    fits = [m is not None and len(m) == n for m, n in zip(masks, sizes)]
    image = np.repeat(np.arange(len(ids)), sizes)
    label = np.frombuffer(b"".join(m if fit else bytes(n) for m, n, fit in zip(masks, sizes, fits)), np.uint8)
    masked = np.bincount(image, garment[label], len(ids)) > 0
    rgb = np.frombuffer(b"".join(r[: 3 * n] for r, n in zip(rgbs, sizes)), np.uint8).reshape(-1, 3).astype(np.int64)
    keep = garment[label] | ~masked[image]
    label = np.where(masked[image], label, 0).astype(np.int64)
    key = (image << 32 | label << 24 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2])[keep]
    seen, counts = np.unique(key, return_counts=True)
    if not len(seen):
        return pd.DataFrame(columns=[f.split()[0] for f in CLUSTERS.split(", ")])
    codes = seen & 0xFFFFFF
    colors = lab_pixels(np.stack([codes >> 16, codes >> 8 & 255, codes & 255], 1))
    names, first = np.unique(seen >> 24, return_index=True)
    weights, means = Regions(colors, counts, codes, np.r_[first, len(seen)]).clusters(settings["n_clusters"], settings["seed"], settings["n_init"])
    g, j = np.nonzero(weights)
    at, cls = names[g] >> 8, names[g] & 255
    lab = means[g, j]
    return pd.DataFrame({
        "image_id": [ids[i] for i in at], "slot": [slot_of[c] if masked[i] else None for i, c in zip(at, cls)], "label": cls.astype(np.int32),
        "n": weights[g, j].astype(np.int64), "lab_l": lab[:, 0], "lab_a": lab[:, 1], "lab_b": lab[:, 2], "source": np.where(masked[at], "mask", "wholeimage"),
    })


def _regions(settings: dict):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rgbs, masks = (batch[c].tolist() for c in ("image_id", "rgb", "mask"))
            begin = size = 0
            for i, rgb in enumerate(rgbs):
                size += len(rgb) // 3
                if size >= BLOCK or i == len(rgbs) - 1:
                    yield _block(ids[begin : i + 1], rgbs[begin : i + 1], masks[begin : i + 1], settings)
                    begin, size = i + 1, 0

    return each


def dominant(found: DataFrame, n_colors: int | None = 3, floor: float = V.PALETTE["min_area_fraction"]) -> DataFrame:
    """The dominant clusters of every (image, slot), largest first, with their share of those kept; all of them if n_colors is None.

    A cluster below the floor of its slot's pixels goes, unless none reaches it: then the largest stays.
    """
    if n_colors is not None and n_colors < 1:
        raise ValueError("n_colors is less than 1")
    slot = Window.partitionBy("image_id", "slot")
    image = Window.partitionBy("image_id")
    pixels = F.sum("n").over(slot)
    ranked = found.withColumns({
        "large": F.col("n") >= floor * pixels, "rank": F.row_number().over(slot.orderBy(F.desc("n"), "label", "lab_l", "lab_a", "lab_b")),
        "area": F.when(F.col("source") == "mask", pixels / F.sum("n").over(image)),
    })
    kept = ranked.where(F.col("large") | (F.col("rank") == 1))
    if n_colors is not None:
        kept = kept.where(F.col("rank") <= n_colors)
    kept = kept.withColumn("share", F.col("n") / F.sum("n").over(slot))
    named = geometry.quantize(F.col("lab_l"), F.col("lab_a"), F.col("lab_b"))
    return kept.select("image_id", "slot", "lab_l", "lab_a", "lab_b", "share", "area", "source", named.alias("name"), "rank")


def measure(images: DataFrame, n_colors: int | None = None, settings: dict = V.PALETTE, tasks: int | None = None) -> DataFrame:
    """(image_id, rgb, mask) -> all dominant colours of each slot (or the n_colors largest), or of the whole image (slot null) where no usable mask is.

    rgb holds three bytes a pixel, mask one byte a pixel or null; a mask of another size or
    without garment classes is not usable. A null or empty rgb has no colours. Only the clustering runs in Python.
    Clusters are dealt out by image to so many tasks, if tasks are given.
    """
    rows = images.where("rgb is not null").select(F.col("image_id").cast("string").alias("image_id"), "rgb", "mask")
    found = rows.mapInPandas(_regions(dict(settings)), CLUSTERS)
    return dominant(found.repartition(tasks, "image_id") if tasks else found, n_colors, settings["min_area_fraction"]).drop("rank")
