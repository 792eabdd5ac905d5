"""Grouped k-means of many regions against plain loops over one region at a time."""

import math

import numpy as np

from draper.functions import vocab as V
from draper.operators import palette as P


def plain_uniform(code, seed, draw):
    mask = 2**64 - 1
    x = (code + seed * 0x9E3779B97F4A7C15 + draw * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & mask
    x ^= x >> 31
    return ((x >> 11) + 0.5) / 2.0**53


def square(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q))


def plain(points, weights, codes, k, seed, attempts):
    """[(weight, mean)] of one region, by loops."""
    if len(points) <= k:
        return [(w, p) for w, p in zip(weights, points)]

    def owners(centres):
        return [min(range(k), key=lambda j: (square(p, centres[j]), j)) for p in points]

    def mean(own, j):
        w = sum(v for v, o in zip(weights, own) if o == j)
        return w, [sum(v * p[c] for v, p, o in zip(weights, points, own) if o == j) / w for c in range(3)] if w else None

    best = None
    for attempt in range(attempts):
        far, centres = [1.0] * len(points), []
        for j in range(k):
            race = [-math.log(plain_uniform(c, seed, attempt * k + j)) / (w * f) if w * f > 0 else math.inf for c, w, f in zip(codes, weights, far)]
            centres.append(list(points[race.index(min(race))]))
            far = [square(p, centres[j]) if j == 0 else min(f, square(p, centres[j])) for p, f in zip(points, far)]
        for _ in range(P.ROUNDS):
            own = owners(centres)
            moved = [mean(own, j)[1] or centres[j] for j in range(k)]
            still = max(abs(a - b) for m, c in zip(moved, centres) for a, b in zip(m, c)) <= P.STILL
            centres = moved
            if still:
                break
        inertia = sum(w * min(square(p, c) for c in centres) for p, w in zip(points, weights))
        if best is None or inertia < best[0]:
            best = (inertia, centres)
    own = owners(best[1])
    return [m for m in (mean(own, j) for j in range(k)) if m[0]]


def test_all_regions_at_once_equal_each_alone():
    rng = np.random.default_rng(7)
    sizes = [1, 2, 5, 6, 30, 80, 3, 41, 120, 7]
    regions = []
    for n in sizes:
        rgb = np.unique(rng.integers(0, 256, (n, 3)), axis=0)
        codes = rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
        regions.append((P.lab_pixels(rgb), rng.integers(1, 50, len(rgb)), codes))
    bounds = np.r_[0, np.cumsum([len(r[0]) for r in regions])]
    many = P.Regions(*(np.concatenate([r[i] for r in regions]) for i in range(3)), bounds)
    weights, means = many.clusters(5, 11, 3)
    for g, (points, w, codes) in enumerate(regions):
        want = sorted(plain(points.tolist(), w.tolist(), codes.tolist(), 5, 11, 3))
        got = sorted((int(n), m.tolist()) for n, m in zip(weights[g], means[g]) if n)
        assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([m for _, m in got], [m for _, m in want])


def test_result_does_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 400))
        rgb, mask = rng.integers(0, 256, (n, 3)).astype(np.uint8), rng.integers(0, 25, n).astype(np.uint8)
        rows.append((f"i{i:02}", rgb.tobytes(), None if i % 5 == 0 else bytes(mask[: n - i % 2])))
    rows += [("empty", b"", None), ("null", None, None), ("i01", rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "image_id string, rgb binary, mask binary")
    whole = sorted(map(tuple, P.measure(df.coalesce(1), 3).collect()), key=str)
    assert whole == sorted(map(tuple, P.measure(df.repartition(7), 3).collect()), key=str)
    assert {r[0] for r in whole} == {r[0] for r in rows} - {"empty", "null"}


def test_settings_take_effect(spark):
    rgb = np.repeat(np.array([[255, 0, 0], [250, 0, 0], [0, 0, 255]], np.uint8), [50, 30, 20], axis=0)
    df = spark.createDataFrame([("x", rgb.tobytes(), None)], "image_id string, rgb binary, mask binary")
    assert [round(r.share, 9) for r in P.measure(df, 3, {**V.PALETTE, "n_clusters": 2}).collect()] == [0.8, 0.2]
    assert [round(r.share, 9) for r in P.measure(df, 3, {**V.PALETTE, "min_area_fraction": 0.25}).collect()] == [0.625, 0.375]


def test_all_dominant_colours_are_measured(spark):
    rgb = np.repeat(np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 0], [0, 0, 0]], np.uint8), [40, 30, 15, 14, 1], axis=0)
    df = spark.createDataFrame([("x", rgb.tobytes(), bytes([1] * 70 + [3] * 30)), ("y", rgb.tobytes(), None)], "image_id string, rgb binary, mask binary")
    got = sorted((r.image_id, str(r.slot), round(r.share, 6)) for r in P.measure(df).collect())
    assert [g for g in got if g[0] == "x"] == [("x", "lower", round(1 / 30, 6)), ("x", "lower", round(14 / 30, 6)), ("x", "lower", 0.5), ("x", "upper", round(3 / 7, 6)), ("x", "upper", round(4 / 7, 6))]
    assert len([g for g in got if g[0] == "y"]) == 3 and len(P.measure(df, 1).collect()) == 3


def test_palette_query_returns_more_than_the_first_colour(spark):
    from draper.plans import catalogue

    found = catalogue.QUERIES["palette"](spark, "/root/testdata/sf0.001")
    assert found.groupBy("image_id", "slot").count().where("count > 1").count() > 0
