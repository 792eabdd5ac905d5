import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draper.functions import color
from draper.operators import palette as P
from draper.operators import perception as op
from draper.sources import images


def png(path, pixels):
    """An 8-bit grey (2-d) or RGB (3-d) PNG."""
    a = np.asarray(pixels, np.uint8)
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_lab_agrees_with_the_scalar_version():
    rgb = np.array([[0, 0, 0], [255, 255, 255], [139, 69, 19], [12, 200, 90]], np.uint8)
    assert np.allclose(P.lab_pixels(rgb), [color.lab_of(tuple(map(int, c))) for c in rgb])


def colours(spark, rgb, mask=None, n_colors=3):
    df = spark.createDataFrame([("x", bytes(np.asarray(rgb, np.uint8).tobytes()), None if mask is None else bytes(mask))], "image_id string, rgb binary, mask binary")
    return [((r.lab_l, r.lab_a, r.lab_b), r.share, r.slot) for r in P.measure(df, n_colors).orderBy("slot", F.desc("share")).collect()]


def test_palette(spark):
    rgb = np.repeat(np.array([[255, 0, 0], [0, 0, 255], [0, 255, 0]], np.uint8), [60, 30, 10], axis=0)
    got = colours(spark, rgb)
    assert np.allclose(got[0][0], color.REFERENCE_LAB["red"]) and [round(s, 9) for _, s, _ in got] == [0.6, 0.3, 0.1]
    noisy = np.clip(rgb.astype(int) + np.random.default_rng(2).integers(-3, 4, rgb.shape), 0, 255).astype(np.uint8)
    near = colours(spark, noisy)
    assert [round(s, 9) for _, s, _ in near] == [0.6, 0.3, 0.1] and all(np.abs(np.subtract(a[0], b[0])).max() < 2 for a, b in zip(near, got))
    assert colours(spark, noisy) == near
    apart = colours(spark, rgb, [1] * 60 + [3] * 40, n_colors=1)
    assert [(round(s, 9), slot) for _, s, slot in apart] == [(1.0, "lower"), (1.0, "upper")]
    rare = np.concatenate([rgb, np.array([[9, 9, 9]], np.uint8)])
    assert len(colours(spark, rare, n_colors=9)) == 3  # one pixel in 101 is below the floor
    big = np.random.default_rng(1).integers(0, 256, (30000, 3)).astype(np.uint8)
    assert sum(n for n, _ in P.clusters(P.lab_pixels(big))) == 30000
    with pytest.raises(ValueError):
        colours(spark, rgb, n_colors=0)


def test_palette_keeps_the_largest_where_none_reaches_the_floor(spark):
    rows = [("x", "upper", 1, n, float(n), 0.0, 0.0, "mask") for n in (5, 7, 6)]
    found = spark.createDataFrame(rows, P.CLUSTERS)
    assert [(r.lab_l, r.share) for r in P.dominant(found, 3, floor=0.9).collect()] == [(7.0, 1.0)]


def test_photos_masks_and_measures(spark, tmp_path):
    photos, masks = tmp_path / "photos", tmp_path / "masks"
    photos.mkdir(), masks.mkdir()
    red_blue = np.zeros((4, 6, 3)) + [255, 0, 0]
    red_blue[:, 3:] = [0, 0, 255]
    for name in ("a.b", "c", "d"):
        png(photos / f"{name}.png", red_blue)
    own = np.zeros((4, 6))
    own[:, :3], own[:, 3], own[0, 4] = 1, 3, 99
    png(masks / "a.b_segm.png", own)
    png(masks / "a.b.png", np.zeros((4, 6)))
    png(masks / "d.png", np.ones((2, 2)))
    read = images.read_photos(spark, str(photos))
    assert read.where("image_id = 'c'").first()["rgb"][:3] == b"\xff\0\0"
    both = images.with_masks(read, images.read_masks(spark, str(masks)))
    assert {r.image_id: r.mask is None for r in both.collect()} == {"a.b": False, "c": True, "d": True}
    got = {(r.image_id, r.slot): r for r in P.measure(both).collect()}
    assert set(got) == {("a.b", "upper"), ("a.b", "lower"), ("c", None), ("d", None)}
    assert got["a.b", "upper"].name == "red" and got["a.b", "lower"].name == "blue" and got["a.b", "upper"].area == 0.75
    assert got["c", None].source == "wholeimage" and got["c", None].area is None
    counts = images.mask_counts(both.where("mask is not null"))
    skeleton = [(r.slot, r.class_id, r.n, r.area) for r in op.mask_skeleton(counts).orderBy("pos").collect()]
    assert skeleton == [("upper", 1, 12, 0.75), ("lower", 3, 4, 0.25)]


def test_heads(spark):
    with pytest.raises(Exception, match="not a finite score"):
        op.decode_heads(spark.createDataFrame([("x", "neckline", [1.0, float("nan")])], "image_id string, head string, scores array<double>")).collect()
    got = op.decode_heads(spark.createDataFrame([("x", "sleeve_length", [1.0, 3.0, 3.0, 0.0, 0.0, 0.0])], "image_id string, head string, scores array<double>")).first()
    assert got.label == "short" and abs(got.probability - np.exp(3) / (np.exp(1) + 2 * np.exp(3) + 3)) < 1e-12


def test_measured_colours_and_targets(spark):
    g = spark.createDataFrame([("x", "upper", 0, "red"), ("x", "lower", 1, "unknown"), ("x", "bag", 2, "unknown")], "image_id string, slot string, pos int, color string")
    m = spark.createDataFrame([("x", s, 1.0, 2.0, 3.0, "blue", 0.5, "mask") for s in ("upper", "lower")], "image_id string, slot string, lab_l double, lab_a double, lab_b double, name string, area double, source string")
    got = {r.slot: r for r in op.apply_measured(g, m).collect()}
    assert (got["upper"].color, got["lower"].color, got["bag"].color) == ("red", "blue", "unknown")
    assert got["upper"].lab_source == "mask" and got["bag"].lab_l is None
    assert op.color_target(g).first()["slot"] == "lower"
