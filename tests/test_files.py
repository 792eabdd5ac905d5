"""Headers, strict masks and the preflight over folders with broken files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.operators import preflight, preflight_files
from draper.sources import headers, images, masks


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, colour=None, filters=(0,), depth=8, between=b""):
    a = np.asarray(pixels, np.uint8)
    step = a.shape[2] if a.ndim == 3 else 1
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step] if colour is None else colour
    flat, rows = a.reshape(a.shape[0], -1).astype(int), []
    for y, row in enumerate(flat):
        how, up = filters[y % len(filters)], flat[y - 1] if y else np.zeros_like(row)
        left = np.r_[np.zeros(step, int), row[:-step]]
        corner = np.r_[np.zeros(step, int), up[:-step]]
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        rows.append(bytes([how]) + bytes(((row - [0 * row, left, up, (left + up) // 2, near][how]) % 256).astype(np.uint8)))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, colour, 0, 0, 0)
    more = chunk(b"PLTE", bytes(range(256)) * 3) if colour == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + between + more + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def jpeg(width, height, before=b"", mark=0xC0):
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + before + segment(0xE0, b"JFIF\0") + segment(mark, struct.pack(">BHHB", 8, height, width, 3) + bytes(9)) + b"\xff\xda" + bytes(50)


def segments(n):
    return b"".join(b"\xff\xfe" + struct.pack(">H", 4) + b"xy" for _ in range(n))


def test_sizes_of_whole_and_broken_files(spark):
    good = png(np.zeros((7, 5)))
    crc = bytearray(good)
    crc[20] ^= 1
    inside = bytearray(png(np.zeros((7, 5)), between=chunk(b"tEXt", b"hello")))
    inside[45] ^= 1
    cases = {
        "png": (good, (5, 7)), "rgb": (png(np.zeros((3, 9, 3))), (9, 3)), "many chunks": (png(np.zeros((7, 5)), between=chunk(b"tEXt", b"a") * 200), (5, 7)),
        "header crc": (bytes(crc), "wrong checksum"), "chunk crc": (bytes(inside), "wrong checksum"), "cut": (good[:-8], "breaks off"), "cut header": (good[:20], "breaks off"),
        "no end": (good[:-12], "breaks off"), "text first": (good[:8] + chunk(b"tEXt", b"a") + good[8:], "header out of place"),
        "no pixels": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 0, 4, 8, 0, 0, 0, 0)) + chunk(b"IEND", b""), "no pixels"),
        "jpeg": (jpeg(640, 480), (640, 480)), "progressive": (jpeg(8, 4, mark=0xC2), (8, 4)), "fill": (jpeg(8, 4, before=b"\xff\xff\xff\xe1\0\x04ab"), (8, 4)),
        "long jpeg": (jpeg(30, 20, before=segments(3000)), (30, 20)), "huffman first": (jpeg(8, 4, before=b"\xff\xc4\0\x04ab"), (8, 4)), "scan first": (b"\xff\xd8\xff\xda" + bytes(40), "no frame header"),
        "cut jpeg": (jpeg(640, 480)[:15], "breaks off"), "no marker": (b"\xff\xd8\x00\x01\x02", "no marker"), "short segment": (b"\xff\xd8\xff\xe0\x00\x01\x00\x00", "segment of a wrong size"),
        "text": (b"hello, world", "neither PNG nor JPEG"), "empty": (b"", "empty"), "null": (None, "empty"), "two bytes": (b"\xff\xd8", "breaks off"),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "name string, content binary")
    got = {r["name"]: (r["width"], r["height"]) if r["reason"] is None else r["reason"] for r in headers.with_sizes(df).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_class_numbers_of_every_filter_and_kind():
    rng = np.random.default_rng(3)
    for step, colour in ((1, 0), (1, 3), (2, 4), (3, 2), (4, 6)):
        a = rng.integers(0, 256, (10, 6, step))
        for filters in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)):
            assert (masks.class_numbers(png(a, colour, filters)) == a[:, :, 0]).all()
    for wrong in (b"", png(np.zeros((2, 2)), depth=16), png(np.zeros((2, 2)))[:40], png(np.zeros((2, 2)), filters=(0,)).replace(b"IDAT", b"XDAT")):
        with pytest.raises(ValueError):
            masks.class_numbers(wrong)


GOOD = {"upper_fabric": "cotton", "outer_fabric": "na", "lower_fabric": "denim", "upper_pattern": "striped", "outer_pattern": "na", "lower_pattern": "pure_color",
        "sleeve_length": "long", "lower_length": "long", "neckline": "round"}


@pytest.fixture()
def folders(spark, tmp_path):
    """An image for each kind of finding and two sound ones; the files are as broken as their names say."""
    photos, segm = tmp_path / "photos", tmp_path / "segm"
    photos.mkdir(), segm.mkdir()
    names = [*preflight.KINDS, "sound", "indexed"]
    red = np.zeros((8, 8, 3)) + [255, 0, 0]
    upper_lower = np.repeat([[1] * 8, [3] * 8], 4, axis=0)
    for n in names:
        photo, mask = png(red), png(upper_lower)
        if n == "indexed":
            mask = png(upper_lower, colour=3)
        if n == "image_decode":
            photo = photo[:60]
        if n == "mask_decode":
            mask = mask[:-5]
        if n == "dimension_mismatch":
            mask = png(np.ones((4, 8)))
        if n == "mask_labels":
            broken = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"no stream") + chunk(b"IEND", b"")
            mask = broken
        if n == "mask_no_garments":
            mask = png(np.zeros((8, 8)))
        if n != "missing_image":
            (photos / f"{n}.png").write_bytes(photo)
        if n != "missing_mask":
            (segm / (f"{n}_segm.png" if len(n) % 2 else f"{n}.png")).write_bytes(mask)
    (photos / "stray.png").write_bytes(b"not asked for")
    rows = [(n, n != "not_full_body", True, {**GOOD, **({"neckline": "collar"} if n == "annotation_vocabulary" else {})}) for n in names if n != "missing_table_row"]
    table = spark.createDataFrame([(n, body, shape, *v.values()) for n, body, shape, v in rows], f"image_id string, is_full_body boolean, has_shape boolean, {', '.join(c + ' string' for c in GOOD)}")
    return spark.createDataFrame([("train", n) for n in names], "split string, image_id string"), table, str(photos), str(segm)


def test_every_kind_comes_out_of_folders(spark, folders):
    requested, table, photos, segm = folders
    told = preflight_files.training_targets(table, masks.read_label_masks(spark, segm), images.read_photos(spark, photos))
    answers = told.where("image_id <> 'target_build'").withColumn("answer", F.when(F.col("image_id") == "target_round_trip", F.concat("answer", F.lit(" | shade=dark"))).otherwise(F.col("answer")))
    got = {r["image_id"]: r for r in preflight_files.check_folders(spark, requested, table, photos, segm, answers).collect()}
    assert {n: r["kind"] for n, r in got.items()} == {**{n: n for n in preflight.KINDS}, "sound": None, "indexed": None}
    assert got["sound"]["answer"] == got["indexed"]["answer"] == "\n".join([
        "upper: upper | color=red | pattern=striped | fabric=cotton | sleeve_length=long | neckline=round",
        "lower: lower | color=red | pattern=pure_color | fabric=denim | length=long"]).replace("upper: upper", f"upper: {V.MASK_CATEGORY.get('upper', 'upper')}").replace("lower: lower", f"lower: {V.MASK_CATEGORY.get('lower', 'lower')}")
    counts = {r["kind"]: r["errors"] for r in preflight.error_counts(preflight_files.check_folders(spark, requested, table, photos, segm, answers)).collect()}
    assert counts == dict.fromkeys(preflight.KINDS, 1)


def test_targets_are_built_from_the_folders_themselves(spark, folders):
    requested, table, photos, segm = folders
    got = {r["image_id"]: r["kind"] for r in preflight_files.check_folders(spark, requested, table, photos, segm).collect()}
    assert got == {**{n: n for n in preflight.KINDS}, "sound": None, "indexed": None, "target_build": None, "target_round_trip": None}


def test_broken_photographs_are_rows(spark, folders):
    _, _, photos, _ = folders
    got = {r["image_id"]: (r["width"], r["rgb"]) for r in images.read_photos(spark, photos).collect()}
    assert got["stray"] == (None, None) and got["sound"][0] == 8
