"""Rendered images read back through headers, strict masks, photographs and palettes."""

import numpy as np

from draper.operators import palette
from draper.sources import fixtures, headers, images, masks


def test_rendered_images_read_back(spark, tmp_path):
    shapes = [(2, 3, 30, 70, 1, 255, 0, 0), (10, 60, 50, 129, 3, 0, 0, 255), (20, 65, 25, 75, 1, 255, 0, 0), (-5, 140, 500, 500, 11, 0, 255, 0), (9, 9, 9, 20, 4, 1, 1, 1)]
    spec = spark.createDataFrame([("a", 40, 150, 9, 9, 9, shapes), ("b", 1, 1, 1, 2, 3, []), ("c", 7, 64, 200, 200, 200, None)], fixtures.SPEC)
    want, photo = np.zeros((150, 40), np.uint8), np.full((150, 40, 3), 9, np.uint8)
    for x0, y0, x1, y1, c, *rgb in shapes:
        want[y0:y1, max(x0, 0) : x1], photo[y0:y1, max(x0, 0) : x1] = c, rgb
    made = fixtures.render(spec)
    got = {r["image_id"]: r for r in made.collect()}
    assert (masks.class_numbers(bytes(got["a"]["segm"])) == want).all() and masks.class_numbers(bytes(got["b"]["segm"])).tolist() == [[0]]
    folders = [str(tmp_path / f) for f in ("photos", "segm")]
    fixtures.write_files(made, *folders)
    sizes = {r["image_id"]: (r["width"], r["height"], r["reason"]) for r in headers.read_headers(spark, folders[0]).collect()}
    assert sizes == {"a": (40, 150, None), "b": (1, 1, None), "c": (7, 64, None)}
    pixels, segm = images.read_photos(spark, folders[0]), masks.read_label_masks(spark, folders[1])
    assert bytes(pixels.where("image_id = 'a'").first()["rgb"]) == photo.tobytes()
    counts = {(r["image_id"], r["class_id"]): r["n"] for r in images.mask_counts(segm).collect()}
    assert counts == {("a", int(c)): int((want == c).sum()) for c in np.unique(want)} | {("b", 0): 1, ("c", 0): 7 * 64}
    found = {(r["image_id"], r["slot"]): r["name"] for r in palette.measure(images.with_masks(pixels, segm)).collect()}
    assert found == {("a", "upper"): "red", ("a", "lower"): "blue", ("a", "footwear"): "green", ("b", None): "black", ("c", None): found["c", None]}
