"""Colour geometry as Column expressions: sRGB to CIELAB, chroma, hue, families, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from draper.functions.vocab import ACHROMATIC, ANALOGOUS, HUE_NAMES, REFERENCE_RGB, TOLERANCE

MATRIX = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
E = 216 / 24389
K = 24389 / 27


def srgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) of 0-255 channels under D65."""
    linear = []
    for c in (r, g, b):
        v = c / F.lit(255.0)
        linear.append(F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))
    f = []
    for row, white in zip(MATRIX, WHITE):
        t = sum((c * w for c, w in zip(linear[1:], row[1:])), linear[0] * row[0]) / white
        f.append(F.when(t > E, F.cbrt(t)).otherwise((t * K + 16) / 116))
    return f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200


def lab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """The same on the driver, for the reference colours."""
    lin = [v / 12.92 if (v := c / 255) <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for c in rgb]
    f = [math.cbrt(t) if (t := sum(x * y for x, y in zip(row, lin)) / w) > E else (t * K + 16) / 116 for row, w in zip(MATRIX, WHITE)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


REFERENCE_LAB = {k: lab_of(v) for k, v in REFERENCE_RGB.items()}
REFERENCE_HUE = {k: math.degrees(math.atan2(REFERENCE_LAB[k][2], REFERENCE_LAB[k][1])) % 360 for k in HUE_NAMES}


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue(a: Column, b: Column, achromatic: float = ACHROMATIC) -> Column:
    """Angle in [0, 360); null below the achromatic threshold."""
    return F.when(chroma(a, b) >= achromatic, F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))


def folded(x: Column, y: Column) -> Column:
    d = F.abs(x - y)
    return F.least(d, 360 - d)


def hue_family(angle: Column) -> Column:
    """The nearest of twelve reference hues; ties by name."""
    named = [F.struct(folded(angle, F.lit(h)).alias("d"), F.lit(n).alias("name")) for n, h in REFERENCE_HUE.items()]
    return F.when(angle.isNotNull(), F.array_min(F.array(*named))["name"])


def nearest_name(l: Column, a: Column, b: Column) -> Column:
    """The reference colour at the least CIE76 distance, the first among equals; unknown if not finite."""
    squares = [
        F.struct(((l - x) * (l - x) + (a - y) * (a - y) + (b - z) * (b - z)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"))
        for i, (n, (x, y, z)) in enumerate(REFERENCE_LAB.items())
    ]
    bad = l.isNull() | a.isNull() | b.isNull() | F.isnan(l) | F.isnan(a) | F.isnan(b)
    return F.when(bad, "unknown").otherwise(F.array_min(F.array(*squares))["name"])


def quantize(l: Column, a: Column, b: Column) -> Column:
    """Rule cascade from Lab to a colour name."""
    c = chroma(a, b)
    family = hue_family(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    warm = family.isin("orange", "yellow")
    return (
        F.when(l.isNull() | a.isNull() | b.isNull() | F.isnan(l + a + b), "unknown")
        .when((c >= 5) & (c <= 28) & (l >= 70) & warm, "beige")
        .when(c < 18, F.when(l <= 20, "black").when(l >= 90, "white").otherwise("gray"))
        .when((l <= 50) & (c <= 75) & warm, "brown")
        .when((l <= 30) & (c <= 95) & family.isin("azure", "blue", "violet"), "navy")
        .otherwise(family)
    )


def relation(delta: Column, complementary: float = TOLERANCE, analogous: float = ANALOGOUS, triadic: float = TOLERANCE) -> Column:
    return (
        F.when(delta >= 180 - complementary, "complementary").when(delta <= analogous, "analogous").when(F.abs(delta - 120) <= triadic, "triadic_candidate").otherwise("none")
    )
