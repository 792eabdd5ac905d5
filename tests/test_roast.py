import pytest
from pyspark.sql import functions as F

from draper.functions.color import REFERENCE_HUE
from draper.operators import roast as R

SCHEMA = (
    "image_id string, pos int, slot string, category string, color string, pattern string, fabric string, sleeve_length string, length string, "
    "lab_l double, lab_a double, lab_b double, area double"
)


def row(image, pos, slot, category, color, pattern="na", fabric="na", area=None):
    return (image, pos, slot, category, color, pattern, fabric, None, None, None, None, None, area)


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame([
        row("clash", 0, "upper", "blouse", "magenta"), row("clash", 1, "lower", "trousers", "green"),
        row("good", 0, "dress", "slip dress", "black"), row("good", 1, "footwear", "heeled pumps", "white"),
        row("bare", 0, "other", "widget", "unknown"),
        row("bags", 0, "bag", "tote bag", "black"), row("bags", 1, "bag", "backpack", "white"), row("bags", 2, "belt", "woven belt", "gray"), row("bags", 3, "bag", "backpack", "gray"),
        row("wide", 0, "upper", "shirt", "white", area=0.7), row("wide", 1, "lower", "jeans", "black", area=0.1), row("wide", 2, "footwear", "sneakers", "gray", area=0.2),
    ], SCHEMA)


def test_issues(g):
    got = {r.image_id: [(i.code, i.severity, i.message, list(i.garment_refs)) for i in r.issues] for r in R.issues(g).collect()}
    d = abs(REFERENCE_HUE["magenta"] - REFERENCE_HUE["green"])
    assert got["clash"] == [
        ("hue_clash", "major", f"The magenta blouse and the green trousers sit {min(d, 360 - d):.0f} degrees apart in hue.", ["upper_0", "lower_0"]),
        ("missing_footwear", "minor", "No footwear is described for this outfit.", ["upper_0", "lower_0"]),
    ]
    assert got["good"] == [] and got["bare"][0][:2] == ("other", "info")
    assert got["bags"] == [("accessory_overload", "minor", "This outfit has 4 accessories, above the limit of 3.", ["bag_0", "bag_1", "belt_0", "bag_2"])]
    assert got["wide"] == [
        ("proportion_imbalance", "minor", "The white shirt covers 70 percent of the frame.", ["upper_0"]),
        ("proportion_imbalance", "minor", "The white shirt covers 7.0 times the area of the black jeans.", ["upper_0", "lower_0"]),
    ]


def test_roasts(g):
    got = {r.image_id: r for r in R.roast(g).collect()}
    c = got["clash"]
    assert c.tone == "playful" and list(c.grounded_garments) == ["upper_0", "lower_0"] and c.safety_flags == ""
    assert c.roast == "The blouse and the trousers are arguing across the colour wheel. Adding the right pair of shoes would complete the sentence."
    assert list(c.suggestions) == [
        "Let the blouse stay loud and move the trousers to a neutral.", "Repeat one accent colour once and let the rest quiet down.",
        "Add footwear that matches the outfit's overall formality.",
    ]
    good = got["good"]
    assert (good.tone, list(good.suggestions), list(good.grounded_garments)) == ("compliment", ["Keep it exactly as it is."], ["dress_0", "footwear_0"])
    assert good.roast == "Black slip dress and white heeled pumps work together cleanly. The outfit looks considered without trying too hard."
    bare = got["bare"]
    assert bare.tone == "gentle" and bare.roast.startswith("There is not enough reliable detail") and list(bare.grounded_garments) == []
    assert got["wide"].roast == "The proportions are having a hard time finding the waist and hem. A cleaner hem relationship would help the outfit breathe."


def test_no_confidence_is_unscorable(g):
    assert {r.tone for r in R.roast(g.withColumn("confidence", F.lit(0.0))).collect()} == {"gentle"}


def test_empty(g):
    assert R.roast(g.limit(0)).collect() == []
