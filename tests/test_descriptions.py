import json

from pyspark.sql import functions as F

from draper.operators import descriptions as D

COLUMNS = "image_id string, has_shape boolean, upper_fabric string, outer_fabric string, lower_fabric string, upper_pattern string, outer_pattern string, lower_pattern string, sleeve_length string, lower_length string, neckline string"


def test_descriptions_and_records(spark):
    table = spark.createDataFrame([
        ("one", True, "denim", "na", "cotton", "floral", "na", "floral", "long", "na", "round"),
        ("two", False, "denim", "na", "na", "na", "na", "striped", "long", "na", "round"),
        ("none", True, *["na"] * 9),
    ], COLUMNS)
    skeleton = spark.createDataFrame([("one", "dress", 0), ("one", "bag", 1)], "image_id string, slot string, pos int")
    g = D.describe(table, skeleton)
    answers = D.training_answers(g)
    assert {r.image_id: r.answer for r in answers.collect()} == {
        "one": "dress: dress | color=unknown | pattern=floral | sleeve_length=long | length=na | neckline=round\nbag: bag | color=unknown",
        "two": "upper: top | color=unknown | pattern=na | fabric=denim\nlower: bottom | color=unknown | pattern=striped | fabric=na",
    }
    record = json.loads(D.conversational(answers.where("image_id = 'two'"), F.concat("image_id", F.lit(".jpg")), "Describe.").first()["record"])
    assert record["image"] == "two.jpg" and record["prompt"] == [{"role": "user", "content": [{"type": "image"}, {"type": "text", "text": "Describe."}]}]
    assert record["completion"][0]["role"] == "assistant" and record["completion"][0]["content"][0]["text"].startswith("upper: top")
