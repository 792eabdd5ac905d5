"""The boundary to a hosted writer: prompts out, checked answers in, and the rule-based roast wherever an answer is no good.

No service is called here: a caller sends ``prompt`` and brings the raw answers back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draper.functions.text import safety_flags
from draper.operators.roast import worst

LONGEST_ROAST, LONGEST_SUGGESTION, MOST_SUGGESTIONS = 1000, 280, 5
ANSWER = "roast string, suggestions array<string>"
FIELDS = ["tone", "caption", "garments", "issues"]


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced; an unknown name fails."""
    out = []
    for n, part in enumerate(template.replace("}", "{").split("{")):
        if n % 2 and part not in values:
            raise KeyError(f"the template names {part!r}")
        out.append(values[part] if n % 2 else F.lit(part))
    return F.concat(*out)


def prompts(roasted: DataFrame, persona: str, template: str) -> DataFrame:
    """(image_id, prompt) for rows with garments (ref, color, category, pattern, fabric), issues, tone and caption."""
    lines = lambda items: F.array_join(items, "\n")
    garments = lines(F.transform("garments", lambda g: F.concat(
        F.lit("- "), g["ref"], F.lit(": "), g["color"], F.lit(" "), g["category"], F.lit(", pattern="), g["pattern"], F.lit(", fabric="), g["fabric"])))
    told = F.transform(worst(F.col("issues"), 3), lambda i: F.concat(
        F.lit("- "), i["severity"], F.lit(" / "), i["code"], F.lit(": "), i["message"], F.lit(" (garments: "),
        F.when(F.size(i["garment_refs"]) > 0, F.array_join(i["garment_refs"], ", ")).otherwise("none"), F.lit(")")))
    issues = F.when(F.size("issues") > 0, lines(told)).otherwise("- No issues were reported.")
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption")).otherwise("(no caption)")
    body = fill(template, tone=F.col("tone"), caption=caption, garments=garments, issues=issues)
    return roasted.select("image_id", F.trim(F.concat(F.lit(persona + "\n\n"), body)).alias("prompt"))


def accept(roasted: DataFrame, answers: DataFrame) -> DataFrame:
    """Roasts with the answers (image_id, answer: JSON) that are whole and safe; all others stay rule-based.

    Adds source (hosted or rules) and safety_flags: those of a refused answer.
    """
    a = answers.select("image_id", F.from_json("answer", ANSWER).alias("a"))
    j = roasted.join(a, "image_id", "left")
    said, tips = F.col("a.roast"), F.col("a.suggestions")
    sized = F.length(said).between(1, LONGEST_ROAST) & F.size(tips).between(1, MOST_SUGGESTIONS) & F.forall(tips, lambda t: F.length(t).between(1, LONGEST_SUGGESTION))
    whole = F.coalesce(sized, F.lit(False))
    flags = F.when(whole, safety_flags(F.concat_ws(" ", said, F.array_join(tips, " ")))).otherwise("")
    taken = whole & (flags == "")
    return j.withColumns({
        "roast": F.when(taken, said).otherwise(F.col("roast")), "suggestions": F.when(taken, tips).otherwise(F.col("suggestions")),
        "source": F.when(taken, "hosted").otherwise("rules"), "safety_flags": F.when(taken, "").when(flags != "", flags).otherwise(F.col("safety_flags")),
    }).drop("a")
