"""Text as Column expressions: keys, serialising and parsing records, safety flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word boundaries that both Java and RE2 read alike, letters of any script included.
LEFT, RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
OTHER = r"[^\p{L}\p{N}_]"
#: Category -> phrases that must be flagged. Fixed values.
UNSAFE = {
    "age": ["too old", "grandma", "your age", "teenager", "only a child"],
    "attractiveness": [rf"your face{OTHER}(?:.*{OTHER})?no favours", "make you attractive", "too ugly", "fix your looks", "the person wearing (?:them|it) is not"],
    "body": ["lost some weight", "flatter stomach", "thighs? look enormous", "your size", "shoulders? (?:are )?far too wide", "too fat", "too skinny"],
    "disability": ["something is wrong with you", "are you blind", "look disabled", "cannot use your hands", "with a limp"],
    "gender": ["men should never wear", "real woman", "you look like a man", "girls should not dress this masculine", "pick a gender"],
    "profanity": ["crap", "hell", "damn", "bloody", "garbage"],
    "implicature": [
        "nothing could have saved", "should not be photographed", "mirror clearly gave up", "fabric can hide", "does not like you",
    ],
    "race": ["people of your race", "your skin tone", "your own culture", "immigrant", "only white people"],
}


def let(value: Column, body) -> Column:
    """body of the value, which is written and evaluated once."""
    return F.transform(F.array(value), body)[0]


def category_key(c: Column) -> Column:
    """A category as the formality table has it: lower case, hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("-"), F.lit(" "))), r"\s+", " "))


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def stem(c: Column) -> Column:
    """File name without folder and last extension (a leading dot begins no extension)."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")


def serialize_garment(fields: list[str]) -> Column:
    category = F.trim(F.regexp_replace(F.replace(F.col("category"), F.lit("|"), F.lit("/")), r"\s+", " "))
    return F.concat_ws(" | ", F.concat("slot", F.lit(": "), category), *[F.concat(F.lit(f"{f}="), F.col(f)) for f in fields])


def parse_line(line: Column, fields: list[str]) -> Column:
    """A line's slot, category and fields as a struct; of a repeated field the last counts, a value may hold ``=``."""

    def read(parts: Column) -> Column:
        head, keyed = F.get(parts, F.lit(0)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        value = lambda f: F.try_element_at(F.filter(keyed, lambda x: x.startswith(f + "=")), F.lit(-1))
        return F.struct(F.split_part(head, F.lit(": "), F.lit(1)).alias("slot"), F.split_part(head, F.lit(": "), F.lit(2)).alias("category"),
                        *[F.substr(value(f), F.lit(len(f) + 2)).alias(f) for f in fields])

    return let(F.split(line, r" \| "), read)


def parse_garment(lines: DataFrame, fields: list[str]) -> DataFrame:
    """line -> slot, category and fields (null where absent)."""
    return lines.withColumn("_g", parse_line(F.col("line"), fields)).select(*lines.columns, "_g.*")


def safety_pattern(*categories: str) -> str:
    return f"{LEFT}(?:{'|'.join(p for c in categories for p in UNSAFE[c])}){RIGHT}"


def safety_flags(c: Column) -> Column:
    """Sorted flags (safety:category) of the phrases that the text holds, joined by commas; one pattern finds the texts that hold any."""
    each = lambda text: F.concat_ws(",", *[F.when(text.rlike(safety_pattern(k)), F.lit(f"safety:{k}")) for k in sorted(UNSAFE)])
    return let(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "), lambda text: F.when(text.rlike(safety_pattern(*sorted(UNSAFE))), each(text)).otherwise(""))
