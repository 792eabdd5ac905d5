"""Checks of a training set before a run: vocabulary, artefacts, strict targets, round trip, coverage.

An image has the first kind of error that the cascade finds, or none; counters, examples and
distributions are aggregates over its result, so nothing is kept per image on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.functions.text import let, parse_line

FIELDS = ["color", "pattern", "fabric", "sleeve_length", "length", "neckline"]
#: Label column -> its vocabulary, in the order of the check.
LABELS = {f"{r}_fabric": V.FABRICS for r in ("upper", "outer", "lower")} | {f"{r}_pattern": V.PATTERNS for r in ("upper", "outer", "lower")}
LABELS |= {"sleeve_length": V.SLEEVES, "lower_length": V.LENGTHS, "neckline": V.NECKLINES}
KINDS = [
    "missing_table_row", "not_full_body", "annotation_vocabulary", "missing_image", "missing_mask", "image_decode", "mask_decode",
    "dimension_mismatch", "mask_labels", "mask_no_garments", "target_build", "target_round_trip",
]
RECORDS = "array<struct<slot:string,category:string,fields:array<struct<name:string,value:string>>>>"


def vocabulary_error(vocabularies: dict[str, list[str]] = LABELS) -> Column:
    """The first label outside its vocabulary, as text; null if all are inside."""
    each = [
        F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.concat(F.lit(f"{c}='"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit("' is outside the canonical vocabulary")))
        for c, values in vocabularies.items()
    ]
    return F.coalesce(*each)


def _before(c: Column, mark: str) -> Column:
    return F.trim(F.substring_index(c, mark, 1))


def _behind(c: Column, mark: str) -> Column:
    return F.trim(F.substr(c, F.instr(c, mark) + 1))


def target_records(answer: Column) -> Column:
    """Strict grammar of answers: struct(error, records); the first error in reading order, else null.

    A line is ``slot: category | name=value | ...``; blank lines don't count.
    """
    trimmed = lambda c, by: F.filter(F.transform(F.split(c, by), lambda y: F.trim(y)), lambda x: x != "")

    def field(p: Column) -> Column:
        return F.struct(p.alias("part"), _before(p, "=").alias("name"), _behind(p, "=").alias("value"))

    def judged(x: Column, category: Column, fields: Column) -> Column:
        names = fields["name"]
        wrong = lambda f, i: (
            F.when(~f["part"].contains("="), F.concat(F.lit("Target field is not keyed: "), f["part"]))
            .when(~f["name"].isin(FIELDS), F.concat(F.lit("Unexpected target field "), f["name"]))
            .when(f["value"] == "", F.concat(F.lit("Target field "), f["name"], F.lit(" has an empty value")))
            .when(F.array_position(names, f["name"]) <= i, F.concat(F.lit("Target field "), f["name"], F.lit(" is repeated")))
        )
        error = (
            F.when(~x.contains(":"), F.concat(F.lit("Target line has no slot delimiter: "), x))
            .when(category.isNull(), F.concat(F.lit("Target line has no category: "), x))
            .otherwise(F.get(F.array_compact(F.transform(fields, wrong)), F.lit(0)))
        )
        plain = F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))
        return F.struct(error.alias("error"), F.struct(_before(x, ":").alias("slot"), category.alias("category"), plain.alias("fields")).alias("record"))

    def read(x: Column) -> Column:
        rest = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), field)
        return let(trimmed(_behind(x, ":"), r"\|"), lambda parts: let(rest(parts), lambda fields: judged(x, F.get(parts, F.lit(0)), fields)))

    def whole(lines: Column) -> Column:
        error = F.when(F.size(lines) == 0, "Target contains no garment records").otherwise(F.get(F.array_compact(lines["error"]), F.lit(0)))
        return F.struct(error.alias("error"), lines["record"].alias("records"))

    return let(F.transform(trimmed(answer, r"\R"), read), whole)


def _trip(strict: Column, records: Column, garments: Column) -> Column:
    """The first error of an answer's records or the first field of them that the parsed garments don't have; null if all are there."""
    n = F.coalesce(F.size(garments), F.lit(0))

    def wrong(x: Column, i: Column) -> Column:
        g = F.get(garments, i)
        at = F.concat(F.lit("record "), i.cast("string"), F.lit(": "))
        differs = lambda name, got, want: F.when(~got.eqNullSafe(want), F.concat(at, F.lit(name), F.lit(" became "), F.coalesce(got, F.lit("null")), F.lit(", expected "), want))
        own = lambda f: F.get(F.filter(x["fields"], lambda y: y["name"] == f), F.lit(0))["value"]
        kept = lambda f: let(own(f), lambda v: F.when(v.isNotNull(), differs(f, g[f], v)))
        return F.coalesce(differs("slot", g["slot"], x["slot"]), differs("category", g["category"], x["category"]), *map(kept, FIELDS))

    count = F.concat(F.lit("parser returned "), n.cast("string"), F.lit(" garments for "), F.size(records).cast("string"), F.lit(" target records"))
    return F.coalesce(strict, F.when(n != F.size(records), count), F.get(F.array_compact(F.transform(records, wrong)), F.lit(0)))


def round_trip_errors(answers: DataFrame, parsed: DataFrame) -> DataFrame:
    """(image_id, error): the first field of an answer's records that the parsed garments (arrays by image) don't have."""
    t = answers.select("image_id", target_records(F.col("answer")).alias("t")).select("image_id", F.col("t.error").alias("strict"), F.col("t.records").alias("r"))
    j = t.join(parsed.select("image_id", F.col("garments").alias("g")), "image_id", "left")
    return j.select("image_id", _trip(F.col("strict"), F.col("r"), F.col("g")).alias("error"))


def _keyed(answer: Column) -> Column:
    """The garments of an answer, read back as keyed lines without any guessing."""
    return F.transform(F.split(answer, "\n"), lambda line, pos: let(parse_line(line, FIELDS), lambda g: F.struct(pos.alias("pos"), *[g[c].alias(c) for c in ("slot", "category", *FIELDS)])))


def keyed_garments(answers: DataFrame) -> DataFrame:
    """(image_id, garments) of answers, one for each image."""
    return answers.select("image_id", _keyed(F.col("answer")).alias("garments")).where("garments is not null")


def known_colors(garments: Column) -> Column:
    """The garments with colours that no vocabulary has as unknown."""
    return F.transform(garments, lambda g: g.withField("color", F.when(g["color"].isin(*V.REFERENCE_RGB, "unknown"), g["color"]).otherwise("unknown")))


def tried_answers(answers: DataFrame, known=lambda garments: garments) -> DataFrame:
    """Answers with their records and the error of their round trip by keyed lines, in one row; ``known`` is what the parser makes of the garments."""
    t = answers.select("image_id", "answer", target_records(F.col("answer")).alias("t"), _keyed(F.col("answer")).alias("g"))
    t = t.select("image_id", "answer", F.col("t.error").alias("strict"), F.col("t.records").alias("records"), known(F.col("g")).alias("g"))
    return t.select("image_id", "answer", "records", _trip(F.col("strict"), F.col("records"), F.col("g")).alias("trip"))


def cascade(requested: DataFrame, table: DataFrame, images: DataFrame, masks: DataFrame, answers: DataFrame, round_trips: DataFrame | None = None) -> DataFrame:
    """(split, image_id, kind, detail, answer) of every requested image; kind is null where all checks pass.

    requested: split, image_id. table: image_id, is_full_body and the label columns. images, masks: image_id,
    width, height (null where it can't be decoded); masks also have slots (null where labels are wrong).
    answers: image_id, answer. round_trips: image_id, error; without them answers are what ``tried_answers`` gives.
    """
    t = table.withColumn("vocabulary", vocabulary_error()).select("image_id", "is_full_body", "vocabulary", F.lit(True).alias("in_table"))
    i = images.select("image_id", F.struct("width", "height").alias("image"), F.lit(True).alias("in_images"))
    m = masks.select("image_id", F.struct("width", "height").alias("mask"), "slots", F.lit(True).alias("in_masks"))
    if round_trips is None:
        told = [answers.select("image_id", "answer", F.transform("records", lambda r: r["slot"]).alias("told"), "trip")]
    else:
        told = [answers.select("image_id", "answer", F.transform(target_records(F.col("answer"))["records"], lambda r: r["slot"]).alias("told")), round_trips.select("image_id", F.col("error").alias("trip"))]
    j = requested
    for side in (t, i, m, *told):
        j = j.join(side, "image_id", "left")
    size = lambda c: F.concat(F.lit("("), F.col(f"{c}.width").cast("string"), F.lit(", "), F.col(f"{c}.height").cast("string"), F.lit(")"))
    slots = F.col("told")
    shown = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    checks = {
        "missing_table_row": (F.col("in_table").isNull(), F.lit("absent from the table")),
        "not_full_body": (~F.coalesce("is_full_body", F.lit(False)), F.lit("split row is not marked full-body")),
        "annotation_vocabulary": (F.col("vocabulary").isNotNull(), F.col("vocabulary")),
        "missing_image": (F.col("in_images").isNull(), F.lit("no photograph")),
        "missing_mask": (F.col("in_masks").isNull(), F.lit("no parsing mask")),
        "image_decode": (F.col("image.width").isNull(), F.lit("photograph can't be decoded")),
        "mask_decode": (F.col("mask.width").isNull(), F.lit("mask can't be decoded")),
        "dimension_mismatch": (F.col("image") != F.col("mask"), F.concat(F.lit("image="), size("image"), F.lit(", mask="), size("mask"))),
        "mask_labels": (F.col("slots").isNull(), F.lit("mask labels can't be read")),
        "mask_no_garments": (F.size("slots") == 0, F.lit("mask contains no configured garment labels")),
        "target_build": (F.col("answer").isNull(), F.lit("no target")),
        "target_round_trip": (
            F.col("trip").isNotNull() | (slots != F.col("slots")),
            F.coalesce(F.col("trip"), F.concat(F.lit("target slots "), shown(slots), F.lit(" do not match mask slots "), shown(F.col("slots")))),
        ),
    }
    kind, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(KINDS):
        wrong, told = checks[name]
        kind, detail = F.when(wrong, name).otherwise(kind), F.when(wrong, told).otherwise(detail)
    return j.select("split", "image_id", kind.alias("kind"), detail.alias("detail"), F.when(kind.isNull(), F.col("answer")).alias("answer"))


def error_counts(checked: DataFrame) -> DataFrame:
    """split, requested, built and one row for each kind of error found (kind null: none)."""
    each = checked.groupBy("split", "kind").agg(F.count("*").alias("n"))
    found = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", F.col("n").alias("errors"))))
    n = each.groupBy("split").agg(F.sum("n").alias("requested"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("built"), found.alias("found"))
    return n.select("split", "requested", "built", F.explode_outer("found").alias("x")).select("split", "requested", "built", "x.*")


def error_examples(checked: DataFrame, examples: int = 5) -> DataFrame:
    """(split, kind, examples): the first image ids of each kind with their details."""
    by = Window.partitionBy("split", "kind").orderBy("image_id")
    few = checked.where("kind is not null").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= examples)
    told = F.struct("nth", F.concat(F.col("image_id").cast("string"), F.lit(": "), F.col("detail")).alias("text"))
    return few.groupBy("split", "kind").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text"]).alias("examples"))


def target_counts(checked: DataFrame) -> DataFrame:
    """(split, counter, value, n): slots, categories, fields by slot, and values by field, of the targets that passed."""
    r = checked.where("answer is not null").select("split", F.explode(target_records(F.col("answer"))["records"]).alias("r")).groupBy("split", "r").agg(F.count("*").alias("n"))
    one = lambda counter, value: F.struct(F.lit(counter).alias("counter"), value.alias("value"))
    fields = F.flatten(F.transform("r.fields", lambda f: F.array(
        one("field_presence", F.concat_ws(".", F.col("r.slot"), f["name"])), F.struct(F.concat(F.lit("value:"), f["name"]).alias("counter"), f["value"].alias("value")))))
    every = F.concat(F.array(one("slot", F.col("r.slot")), one("category", F.col("r.category"))), fields)
    return r.select("split", "n", F.explode(every).alias("x")).groupBy("split", "x.counter", "x.value").agg(F.sum("n").alias("n"))


def target_distributions(checked: DataFrame) -> DataFrame:
    """(split, measure, lowest, median, p95, p99, highest) of characters and lines of the targets, by nearest rank."""
    t = checked.where("answer is not null")
    m = t.select("split", F.explode(F.array(
        F.struct(F.lit("target_characters").alias("measure"), F.length("answer").alias("v")),
        F.struct(F.lit("target_lines").alias("measure"), F.size(target_records(F.col("answer"))["records"]).alias("v")))).alias("x")).select("split", "x.*")
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)")
    return m.groupBy("split", "measure").agg(F.min("v").alias("lowest"), disc(0.5).alias("median"), disc(0.95).alias("p95"), disc(0.99).alias("p99"), F.max("v").alias("highest"))


def coverage_findings(counts: DataFrame) -> DataFrame:
    """(severity, field, found): slots and values that val has and train lacks; a derived colour is a warning with its count, all else an error."""
    named = counts.where("counter = 'slot' or counter like 'value:%'").withColumn("field", F.replace("counter", F.lit("value:"), F.lit("")))
    of = lambda split: F.sum(F.when(F.col("split") == split, F.col("n")))
    gaps = named.groupBy("field", "value").agg(of("val").alias("n"), of("train").alias("train")).where("n is not null and train is null")
    severity = F.when(F.col("field") == "color", "warning").otherwise("error")
    told = F.when(F.col("field") == "color", F.concat_ws("=", "value", F.col("n").cast("string"))).otherwise(F.col("value"))
    return gaps.groupBy(severity.alias("severity"), "field").agg(F.array_join(F.array_sort(F.collect_list(told)), ", ").alias("found"))
