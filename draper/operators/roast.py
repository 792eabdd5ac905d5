"""Issues with their garments and messages, and the rule-based roast.

Garments of an outfit travel as one small array beside the aggregates of the rules, in the
same shuffle; witnesses (heaviest, brightest, first clashing pair) are picked from it, the
earliest garment among equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draper.functions import color
from draper.functions.roast_text import COMPLIMENT, EMPTY_SUGGESTION, FOLLOWUPS, KEEP, LEADS, MESSAGES, SUGGESTIONS, UNSCORABLE, UNSCORABLE_SUGGESTION
from draper.functions.rulebook import DEFAULT, Rulebook
from draper.functions.settings import AXES
from draper.functions.text import let, safety_flags
from draper.operators.rules import RULE_CODE, lookup, measures, rule_parts, weighted, with_refs

WORST, MAX_SUGGESTIONS = 2, 5
SEVERITY = {"major": 0, "minor": 1, "info": 2}
ISSUE = "struct<code:string,severity:string,message:string,garment_refs:array<string>>"


def _label() -> Column:
    return F.when(F.col("color") == "unknown", F.col("category")).otherwise(F.concat_ws(" ", F.replace("color", F.lit("_"), F.lit(" ")), "category"))


def _fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), values[name]]
    return F.concat(*out, F.lit(rest))


def _first(items: Column, field: str, largest: bool) -> Column:
    """The garment with the most (or least) of a field, the earliest among equals."""
    known = F.filter(items, lambda x: x[field].isNotNull())
    if largest:
        return F.array_max(F.transform(known, lambda x: F.struct(x[field].alias("v"), (-x["pos"]).alias("p"), x.alias("x"))))["x"]
    return F.array_min(F.transform(known, lambda x: F.struct(x[field].alias("v"), x["pos"].alias("p"), x.alias("x"))))["x"]


def _largest(items: Column, inside) -> Column:
    """The largest measured garment among those inside; ties by ref."""
    known = F.filter(items, lambda x: x["area"].isNotNull() & inside(x["slot"]))
    return F.array_min(F.transform(known, lambda x: F.struct((-x["area"]).alias("v"), x["ref"].alias("p"), x.alias("x"))))["x"]


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def issues(g: DataFrame, book: Rulebook = DEFAULT) -> DataFrame:
    """image_id, overall, subscores, items (garments in order) and issues: code, severity, message and refs, in rule order."""
    fields = ["pos", "ref", "slot", "category", "pattern", "area", "l", "hue", "level", "warm", "exposure"]
    sure = F.bool_and(F.col("confidence") == 0) if "confidence" in g.columns else F.lit(False)
    items = F.sort_array(F.collect_list(F.struct(*fields, _label().alias("label"))))
    m = rule_parts(measures(with_refs(g), (items.alias("items"), F.coalesce(sure, F.lit(False)).alias("unsure")), book), book)
    m = m.withColumn("hued", F.filter("items", lambda x: x["hue"].isNotNull()))
    pairs = F.flatten(F.transform("hued", lambda x, i: F.transform(
        F.slice("hued", i + 2, F.size("hued")), lambda y: F.struct(x.alias("a"), y.alias("b"), color.folded(x["hue"], y["hue"]).alias("delta")))))
    all_items = F.col("items")
    # witnesses of each rule, looked for only where it is broken
    bright, dark = _first(all_items, "l", True), _first(all_items, "l", False)
    highest, lowest = _first(all_items, "level", True), _first(all_items, "level", False)
    warmest, coldest = _first(all_items, "warm", True), _first(all_items, "warm", False)
    barest, large = _first(all_items, "exposure", True), _largest(all_items, lambda s: ~s.isin(book.dominant))
    above, below = _largest(all_items, lambda s: s == "upper"), _largest(all_items, lambda s: s == "lower")
    clash = F.try_element_at(F.filter(pairs, lambda p: p["delta"] >= book.clash), F.lit(1))
    hued = F.when(F.size("hued") > 1, F.slice("hued.ref", 1, book.max_refs)).otherwise(F.array().cast("array<string>"))
    every = F.slice("items.ref", 1, book.max_refs)
    pick = lambda test: F.transform(F.filter("items", test), lambda x: x["ref"])
    accessories = pick(lambda x: x["slot"].isin(book.accessories))
    patterned = pick(lambda x: ~x["pattern"].isin("pure_color", "na"))
    gap, spread = F.col("top") - F.col("bottom"), _whole(F.col("spread"))
    major = F.when(gap >= book.major_formality, "major").otherwise("minor")
    severity = {"hue_clash": F.lit("major"), "season_mismatch": F.lit("major"), "formality_mismatch": major, "other": F.lit("info")}

    def issue(rule: str, refs: Column, **values: Column) -> Column:
        return F.struct(F.lit(RULE_CODE.get(rule, rule)).alias("code"), severity.get(rule, F.lit("minor")).alias("severity"), _fill(MESSAGES[rule], **values).alias("message"), refs.alias("garment_refs"))

    def two(rule: str, a: Column, b: Column, **values: Column) -> Column:
        """The issue of two garments, which are looked for once."""
        told = lambda w: issue(rule, F.array_distinct(F.array(w["a"]["ref"], w["b"]["ref"])), a=w["a"]["label"], b=w["b"]["label"], **values)
        return let(F.struct(a.alias("a"), b.alias("b")), told)

    def ratio(w: Column) -> Column:
        more = lambda f: F.when(w["a"]["area"] >= w["b"]["area"], w["a"][f]).otherwise(w["b"][f])
        less = lambda f: F.when(w["a"]["area"] >= w["b"]["area"], w["b"][f]).otherwise(w["a"][f])
        times = F.format_string("%.1f", F.bround(F.try_divide(more("area"), less("area")), 1))
        return issue("upper_lower_ratio", F.array_distinct(F.array(more("ref"), less("ref"))), a=more("label"), b=less("label"), ratio=times)

    found = {
        "hue_clash": let(clash, lambda c: issue("hue_clash", F.array(c["a"]["ref"], c["b"]["ref"]), a=c["a"]["label"], b=c["b"]["label"], delta=_whole(c["delta"]))),
        "too_many_colors": issue("too_many_colors", hued, families=F.col("families").cast("string"), limit=F.lit(str(book.max_families))),
        "monochrome_flat": issue("monochrome_flat", hued, spread=spread),
        "low_contrast": two("low_contrast", bright, dark, spread=spread),
        "pattern_clash": issue("pattern_clash", F.slice(patterned, 1, book.max_refs), count=F.col("patterned").cast("string"), limit=F.lit(str(book.max_patterns))),
        "formality_mismatch": two("formality_mismatch", highest, lowest, gap=gap.cast("string")),
        "season_mismatch": two("season_mismatch", warmest, barest), "fabric_mismatch": two("fabric_mismatch", warmest, coldest),
        "missing_footwear": issue("missing_footwear", every),
        "accessory_overload": issue("accessory_overload", accessories, count=F.col("accessories").cast("string"), limit=F.lit(str(book.max_accessories))),
        "dominant_area": let(large, lambda x: issue("dominant_area", F.array(x["ref"]), a=x["label"], share=_whole(x["area"] * 100))),
        "upper_lower_ratio": let(F.struct(above.alias("a"), below.alias("b")), ratio),
        "other": issue("other", every),
    }
    made = [F.when(F.array_contains("broken", rule), body.cast(ISSUE)) for rule, body in found.items()]
    return m.select("image_id", weighted(book).alias("overall"), *AXES, "unsure", "items", F.array_compact(F.array(*made)).alias("issues"))


def worst(found: Column, limit: int) -> Column:
    """The most severe issues; ties by code, then refs."""
    rank = lambda x: lookup(SEVERITY, x["severity"])
    keyed = F.transform(found, lambda x: F.struct(rank(x).alias("rank"), x["code"].alias("code"), x["garment_refs"].alias("refs"), x.alias("issue")))
    return F.transform(F.slice(F.sort_array(keyed), 1, limit), lambda k: k["issue"])


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def _labels(refs: Column) -> Column:
    """Categories of the garments of the refs."""
    return F.transform(refs, lambda ref: F.coalesce(F.try_element_at(F.filter("items", lambda x: x["ref"] == ref), F.lit(1))["category"], ref))


def _subject(labels: Column) -> Column:
    the = F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("the "), x))
    last = F.try_element_at(the, F.lit(-1))
    start = F.array_join(F.slice(the, 1, F.greatest(F.size(the) - 1, F.lit(0))), ", ")
    return (
        F.when(F.size(the) == 0, "these pieces").when(F.size(the) == 1, last)
        .when(F.size(the) == 2, F.concat(start, F.lit(" and "), last)).otherwise(F.concat(start, F.lit(", and "), last))
    )


def _by_code(templates: dict[str, str], code: Column, subject: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, template in templates.items():
        out = F.when(code == key, _fill(template, subject=subject, Subject=_capital(subject))).otherwise(out)
    return out


def roast(g: DataFrame, book: Rulebook = DEFAULT, carried: tuple[str, ...] = ()) -> DataFrame:
    """image_id, tone, roast, suggestions, grounded_garments, safety_flags of every outfit, and the columns carried: worst (issues), items."""
    s = issues(g, book).withColumn("worst", worst(F.col("issues"), WORST))
    count = lambda kind: F.size(F.filter("issues", lambda x: x["severity"] == kind))
    zero = (F.col("overall") == 0) & (F.greatest(*AXES) == 0)
    none = F.size("issues") == 0
    s = s.withColumn("unscorable", zero | F.exists("issues", lambda x: x["code"] == "other") | F.col("unsure"))
    tone = (
        F.when(F.col("unscorable"), "gentle").when(none, "compliment").when((F.col("overall") < 30) | (count("major") >= 2), "savage")
        .when((count("major") >= 1) | (count("minor") >= 2) | (F.col("overall") < 60), "playful").otherwise("gentle")
    )
    nth = lambda i: F.try_element_at("worst", F.lit(i))
    s = s.withColumns({"tone": tone, "one": _labels(nth(1)["garment_refs"]), "two": _labels(nth(2)["garment_refs"])})
    s = s.withColumns({"subject_1": _subject(F.col("one")), "subject_2": _subject(F.col("two"))})
    lead = F.lit(None).cast("string")
    for t in ("gentle", "playful", "savage"):
        lead = F.when(F.col("tone") == t, _by_code({c: by[t] for c, by in LEADS.items()}, nth(1)["code"], F.col("subject_1"))).otherwise(lead)
    line = F.concat_ws(" ", lead, F.when(F.size("worst") > 1, _by_code(FOLLOWUPS, nth(2)["code"], F.col("subject_2"))))
    shown = F.slice("items.label", 1, 3)
    last = F.try_element_at(shown, F.lit(-1))
    joined = F.when(F.size(shown) > 1, F.concat(F.array_join(F.slice(shown, 1, F.size(shown) - 1), ", "), F.lit(" and "), last)).otherwise(last)
    told = F.when(F.col("unscorable"), UNSCORABLE).when(none, _fill(COMPLIMENT, garments=_capital(joined))).otherwise(line)

    def advice(i: int, labels: str) -> Column:
        at = lambda n, word: F.coalesce(F.try_element_at(F.col(labels), F.lit(n)), F.lit(word))
        out = F.array().cast("array<string>")
        for code, texts in SUGGESTIONS.items():
            filled = F.array(*[_fill(t, first=at(1, "main piece"), second=at(2, "supporting piece")) for t in texts])
            out = F.when(nth(i)["code"] == code, filled).otherwise(out)
        return out

    given = F.slice(F.array_distinct(F.concat(advice(1, "one"), advice(2, "two"))), 1, MAX_SUGGESTIONS)
    given = F.when(F.size(given) == 0, F.array(F.lit(EMPTY_SUGGESTION))).otherwise(given)
    given = F.when(F.col("unscorable"), F.array(F.lit(UNSCORABLE_SUGGESTION))).when(none, F.array(F.lit(KEEP))).otherwise(given)
    refs = F.array_distinct(F.flatten(F.transform("worst", lambda x: x["garment_refs"])))
    grounded = F.when(F.col("unscorable"), F.array().cast("array<string>")).when(none, F.slice("items.ref", 1, book.max_refs)).otherwise(refs)
    done = s.select("image_id", *carried, "tone", told.alias("roast"), given.alias("suggestions"), grounded.alias("grounded_garments"))
    return done.withColumn("safety_flags", safety_flags(F.concat_ws(" ", "roast", F.array_join("suggestions", " "))))
