"""Personal data by weak supervision, in DataFrame operations only.

Base patterns find addresses, IP numbers, cards and phones (``BASE``: a match has to pass its
kind's test). Behind them, ``WIDE`` finds what is written otherwise (``name (at) host (dot) org``,
phones without a plus sign, other numbers) in what the base spans leave. Every candidate of
either sort gets votes (1: personal, -1: not, 0: none) by labelers that know little: the
base test, the form of its digits, gazetteers (domains, issuers of cards, dialling codes,
reserved networks), words before it, and the characters beside it. Expectation-maximisation
(a two-class naive model per kind, votes independent given the class) estimates each
labeler's reliability from the counts of vote patterns; its posteriors are the soft labels on which
a logistic regression over the candidates' features is trained, per kind. Wide candidates that
the regression holds for personal become spans; base spans always stay.

Statistics are counts over all documents by vote and feature patterns: 3 ** 5 patterns of votes and 2 ** 8 of
features at most for each kind, whatever the input. Both fits run in one row a kind as higher-order
functions. Texts never leave the task that reads them: a written table keeps matches,
the lengths between them and ``CONTEXT`` characters before each; places are running sums over one document's.

Patterns are written so that their time and stack stay linear in the text: repetitions that
cannot give back are possessive, and a match begins where its run of characters does or where the last match ended.

Defined cases: null text is empty; null ids are kept; repeated rows have equal results; an empty
table gives no rows; kinds without candidates fit nothing and add nothing; columns of other names are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draper.llm.common import Scratch, settings

KINDS = ["email", "ip", "card", "phone"]
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other ways of writing; the order decides between alternatives that begin at one place.
WIDE = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9A-Za-z])",
    r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2,3}(?![0-9])",
    r"(?<![0-9])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,4}(?![0-9])",
    r"(?<![0-9])[0-9]{7,19}(?![0-9])",
])
CONTEXT = 40
#: Gazetteers and words of context.
DOMAINS = r"(?i)(?:\.|\bdot\b\W*)(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|ch|at|nl|be|us|ca|mx|ar|br|ru|cn|jp|in|au)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
DIALLING = r"^(?:\+|00)?(?:1|7|2[07]|3[0-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|10|127|169|224|255)\D"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel|schreib)\W{0,3}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|login|client|adresse|servidor|serveur)\W{0,3}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)\W{0,3}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|telefon|handy|t[eé]l[eé]fono|t[eé]l[eé]phone|ll[aá]ma)\W{0,3}(?:\w+\W+){0,2}$",
}
AGAINST = r"(?i)(?:token|isbn|version|order|item|sku|hash|key|id|no|page|chapter|http\S*)\W{0,3}$"
LABELERS = ["passes", "form", "gazetteer", "words", "beside"]
FEATURES = ["base", "luhn", "grouped", "long", "cued", "against", "glued", "known"]
EM_ROUNDS, FIT_ROUNDS, SHRINK = 30, 200, 1.0


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    """Whether a match of a kind's base pattern is a base span."""
    digits = digits_of(match)
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda part: F.ltrim(part, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.left(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15)


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between matches (one more than those), and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _found(parts: Column, hits: Column, fit=None) -> Column:
    """(gap, length, match, before, after) of each match, the last three only if it fits; places follow later as running sums."""
    def one(m: Column, i: Column) -> Column:
        said = F.struct(m.alias("match"), F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"))
        return F.struct(F.length(F.get(parts, i)).alias("gap"), F.length(m).alias("length"), (F.when(fit(m), said) if fit else said).alias("said"))

    return F.transform(hits, one)


def _without(kind: str, text: Column) -> Column:
    """The text with one private-use character for each one of the kind's base spans."""
    parts, hits = _pieces(text, BASE[kind])
    blank = F.transform(hits, lambda m: F.when(passes(kind, m), F.repeat(F.lit("\ue000"), F.length(m))).otherwise(m))
    rebuilt = F.array_join(F.zip_with(parts, blank, lambda part, hit: F.concat(part, F.coalesce(hit, F.lit("")))), "")
    return F.when(text.rlike(BASE[kind].replace(r"\G|", "")), rebuilt).otherwise(text)


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, and an array of matches for each kind and for ``wide``): one pass over the texts."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the first look keeps documents without a digit or an at sign out of the passes
    some = F.col("text").rlike(r"[0-9@]|[(\[\x20](?:at|AT)[)\]\x20]")
    rows = rows.withColumn("text", F.when(some, F.col("text")).otherwise(""))
    for kind in KINDS:
        rows = rows.withColumns({f"{kind}_parts": _pieces(F.col("text"), BASE[kind])[0], f"{kind}_hits": _pieces(F.col("text"), BASE[kind])[1]})
        rows = rows.withColumn(kind, _found(F.col(f"{kind}_parts"), F.col(f"{kind}_hits"), lambda m, k=kind: passes(k, m))).drop(f"{kind}_parts", f"{kind}_hits")
    for kind in KINDS:
        rows = rows.withColumn("text", _without(kind, F.col("text")))
    rows = rows.withColumns(dict(zip(("wide_parts", "wide_hits"), _pieces(F.col("text"), WIDE))))
    return rows.select("row", "doc_id", *KINDS, _found(F.col("wide_parts"), F.col("wide_hits")).alias("wide"))


def wide_kind(match: Column) -> Column:
    n = F.length(digits_of(match))
    return (
        F.when(match.rlike(r"(?i)[(\[\x20]at[)\]\x20]"), "email").when(match.rlike(r"\[\.\]|\(\.\)"), "ip")
        .when(n >= 12, "card").otherwise("phone")
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """(row, kind, base, start, stop, match, before, after); a base match that fails its test is dropped."""
    sets = F.array(*[F.struct(F.lit(k).alias("scan"), F.col(k).alias("found")) for k in [*KINDS, "wide"]])
    each = scanned.select("row", F.explode(F.filter(sets, lambda s: F.size(s["found"]) > 0)).alias("s"))
    each = each.select("row", "s.scan", F.posexplode("s.found").alias("nth", "f")).select("row", "scan", "nth", "f.*")
    so_far = Window.partitionBy("row", "scan").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap").cast("long") + F.col("length")).over(so_far)
    placed = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("length"))
    kind = F.when(F.col("scan") == "wide", wide_kind(F.col("said.match"))).otherwise(F.col("scan"))
    return placed.where("said is not null").select("row", kind.alias("kind"), (F.col("scan") != "wide").alias("base"), "start", "stop", "said.*")


def _by_kind(of: dict[str, Column]) -> Column:
    return reduce(lambda out, k: out.when(F.col("kind") == k, of[k]), of, F.when(F.lit(False), list(of.values())[0]))


def with_votes(found: DataFrame) -> DataFrame:
    """Adds ``votes`` (one of -1, 0, 1 for each of LABELERS) and ``x`` (0 or 1 for each of FEATURES)."""
    match, digits = F.col("match"), digits_of(F.col("match"))
    n = F.length(digits)
    check = F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    glued = F.col("before").rlike(r"[A-Za-z0-9_]$") | F.col("after").rlike(r"^[A-Za-z0-9_]")
    cued = _by_kind({k: F.col("before").rlike(CUES[k]) for k in KINDS})
    against = F.col("before").rlike(AGAINST)
    known = _by_kind({
        "email": match.rlike(DOMAINS), "ip": ~match.rlike(RESERVED), "card": digits.rlike(ISSUERS), "phone": F.regexp_replace(match, r"[^0-9+]", "").rlike(DIALLING),
    })
    form = _by_kind({
        "email": ~match.rlike(r"\.\.|^[.-]"), "ip": ~match.rlike(r"(?:^|\D)0[0-9]"), "card": n.isin(14, 15, 16) & check, "phone": n.between(10, 13) & match.rlike(r"[+() .-]"),
    })
    grouped = match.rlike(r"[0-9][^0-9][0-9]")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    never = F.lit(False)
    votes = [vote(F.col("base"), ~F.col("base") & (F.col("kind") != "email")), vote(form, ~form), vote(known, ~known), vote(cued, against), vote(never, glued)]
    features = [F.col("base"), check, grouped, n >= 12, cued, against, glued, known]
    return found.withColumns({"votes": F.array(*votes), "x": F.array(*[F.when(f, 1.0).otherwise(0.0) for f in features])})


def reliabilities(counts: DataFrame, rounds: int = EM_ROUNDS) -> DataFrame:
    """(kind, share, rates): EM over (kind, votes, n).

    rates[labeler][class][vote + 1] is the chance of a vote (no, none, yes) given the class (0: not personal). It begins with
    labelers that are right in 7 of 10 of their votes; SHRINK counts of those beginnings stand beside the data in every round.
    """
    prior = F.array(*[F.array(F.array(F.lit(0.35), F.lit(0.5), F.lit(0.15)), F.array(F.lit(0.15), F.lit(0.5), F.lit(0.35))) for _ in LABELERS])
    listed = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("seen", lambda s: F.struct(s["votes"].alias("votes"), s["n"].alias("n"), _posterior(s["votes"], state).alias("p")))
        total = F.aggregate("seen", F.lit(0.0), lambda t, s: t + s["n"])
        yes = F.aggregate(weighed, F.lit(0.0), lambda t, s: t + s["n"] * s["p"])

        def rate(j: Column, c: int, v: int) -> Column:
            own = F.aggregate(weighed, F.lit(0.0), lambda t, s: t + F.when(F.get(s["votes"], j) == v - 1, s["n"] * (s["p"] if c else 1 - s["p"])).otherwise(0.0))
            return (own + SHRINK * F.get(F.get(F.get(prior, j), F.lit(c)), F.lit(v))) / ((yes if c else total - yes) + SHRINK)

        rates = F.transform(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), lambda j: F.array(*[F.array(*[rate(j, c, v) for v in range(3)]) for c in range(2)]))
        return F.struct(((yes + SHRINK) / (total + 2 * SHRINK)).alias("share"), rates.alias("rates"))

    begin = F.struct(F.lit(0.5).alias("share"), prior.alias("rates"))
    fitted = listed.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step).alias("state"))
    return fitted.select("kind", "state.share", "state.rates")


def _posterior(votes: Column, state: Column) -> Column:
    """The chance that a candidate with these votes is personal."""
    odds = F.log(state["share"] / (1 - state["share"]))
    for j in range(len(LABELERS)):
        rate = [F.get(F.get(F.get(state["rates"], F.lit(j)), F.lit(c)), F.get(votes, F.lit(j)) + 1) for c in range(2)]
        odds = odds + F.log(rate[1] / rate[0])
    return 1 / (1 + F.exp(-odds))


def classifier(patterns: DataFrame, rounds: int = FIT_ROUNDS) -> DataFrame:
    """(kind, weights): logistic regression on (kind, x, n, p), p being the soft label, the intercept first.

    Rounds of gradient ascent with a step below the inverse of the curvature; SHRINK is the ridge.
    """
    width = len(FEATURES) + 1
    listed = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.array(F.lit(1.0)), F.col("x")).alias("x"), F.col("n").cast("double").alias("n"), "p"))).alias("seen"))
    total = F.aggregate("seen", F.lit(0.0), lambda t, s: t + s["n"])
    rate = 4.0 / (width * total + 4 * SHRINK)

    def step(w: Column, _: Column) -> Column:
        def slope(s: Column) -> Column:
            return s["n"] * (s["p"] - 1 / (1 + F.exp(-_dot(w, s["x"]))))

        pulls = F.transform("seen", lambda s: F.struct(s["x"].alias("x"), slope(s).alias("d")))
        return F.array(*[
            F.get(w, F.lit(i)) + rate * (F.aggregate(pulls, F.lit(0.0), lambda t, s: t + s["d"] * F.get(s["x"], F.lit(i))) - SHRINK * F.get(w, F.lit(i)))
            for i in range(width)
        ])

    begin = F.array(*[F.lit(0.0)] * width)
    return listed.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step).alias("weights"))


def _dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """doc_id and spans array<struct<start, rank, kind, stop, base, score>> of every row, in order; rank is the kind's place in KINDS.

    start and stop count code points; score is the regression's. Spans that are not base have a score of at least ``threshold``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "personal-data")
    with settings(spark):
        scanned = scratch.table(scan(df, id_col, text_col), "scanned")
        found = scratch.table(with_votes(candidates(scanned)).drop("match", "before", "after"), "found")
        counts = scratch.table(found.groupBy("kind", "votes", "x").agg(F.count("*").alias("n")), "counts")
        rates = reliabilities(counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
        soft = counts.join(F.broadcast(rates), "kind").withColumn("p", _posterior(F.col("votes"), F.struct("share", "rates")))
        mean = (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p")
        weights = scratch.table(classifier(soft.groupBy("kind", "x").agg(mean, F.sum("n").alias("n"))), "weights")
        score = 1 / (1 + F.exp(-_dot(F.col("weights"), F.concat(F.array(F.lit(1.0)), F.col("x")))))
        scored = found.join(F.broadcast(weights), "kind").withColumn("score", score).where(F.col("base") | (F.col("score") >= threshold))
        rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
        listed = scored.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop", "base", "score"))).alias("spans"))
        joined = scanned.select("row", "doc_id").join(listed.hint("shuffle_hash"), "row", "left")
        spans = F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType))
        out = scratch.table(joined.select("doc_id", spans.alias("spans")), "spans")
        scratch.drop("scanned")
        scratch.drop("found")
    return out


def redact(text: Column, spans: Column) -> Column:
    """The text with each span that begins behind the spans before it replaced by its kind in brackets (quadratic in one text's spans)."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        put = F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] >= s["at"], F.struct(x["stop"].alias("at"), F.array_append(s["out"], put).alias("out"))).otherwise(s)

    return F.aggregate(spans, state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def op12_personal_data(spark, sf_dir):
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base, counts = F.filter("spans", lambda s: s["base"]), [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
