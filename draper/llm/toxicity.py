"""Toxicity by maximum-scoring segment search.

Token scores are log-odds of toxic against other documents under an informative
Dirichlet prior (the pooled document counts plus a constant), less a drift of ``COST``
that keeps the mean score of a clean text below zero; tokens are words, and a word that is
not in the model falls back on its first ``STEMS`` letters, longest first. A token the
counts tell nothing about (below ``LEAST_Z`` standard errors either way) has log-odds zero.
One linear scan of a document finds all maximal-scoring segments (Ruzzo and Tompa); only
tokens above zero can begin one, so the scan steps over those. Segment scores are
calibrated by the extreme-value law of local scores, both constants fitted on the clean
calibration documents: lambda solves sum p(s) exp(lambda s) = 1 over the scores of their
tokens, K is the likeliest for their best segments, N / sum n exp(-lambda S), and
``lambda S - ln(1 + K n)`` is a segment's normalised score. A logistic layer over the best
one, the sum and the number of significant segments gives the document's score.

Counts come from at most ``MAX_LABELLED`` labelled documents of either class that are
not held out (chosen by a hash of their ids), a quarter of which calibrate instead; the
model keeps at most ``MAX_TOKENS`` tokens, those with most standard errors.

Defined cases: null and empty texts get the score of a text without any segment; a
document labelled more than once counts as toxic if any label says so; null labels and
ids don't train; without both classes every score is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch, arrow_strings, held_out, settings

MAX_LABELLED = 10_000
MAX_TOKENS = 20_000
STEMS = (5, 4)
COST = 0.35
LEAST_Z = 3.2
MOST_ODDS = 8.0
BINS = 64  # token scores are counted in steps of 1 / BINS for lambda
PRIOR = 100.0
FLAT_PRIOR = 0.5
WORDS = re.compile(r"[^\W\d_]+")
OUT = "doc_id long, held_out boolean, score double, predicted int, n_segments int, best double"


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a run of scores as (first, last, score), in linear time.

    Kept candidates are (first, last, total before, total through), linked to the nearest
    earlier one whose total before is lower. Only places above zero are visited.
    """
    found: list[tuple[int, int, float, float, int]] = []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    for place, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first = place
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((first, place, left, right, j))
                break
            first, left = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in found]


def token_scores(text: str, odds: dict[str, float]) -> np.ndarray:
    """The score of every token: its log-odds (0 where the model has none) less the drift."""
    get = odds.get
    long, short = STEMS
    tokens = WORDS.findall(text.lower())
    each = (get(t) or get("^" + t[:long]) or get("^" + t[:short], 0.0) for t in tokens)
    return np.fromiter(each, np.float64, len(tokens)) - COST


def normalised(best: np.ndarray, n: int, model: dict) -> tuple[float, float, float, int]:
    """Best and summed normalised scores of segments in n tokens, log count of significant ones, and that count."""
    each = model["lambda"] * best - np.log1p(model["k"] * n)
    significant = each[each > 0]
    return max(0.0, float(each.max(initial=0.0))), float(significant.sum()), float(np.log1p(len(significant))), len(significant)


def features(text: str, model: dict) -> tuple[float, float, float, int]:
    scores = token_scores(text, model["scores"])
    return normalised(np.array([v for *_, v in maximal_segments(scores)]), len(scores), model)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (p - y)) + penalty * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def squash(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, :2] = np.log1p(x[:, :2])
    return x


def solve_lambda(values: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (the mean score is below zero)."""
    low, high = 0.0, 1.0
    f = lambda t: float((p * np.exp(np.clip(t * values, -50, 50))).sum()) - 1
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def count_tokens(batches):
    """(id, text, toxic) -> (token, toxic documents, other documents)."""
    for b in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(arrow_strings(b.column(1)), b.column(2).to_pylist()):
            c = counts[toxic]
            words = set(WORDS.findall(text.lower()))
            c.update(words)
            c.update({"^" + t[:n] for t in words for n in STEMS if len(t) > n})
        tokens = sorted(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.string()), pa.array([counts[1][t] for t in tokens], pa.int64()), pa.array([counts[0][t] for t in tokens], pa.int64())],
            ["token", "toxic", "other"],
        )


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model: token scores, lambda, k, logistic coefficients, share of toxic labels."""
    spark = df.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    known = scratch.table(known, "known")
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    model = {"scores": {}, "lambda": 1.0, "k": 0.1, "w": None, "share": share}
    if not total.get(0) or not total.get(1):
        return model
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(MAX_LABELLED).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(MAX_LABELLED)
    )
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # of rows that share an id one counts, so the sample is bounded in rows; repeats are put together before the shuffle
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = scratch.table(one.select("doc_id", "text", "toxic"), "sample")
    sample = sample.repartition(F.col("doc_id"))
    calibrate = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    counts = scratch.table(
        sample.where(~calibrate).mapInArrow(count_tokens, "token string, toxic long, other long")
        .groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")), "counts",
    )
    word = ~F.col("token").startswith("^")
    n1, n0 = counts.where(word).agg(F.sum("a"), F.sum("b")).first()
    if not n1 or not n0:
        return model
    prior = PRIOR * (F.col("a") + F.col("b")) / float(n1 + n0) + FLAT_PRIOR
    odds = F.log((F.col("a") + prior) / (n1 + PRIOR - F.col("a") - prior)) - F.log((F.col("b") + prior) / (n0 + PRIOR - F.col("b") - prior))
    z = odds / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
    kept = counts.select("token", odds.alias("score"), z.alias("z")).where(F.abs("z") >= LEAST_Z)
    kept = kept.orderBy(F.desc(F.abs("z")), "token").limit(MAX_TOKENS).toPandas()
    scores = model["scores"] = dict(zip(kept["token"], np.clip(kept["score"], -MOST_ODDS, MOST_ODDS)))

    def histogram(batches):
        for b in batches:
            values = [np.round(token_scores(t, scores) * BINS).astype(np.int64) for t in arrow_strings(b.column(1))]
            bins, n = np.unique(np.concatenate([np.zeros(0, np.int64), *values]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], ["bin", "n"])

    held = sample.where(calibrate)
    clean = held.where("toxic = 0").mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    if len(clean) and clean["bin"].max() > 0:
        values, share_of = clean["bin"].to_numpy() / BINS, (clean["n"] / clean["n"].sum()).to_numpy()
        model["lambda"] = solve_lambda(values, share_of) if (values * share_of).sum() < 0 else model["lambda"]

    def measure(batches):
        for b in batches:
            rows = [token_scores(t, scores) for t in arrow_strings(b.column(1))]
            best = [[v for *_, v in maximal_segments(r)] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array([len(r) for r in rows], pa.int64()), pa.array(best, pa.list_(pa.float64()))], ["toxic", "n", "best"]
            )

    got = held.mapInArrow(measure, "toxic int, n long, best array<double>").toPandas()
    top = got["best"].map(lambda v: max(v, default=0.0))
    other = (got["toxic"] == 0) & (got["n"] > 0)
    if other.any():
        model["k"] = float(other.sum() / (got["n"] * np.exp(-model["lambda"] * top))[other].sum())
    x = np.array([normalised(np.array(v, float), n, model)[:3] for v, n in zip(got["best"], got["n"])]).reshape(-1, 3)
    seen = got["toxic"].value_counts().to_dict()
    if len(seen) == 2:
        weight = got["toxic"].map({k: total[k] / sum(total.values()) / v for k, v in seen.items()}).to_numpy() * len(got)
        model["w"] = logistic(squash(x), got["toxic"].to_numpy(), weight)
    scratch.drop("sample")
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments, best for every row of df."""
    spark = df.sparkSession
    with settings(spark):
        scratch = Scratch(spark, "toxicity-scores")
        model = spark.sparkContext.broadcast(learn(df, labels, id_col, text_col, label_col))

        def score(batches):
            m = model.value
            for b in batches:
                rows = [features(t, m) for t in arrow_strings(b.column(2))]
                x = squash(np.array([r[:3] for r in rows]).reshape(-1, 3))
                p = np.full(len(rows), m["share"]) if m["w"] is None else 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ m["w"], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                     pa.array([r[3] for r in rows], pa.int32()), pa.array([r[0] for r in rows])],
                    ["doc_id", "held_out", "score", "predicted", "n_segments", "best"],
                )

        rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return scratch.table(rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, OUT), "scores")


def op6_toxicity(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_toxicity(read("documents"), read("labels"))
