"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes (plus the overlap that the widest filter needs) pass
through filters of several widths over one-hot bytes, which are sums of table rows;
then ReLU, max pooling over the window and a softmax layer. The network is trained in
numpy on windows of at most ``MAX_DOCUMENTS`` labelled documents (distinct rows, chosen by
a hash of id and text, every language as often as it can be; at most ``WINDOWS_EACH``
windows from each, dealt over its whole text). A
document's score is the softmax of its windows' mean logits, weighted by their bytes;
every window of the whole text counts.

Defined cases: null text or text without a letter is ``und`` with score 0; without any
labelled row every text is ``und``; null ids are kept and never train; repeated rows
get equal results; columns of other names are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch, held_out, settings, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
MAX_DOCUMENTS = 4000
WINDOWS_EACH = 4
EPOCHS = 4
SEED = 7
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def cut_windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and document numbers of the windows that cover every text."""
    sizes = np.diff(offsets)
    per = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    starts = offsets[:-1][doc] + nth * window
    return starts, np.minimum(offsets[1:][doc] - starts, window + max(WIDTHS) - 1), doc


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes, zero where the text has ended."""
    span = np.arange(WINDOW + max(WIDTHS) - 1)
    place = np.minimum(starts[:, None] + span, len(data) - 1)
    return np.where(span < lengths[:, None], data[place], 0).astype(np.uint8)


class ByteConvNet:
    """Filter tables (one row for each byte and offset), biases, and the softmax layer."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {f"t{w}_{j}": rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for w in WIDTHS for j in range(w)}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["bias"] = np.zeros(len(classes), np.float32)

    @classmethod
    def of(cls, classes: list[str], p: dict[str, np.ndarray]) -> ByteConvNet:
        net = cls(classes)
        net.p = p
        return net

    def pooled(self, x: np.ndarray, places: dict | None = None) -> np.ndarray:
        found = []
        for w in WIDTHS:
            s = self.p[f"t{w}_0"].take(x[:, :WINDOW], axis=0)
            for j in range(1, w):
                s += self.p[f"t{w}_{j}"].take(x[:, j : j + WINDOW], axis=0)
            if places is not None:
                places[w] = s.argmax(1)
            found.append(s.max(1) + self.p[f"b{w}"])
        return np.concatenate(found, 1)

    def logits(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = [np.maximum(self.pooled(x[i : i + block]), 0) @ self.p["out"] + self.p["bias"] for i in range(0, len(x), block)]
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128) -> None:
        """Adam on cross entropy; classes weigh alike."""
        rng = np.random.default_rng(SEED)
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.classes)), 1))[y]
        weight = (weight / weight.mean()).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                xb, places = x[at], {}
                z = self.pooled(xb, places)
                h = np.maximum(z, 0)
                q = h @ self.p["out"] + self.p["bias"]
                q = np.exp(q - q.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(at)), y[at]] -= 1
                q *= weight[at][:, None] / len(at)
                g = {"out": h.T @ q, "bias": q.sum(0)}
                back = (q @ self.p["out"].T) * (z > 0)
                rows = np.arange(len(at))[:, None]
                for n, w in enumerate(WIDTHS):
                    d = back[:, n * FILTERS : (n + 1) * FILTERS]
                    g[f"b{w}"] = d.sum(0)
                    for j in range(w):
                        t = np.zeros((256, FILTERS), np.float32)
                        np.add.at(t, (xb[rows, places[w] + j], np.arange(FILTERS)[None, :]), d)
                        g[f"t{w}_{j}"] = t
                step += 1
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Documents for each language, at most ``most`` in all: equal shares, and what small languages leave goes to larger ones."""
    out, left = {}, most
    for n, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(size, -(-left // (len(sizes) - n)))
        left -= out[lang]
    return out


def training_rows(labelled: DataFrame, most: int) -> list[int]:
    """Keys (hash of id, text and language) of the rows to train on; at most about twice ``most`` come to the driver."""
    keys = labelled.select("_key", "lang").distinct()
    found = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    sizes = {r["lang"]: r["n"] for r in found}
    want = shares(sizes, most)
    # the least keys of each language are below this share of the hash range, but for very few cases
    bounds = [(lang, int(-(2**63) + 2**64 * min(1.0, (n + 6 * n**0.5 + 8) / sizes[lang])) - 1) for lang, n in want.items()]
    limit = labelled.sparkSession.createDataFrame([(lang, min(b, 2**63 - 1)) for lang, b in bounds], "lang string, bound long")
    low = keys.join(F.broadcast(limit), "lang").where(F.col("_key") <= F.col("bound")).collect()
    taken: dict[str, int] = {}
    out = []
    for key, lang in sorted((r["_key"], r["lang"]) for r in low):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= want[lang]:
            out.append(key)
    return out


def training_windows(df: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = MAX_DOCUMENTS):
    """(language, windows) of at most ``most`` labelled documents that are not held out."""
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    labelled = labelled.withColumn("_key", F.xxhash64("doc_id", "text", "lang"))
    chosen = df.sparkSession.createDataFrame([(k,) for k in training_rows(labelled, most)], "_key long")

    def cut(batches):
        for b in batches:
            data, offsets = utf8(b.column(0))
            langs = b.column(1).to_pylist()
            starts, lengths, doc = cut_windows(data, offsets)
            size = np.bincount(doc, minlength=len(langs))
            nth = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            pick = nth * WINDOWS_EACH // np.maximum(size[doc], 1) != (nth - 1) * WINDOWS_EACH // np.maximum(size[doc], 1)
            if pick.any():
                rows = gather(data, starts[pick], lengths[pick])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[i] for i in doc[pick]]), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "window"]
                )

    # a row that is repeated very often is one by the time it leaves its task
    picked = labelled.join(F.broadcast(chosen), "_key", "left_semi").dropDuplicates(["_key"]).select("text", "lang")
    got = picked.mapInArrow(cut, "lang string, window binary").toPandas().sort_values(["lang", "window"], kind="stable")
    return got["lang"].tolist(), np.array([np.frombuffer(w, np.uint8) for w in got["window"]])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    langs, x = training_windows(df, id_col, text_col, lang_col)
    if not langs:
        return None
    classes = sorted(set(langs))
    net = ByteConvNet(classes)
    net.fit(x, np.array([classes.index(v) for v in langs]))
    return net


def with_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for every text that has a letter."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    out = np.zeros(len(offsets) - 1, bool)
    for k in range(len(out)):
        text = data[offsets[k] : offsets[k + 1]]
        out[k] = letter[text].any() or any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return out


def predict(data: np.ndarray, offsets: np.ndarray, net: ByteConvNet | None) -> tuple[np.ndarray, np.ndarray]:
    """Class number (-1: no windows or no letter) and score of every text."""
    n = len(offsets) - 1
    label, score = np.full(n, -1), np.zeros(n)
    if net is None or not n or offsets[-1] == offsets[0]:
        return label, score
    starts, lengths, doc = cut_windows(data, offsets)
    total = np.zeros((n, len(net.classes)))
    for i in range(0, len(starts), 4096):
        part = slice(i, i + 4096)
        np.add.at(total, doc[part], net.logits(gather(data, starts[part], lengths[part])) * lengths[part][:, None])
    count = np.zeros(n)
    np.add.at(count, doc, lengths)
    total /= np.maximum(count, 1)[:, None]
    q = np.exp(total - total.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    has = with_letters(data, offsets)
    label[has], score[has] = q[has].argmax(1), q[has].max(1)
    return label, score


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       net: ByteConvNet | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; trains on df's labels unless a net is given."""
    spark = df.sparkSession
    net = net or train(df, id_col, text_col, lang_col)
    model = spark.sparkContext.broadcast((net.classes, net.p) if net else None)

    def score(batches):
        net = ByteConvNet.of(*model.value) if model.value else None
        names = np.array((net.classes if net else []) + ["und"], dtype=object)
        for b in batches:
            label, best = predict(*utf8(b.column(2)), net)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names[label], pa.string()), pa.array(best)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    with settings(spark):
        scratch = Scratch(spark, "language-id")
        rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = rows.select("doc_id", held_out().alias("held_out"), "text")
        return scratch.table(rows.mapInArrow(score, OUT), "scores")


def op1_language_id(spark, sf_dir):
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df, all columns, whose text has a letter (is not ``und`` to a trained network)."""
    net = train(df, id_col, text_col, lang_col)
    model = df.sparkSession.sparkContext.broadcast((net.classes, net.p) if net else None)
    at = df.columns.index(text_col)

    def keep(batches):
        net = ByteConvNet.of(*model.value) if model.value else None
        for b in batches:
            text = utf8(b.column(at))
            yield b.filter(pa.array(predict(*text, net)[0] >= 0 if net else with_letters(*text)))

    return df.mapInArrow(keep, df.schema)
