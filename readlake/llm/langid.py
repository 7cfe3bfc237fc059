"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with an elastic net, then calibrated by a temperature. Document frequencies count
every learnable row; only the regression itself sees a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import least_hashed, release, written

#: Feature buckets, n-gram lengths, code points of a text taken at once.
FEATURES, ORDERS, SLICE = 1 << 16, (1, 2, 3), 1 << 20
#: Labelled rows of each language that are learned from at most, and the share of them kept for calibration.
PER_LANGUAGE, CALIBRATION = 600, 0.2
#: Languages at most.
MOST_LANGUAGES = 256
#: Rates of learning; L1 leaves about one in ten of the weights of features that occur.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.1, 1e-4, 3

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point itself if it is a letter, else a space."""
    if "letters" not in _tables:
        _tables["letters"] = np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)
    return _tables["letters"]


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all character n-grams of the whole lower-cased text, slice by slice; runs of non-letters are one space."""
    held = np.array([32], np.uint32)
    reach = max(ORDERS) - 1
    for start in range(0, len(text), SLICE):
        points = np.frombuffer(text[start : start + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([held, _letters()[points]])
        new = len(held)
        blank = points == 32
        keep = np.ones(len(points), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[:new] = True
        points = points[keep].astype(np.uint64)
        hashes = np.zeros(len(points), np.uint64)
        out = []
        for n in range(1, reach + 2):  # hashes[i]: of the n points that end at i
            hashes = (np.concatenate(([np.uint64(0)], hashes[:-1])) * np.uint64(0x9E3779B97F4A7C15) + points + np.uint64(n)) if n > 1 else points * np.uint64(0xBF58476D1CE4E5B9)
            if n in ORDERS:
                mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 16)
                out.append(mixed[max(new, n - 1) :])
        yield (np.concatenate(out) % np.uint64(FEATURES)).astype(np.int64)
        held = points[-reach:].astype(np.uint32)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the task that hold each feature, and their number as feature -1."""
    release()
    counts, docs, seen = np.zeros(FEATURES, np.int64), 0, np.zeros(FEATURES, bool)
    for batch in batches:
        for text in batch.column(0):
            docs += 1
            if (t := text.as_py()) and _has_letter(t):
                for g in grams(t):
                    seen[g] = True
                at = np.flatnonzero(seen)
                counts[at] += 1
                seen[at] = False
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs))], ["feature", "n"])


def idf_of(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed inverse document frequencies over all rows."""
    rows = texts.select(text_col).mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    at, n = rows["feature"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    docs, counts = int(n[at == -1].sum()), np.zeros(FEATURES)
    counts[at[at >= 0]] = n[at >= 0]
    return np.log((1 + docs) / (1 + counts)) + 1


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their term frequencies."""
    counts = np.zeros(FEATURES, np.int64)
    for g in grams(text):
        counts += np.bincount(g, minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x labels, most of them 0
    bias: np.ndarray
    temperature: float = 1.0
    scaled: np.ndarray = field(init=False)

    def __post_init__(self):
        self.scaled = np.ascontiguousarray(self.weights * self.idf[:, None])

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for g in grams(text):
            total += np.bincount(g, minlength=FEATURES) @ self.scaled if len(g) > FEATURES else self.scaled[g].sum(axis=0)
            n += len(g)
        return total / max(1, n) * SCALE + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.labels[k], float(p[k])


#: Factor on the mean TF-IDF weight, so that rates of learning fit.
SCALE = 20.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate follow-the-regularised-leader with L1 and L2 penalties; rows: (features, values, label)."""
    z, n = np.zeros((FEATURES + 1, labels)), np.zeros((FEATURES + 1, labels))
    order = np.random.default_rng(seed)

    def leader(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)  # the last coordinate is the bias
            w = leader(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


#: Temperatures that are searched.
COLDEST, HOTTEST = 1e-3, 1e3


def smoothed_loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    """Mean log loss at a temperature, where every label is right but for one row in n + 2.

    So the loss is least at a temperature above 0 even if all held-out rows are told right.
    """
    z = logits / temperature
    z = z - z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    doubt = 1 / (len(y) + 2)
    return float(-((1 - doubt) * logp[np.arange(len(y)), y] + doubt * logp.mean(axis=1)).mean())


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least smoothed log loss on held-out rows, by golden-section search over its logarithm."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    loss = lambda t: smoothed_loss(logits, y, float(np.exp(t)))
    a, b, r = np.log(COLDEST), np.log(HOTTEST), (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [_vector(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in vectors], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in vectors], pa.binary())], ["lang", "at", "tf"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the rows where `learn` holds, the language is not null and the text has a letter; None if there are none.

    Of each language the PER_LANGUAGE rows of least id and text hash are learned from; more than MOST_LANGUAGES languages
    are an error.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    idf = idf_of(rows, "text")
    # thin rows are ranked, then their texts are fetched: at most PER_LANGUAGE of each language
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    thin = written(lettered.select("lang", F.xxhash64("id", "text").alias("h")).distinct(), "language-rows")
    found = thin.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    chosen = written(least_hashed(thin, "lang", PER_LANGUAGE), "language-sample")
    sample = lettered.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang")
    got = sample.mapInArrow(_features, "lang string, at binary, tf binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "at", "tf"]).reset_index(drop=True)
    labels = sorted(got["lang"].unique())
    y = got["lang"].map({x: i for i, x in enumerate(labels)}).to_numpy()
    vectors = []
    for a, t in zip(got["at"], got["tf"], strict=True):
        at = np.frombuffer(a, "<i4").astype(np.int64)
        vectors.append((at, np.frombuffer(t, "<f4").astype(np.float64) * idf[at] * SCALE))
    held = np.random.default_rng(1).random(len(y)) < CALIBRATION
    for k in range(len(labels)):  # every language is learned
        if held[y == k].all():
            held[np.flatnonzero(y == k)[0]] = False
    weights, bias = train_ftrl([(*vectors[i], int(y[i])) for i in np.flatnonzero(~held)], len(labels))
    logits = np.array([v @ weights[a] + bias for a, v in (vectors[i] for i in np.flatnonzero(held))]).reshape(-1, len(labels))
    return Model(list(labels), idf, weights, bias, temperature_of(logits, y[held]))


def predict(docs: DataFrame, model: Model | None, columns: list[Column], text_col: str = "text") -> DataFrame:
    """columns of docs with lang_pred and score, from the text alone.

    Null texts, texts without a letter, and all texts if there is no model are `und` with score 0. Repeated rows stay;
    extra columns and their names don't matter. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        m = shared.value
        for batch in batches:
            found = [m.predict(t) if m is not None and t and _has_letter(t) else ("und", 0.0) for t in batch["__text"]]
            batch = batch.drop(columns="__text")
            batch["lang_pred"], batch["score"] = [x for x, _ in found], [float(s) for _, s in found]
            yield batch

    slim = docs.select(*columns, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInPandas(run, f"{kept}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose language is identified with a score of at least `least`, judged in the pass that hands on the whole row.

    All columns stay, whatever their names; null texts, texts without a letter, and all texts if there is no model, go;
    repeated rows stay; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identified(m: Model | None, text: str | None) -> bool:
        label, score = m.predict(text) if m is not None and text and _has_letter(text) else ("und", 0.0)
        return label != "und" and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([identified(m, t.as_py()) for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
