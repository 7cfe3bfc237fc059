"""Toxicity of restored text: a noisy channel is undone by Viterbi decoding under a character language model.

The language model is a character trigram model whose counts cover every text. Suspicious segments (letters mixed with signs
that stand for letters, letters said over and over, single letters set apart) become character lattices; the best path
under channel and language model is the restored word. A logistic model over restored words gives the score.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import held, hinted, least_hashed, release, written

#: Labelled rows of each class that are learned from at most; chi-square from which a trait is weighed; distinct tokens that a worker keeps.
PER_CLASS, CHI_SQUARE, MOST_TOKENS = 4_000, 12.0, 100_000
#: Code points taken at once; length of tokens whose reading a worker keeps; steps of a lattice between two flushes; length that runs are folded to.
SLICE, LONGEST, FLUSH, RUN = 1 << 20, 48, 64, 8

# Signs and the letters that they stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Channel costs in natural log: a sign for a letter, a repeated letter dropped, a mark between letters dropped, a sign dropped.
SIGN, REPEAT, APART, DROP = 1.0, 0.5, 0.5, 3.0

#: Symbols of the model: 0 for what is between words, then the letters, then one for all other letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SYMBOLS = len(LETTERS) + 2
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}

_table: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    if not _table:
        out = np.array([SYMBOLS - 1 if chr(c).isalpha() else 0 for c in range(0x110000)], np.int8)
        for c, i in _NUMBER.items():
            out[ord(c)] = i
        _table.append(out)
    return _table[0]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            t = text.as_py() or ""
            last = np.zeros(2, np.int64)
            for start in range(0, len(t), SLICE):
                s = np.concatenate([last, _symbols()[np.frombuffer(t[start : start + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]])
                counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(counts))
                last = s[-2:]
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log P(symbol | two before it) from the trigrams of all texts, backing off to bigrams and unigrams."""
    rows = docs.select(text_col).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return smoothed(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def smoothed(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    two = (counts.sum(0) + weight * one) / (counts.sum((0, 2))[:, None] + weight)
    return np.log((counts + weight * two) / (counts.sum(2, keepdims=True) + weight)).astype(np.float32)


# a token's decoration: marks before and after it
_EDGES = re.compile(r"^[^\w@$!|+(€£]+|[.,;:!?)\]}'\"]+$|^([^\w])\1+|([^\w])\2+$")
_PLAIN = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(rf"([^\W_])\1{{{RUN},}}")
_APART = re.compile(r"(?<![^\s])[^\W_](?:[ .\-_*][^\W_]){2,}(?![^\s.,;:!?])")


class Restorer:
    """Decodes segments under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.kept = lru_cache(maxsize=20_000)(self._word)

    def word(self, token: str) -> tuple[str, ...]:
        """The restored words of one lower-cased token."""
        return self.kept(token) if len(token) <= LONGEST else self._word(token)

    def _fold(self, m: re.Match) -> str:
        """A run that no best reading keeps more than a few of, cut to RUN: each more costs a REPEAT, less than to keep it."""
        c = m[1]
        s = _NUMBER.get(c, SYMBOLS - 1)
        return c * RUN if (c in STANDS_FOR if not c.isalpha() else self.model[s, s, s] < -REPEAT) else m[0]

    def decode(self, segment: str) -> str:
        """The best reading of a segment of any length: Viterbi over states of the last two symbols.

        What all states' readings begin with is settled and given out, so only the part in doubt is held.
        """
        segment, settled = _RUN.sub(self._fold, segment), []
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for k, c in enumerate(segment):
            options: list[tuple[str, float]] = []
            if c in STANDS_FOR:
                options = [(x, SIGN) for x in STANDS_FOR[c]] + ([("", DROP)] if not c.isdigit() else [])
            elif c.isalpha():
                options = [(c, 0.0)]
            else:
                options = [("", APART), (" ", 0.0)]
            said = k > 0 and segment[k - 1] == c
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, out) in best.items():
                for x, cost in [*options, *([("", REPEAT)] if said and c.isalnum() else [])]:
                    if not x:
                        state, new = (a, b), score - cost
                    else:
                        s = 0 if x == " " else _NUMBER.get(x, SYMBOLS - 1)
                        state, new = (b, s), score - cost + float(self.model[a, b, s])
                    if state not in after or new > after[state][0]:
                        after[state] = (new, out + x)
            best = after
            if k % FLUSH == FLUSH - 1 and (sure := len(commonprefix([out for _, out in best.values()]))):
                settled.append(next(iter(best.values()))[1][:sure])
                best = {state: (score, out[sure:]) for state, (score, out) in best.items()}
        return "".join(settled) + max(((s + float(self.model[a, b, 0]), out) for (a, b), (s, out) in best.items()), default=(0.0, ""))[1]

    def _word(self, token: str) -> tuple[str, ...]:
        while (core := _EDGES.sub("", token)) != token:
            token = core
        if _PLAIN.fullmatch(token) and not _ODD.search(token):
            return (token,)
        letters = sum(map(str.isalpha, token))
        if not letters or (not _ODD.search(token) and not any(c in STANDS_FOR for c in token)):
            return tuple(_PLAIN.findall(token))
        return tuple(self.decode(token).split())

    def apart(self, text: str) -> list[str]:
        """Restored words of the runs of single letters in a lower-cased text."""
        return [w for m in _APART.finditer(text) for w in self.decode(m[0]).split()]

    def restore(self, text: str) -> str:
        """The whole text, lower-cased, with its suspicious segments restored and words set one space apart."""
        text = _APART.sub(lambda m: self.decode(m[0]), text.lower())
        return " ".join(w for t in text.split() for w in self.word(t))


def traits(word: str) -> tuple[str, ...]:
    """What a restored word may be weighed by: itself and its beginnings (marked ^), by which unseen forms are told."""
    return (word, *("^" + word[:n] for n in (4, 5) if len(word) >= n))


class Scorer:
    """Score of restored words: weights of their traits, each counted once a text."""

    def __init__(self, model: np.ndarray, words: dict[str, float], bias: float):
        self.restorer, self.words, self.bias = Restorer(model), words, bias
        self.known: dict[str, tuple[str, ...]] = {}
        self.name = uuid.uuid4().hex

    def found(self, text: str) -> set[str]:
        """The weighed traits of a whole text."""
        out: set[str] = set()
        for start, end in _slices(text):
            part = text[start:end].lower()
            tokens = set(part.split())
            for t in tokens:
                w = self.known.get(t)
                if w is None:
                    w = tuple(x for r in self.restorer.word(t) for x in traits(r) if x in self.words)
                    if len(t) <= LONGEST and len(self.known) < MOST_TOKENS:  # the first ones seen are the frequent ones
                        self.known[t] = w
                out.update(w)
            out.update(x for r in self.restorer.apart(part) for x in traits(r) if x in self.words)
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.words[w] for w in sorted(self.found(text or "")))
        return float(1 / (1 + np.exp(-z)))


def _slices(text: str) -> Iterator[tuple[int, int]]:
    """Cuts of a text at white space that is not inside a run of single letters, of about SLICE code points."""
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        while end < len(text) and not (text[end].isspace() and text[end - 2] not in " .-_*"):
            end += 1
        yield start, end
        start = end


def restored(docs: DataFrame, model: np.ndarray, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs and `restored`, the restored text (null for null)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(shared.value)
        for batch in batches:
            batch["restored"] = [None if t is None else r.restore(t) for t in batch.pop("__text")]
            yield batch

    slim = docs.select(*columns, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInPandas(run, f"{kept}, restored string")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from the labelled rows where `learn` (of docs' columns) holds.

    Of each class the PER_CLASS ids of least hash are learned from. Null labels, labels of unknown ids and repeated labels
    (the larger counts) do no harm; without any label of class 1 every score is the smoothed base rate. Null texts count as
    empty.
    """
    spark = docs.sparkSession
    model = language_model(docs, text_col)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    allowed = docs.where(learn).select(F.col(id_col).alias("id")).distinct()
    usable = written(marked.where("y in (0, 1)").join(allowed, "id", "left_semi").withColumn("h", F.xxhash64("id")), "toxic-labels")
    chosen = written(least_hashed(usable, "y", PER_CLASS).select("id", "y"), "toxic-sample")
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    shared = spark.sparkContext.broadcast(model)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(shared.value)
        for batch in batches:
            batch["words"] = [sorted({x for w in r.restore(t).split() for x in traits(w)}) for t in batch.pop("text")]
            yield batch

    sample = written(rows.select("id", "y", "text").mapInPandas(words, "id long, y int, words array<string>"), "toxic-words")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = size.get(1, 0), size.get(0, 0)
    if not ones or not zeros:
        rate = (ones + 0.5) / (ones + zeros + 1)
        return Scorer(model, {}, float(np.log(rate / (1 - rate))))
    # traits that tell class 1 by more than chance
    a, b, n = F.col("a"), F.col("n") - F.col("a"), F.col("n")
    counted = sample.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("n")).where((n >= 3) & (a / ones > b / zeros))
    chi = F.pow(a / ones - b / zeros, 2) * ones * zeros / (n * (1 - n / (ones + zeros + 1)))
    listed = written(counted.where(chi >= CHI_SQUARE).select("w"), "toxic-traits")
    names = sorted(r["w"] for r in listed.collect())  # of a bounded sample
    found = sample.select("id", "y", F.explode_outer("words").alias("w")).join(hinted(listed.withColumn("told", F.lit(True)), len(names)), "w", "left")
    rows = found.groupBy("id", "y").agg(F.collect_list(F.when(F.col("told"), F.col("w"))).alias("told")).toPandas().sort_values("id")
    number = {w: i for i, w in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows["told"]])
    at = np.array([number[w] for x in rows["told"] for w in sorted(x)], np.int64)
    w = logistic(row, at, len(names), rows["y"].to_numpy(np.float64))
    return Scorer(model, {n: float(v) for n, v in zip(names, w, strict=False) if v}, float(w[-1]))


def logistic(row: np.ndarray, at: np.ndarray, traits: int, y: np.ndarray, l1: float = 1e-4, l2: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights of least elastic-net log loss by accelerated proximal gradient; the last is the unpenalised bias.

    Row row[i] holds trait at[i]. No weight is negative: a word can tell that a text is toxic, none that it isn't, so long
    texts can't hide it.
    """
    n = len(y)
    ahead = lambda v: np.bincount(row, v[at], n) + v[-1]
    back = lambda g: np.append(np.bincount(at, g[row], traits), g.sum())
    v = np.ones(traits + 1)
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(ahead(v))
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(np.linalg.norm(back(ahead(v)))) / n + l2)
    w = u = np.zeros(traits + 1)
    t = 1.0
    for _ in range(rounds):
        g = back(1 / (1 + np.exp(-ahead(u))) - y) / n
        g[:-1] += l2 * u[:-1]
        new = u - step * g
        new[:-1] = np.maximum(new[:-1] - step * l1, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        u, w = new + (last - 1) / t * (new - w), new
    return w


def score(docs: DataFrame, scorer: Scorer, columns: list[Column], text_col: str = "text") -> DataFrame:
    """columns of docs with score (0 to 1) and predicted (1 from 0.5 on), from the text alone.

    Null and empty texts get the score of no words; repeated rows stay; extra columns and their names don't matter.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast((scorer.restorer.model, scorer.words, scorer.bias)), scorer.name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held(("toxicity", name), lambda: Scorer(*shared.value))
        for batch in batches:
            batch["score"] = [s.score(t) for t in batch.pop("__text")]
            batch["predicted"] = (batch["score"] >= 0.5).astype("int32")
            yield batch

    slim = docs.select(*columns, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInPandas(run, f"{kept}, score double, predicted int")


def reject(docs: DataFrame, scorer: Scorer, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs that score below `least`, judged in the pass that hands on the whole row.

    All columns stay, whatever their names; null and empty texts have the score of no words; repeated rows stay; an empty
    table gives an empty result.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast((scorer.restorer.model, scorer.words, scorer.bias)), scorer.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held(("toxicity", name), lambda: Scorer(*shared.value))
        for batch in batches:
            yield batch.filter(pa.array([s.score(t.as_py()) < least for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
