"""A probabilistic suffix tree of words: learned by counting, kept where the next word's distribution diverges, used for scoring.

A context is the last 1 to DEPTH words. It lists the words that follow it at least LEAST times, discounted; what is left over
goes to the context one word shorter, at the end to the words' own frequencies, so every distribution sums to one. A context
is retained if its own distribution tells more about the words after it than the shorter one's (a divergence in bits).
A token is scored in the longest retained contexts that the words before it end with.

The tree grows with the corpus, so no machine holds it: it is cut into parts by the last word of the context. Every token is
dealt, with the words before it, to the part of its contexts; a part counts, tests and scores, and what it found goes back to
the documents. Tokens travel in packed blobs of a chunk of documents and a part. A last word that is too frequent for a part
is spread over several by the words before it; the counts of its short contexts, which these parts share, are summed first.
The most frequent words have numbers and their counts are broadcast; a part is told the counts of the others that it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import held, hinted, release, scratch_path, slices, split, written

#: Words of a context at most, times that a listed word follows its context at least, discount of its count.
DEPTH, LEAST, DISCOUNT = 3, 2, 0.75
#: Bits that a context must save on the tokens after it, for each word that it lists.
GAIN = 2.0
#: Most frequent words that are numbered; all others are known by their hash, and their counts come by a join.
HEAD = 1 << 19
#: Tokens that a task packs at once, and tokens of a part. A chunk must number its words in BITS bits.
CHUNK, PART_TOKENS, BITS = 500_000, 1_000_000, 21
#: Words that a task counts at once.
COUNTED = 2_500_000
#: Number of the end of a text; among the words before a token it means none.
END = 0


@dataclass
class Head:
    """Counts of the corpus, and the numbered words (0 is the end)."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    spread: dict[int, int]  # parts of each word that is too frequent for one
    parts: int
    name: str
    tail: int  # words without a number that a context could list

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    @property
    def unnumbered(self) -> int:
        """The count that words without a number have at most."""
        return int(self.counts[1:].min()) if len(self.counts) > 1 else self.total


# ---- counts of words -------------------------------------------------------------------------------------------------
def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; the end has the empty word."""
    release()
    held_words: list[pa.Array] = []
    ends, size = 0, 0
    for batch in batches:
        texts = batch.column(0)
        ends += len(texts)
        for start, stop in slices(texts):
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(start, stop - start))).flatten()
            held_words.append(words)
            size += len(words)
            if size > COUNTED:
                yield _counted(held_words)
                held_words, size = [], 0
    if held_words:
        yield _counted(held_words)
    yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])


def _counted(words: list[pa.Array]) -> pa.RecordBatch:
    found = pa.chunked_array(words).value_counts()
    word, n = found.field("values"), found.field("counts")
    real = pc.not_equal(word, pa.scalar("", word.type))  # one stands where white space begins or ends a text
    return pa.RecordBatch.from_arrays([word.filter(real).cast(pa.binary()), n.filter(real).cast(pa.int64())], ["word", "n"])


def unigrams(texts: DataFrame) -> DataFrame:
    """The written table (word, n) of all texts; the end of a text has the empty word."""
    return written(texts.mapInArrow(_unigrams, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")


def head_of(counted: DataFrame, tokens: int, head: int = HEAD, part_tokens: int = PART_TOKENS) -> Head:
    """The numbered words of a table of counts: all over the count that at most head - 1 words exceed. tokens: of all texts."""
    spark = counted.sparkSession
    total, distinct, often = (x or 0 for x in counted.agg(F.sum("n"), F.count("*"), F.count(F.when((F.col("n") >= LEAST) & (F.col("word") != F.lit(b"")), 1))).first())
    ends = (counted.where(F.col("word") == F.lit(b"")).agg(F.sum("n")).first()[0]) or 0
    plain = counted.where(F.col("word") != F.lit(b""))
    floor, so_far = total + 1, 0
    for row in plain.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(head).toLocalIterator():
        if so_far + row["k"] >= head:
            break
        so_far, floor = so_far + row["k"], row["n"]
    top = plain.where(F.col("n") >= floor).orderBy(F.desc("n"), "word").limit(head - 1).toArrow()
    words = [b"", *(bytes(w) for w in top.column("word").to_pylist())]
    counts = np.concatenate([[ends], top.column("n").to_numpy()]).astype(np.int64)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = tasks * max(1, -(-tokens // (tasks * part_tokens)))
    # a word over twice a task's share, or a part's, is spread
    share = min(2 * total / tasks, 2 * part_tokens * total / max(1, tokens))
    wide = 1 + np.flatnonzero(counts[1:] > share)
    spread = {int(i): min(parts, int(np.ceil(counts[i] / (share / 4)))) for i in wide}
    tail = int(often) - int(np.count_nonzero(counts[1:] >= LEAST))
    return Head(words, counts, int(total), int(distinct), spread, parts, scratch_path(spark, "head"), tail)


def tail_counts(counted: DataFrame, head: Head) -> DataFrame:
    """(word, n) by identity of all words without a number; a few of the numbered may be among them."""
    return counted.where(F.col("n") <= head.unnumbered).select(signed(F.xxhash64("word")).alias("word"), "n")


# ---- tokens ----------------------------------------------------------------------------------------------------------
def hash_of(word: bytes) -> int:
    """A word's identity where it has no number: its XXH64 as Spark's xxhash64 gives it."""
    return xxhash.xxh64_intdigest(word, 42)


class Numbers:
    """Identities of words: a number, or the hash with its highest bit set, which makes it negative."""

    def __init__(self, head: Head):
        self.number = {w: i for i, w in enumerate(head.words)}
        self.spread = np.ones(len(head.counts), np.int32)
        self.spread[list(head.spread)] = list(head.spread.values())

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(identities of the words and the end of each text, where each text begins and the last one ends) of stretches of texts."""
        for start, stop in slices(texts):
            words, place, cuts = split(pc.ascii_lower(texts.slice(start, stop - start)))
            found = list(map(self.number.get, words))
            if None in found:
                found = [-(hash_of(x) >> 1) - 1 if i is None else i for x, i in zip(words, found, strict=True)]
            t = np.insert(np.array(found, np.int64)[place], cuts[1:], END)
            yield t, cuts + np.arange(len(cuts))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The identities of each text."""
        for t, cuts in self.of(texts):
            yield from np.split(t, cuts[1:-1])


def signed(h: Column) -> Column:
    """The identity of an unnumbered word from its 64-bit hash."""
    return -F.shiftrightunsigned(h, 1) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _parts(w: np.ndarray, c: list[np.ndarray], spread: np.ndarray, parts: int) -> np.ndarray:
    """The part of each token w: that of the word before it, or one of those that share a frequent word."""
    first = np.where(c[0] == END, w, c[0])
    wide = lambda x: np.where(x > 0, spread[np.maximum(x, 0)], 1)
    many = wide(c[0])
    often = np.flatnonzero(many > 1)
    step = np.zeros(len(w), np.uint64)
    if len(often):
        x, y = c[1][often], c[2][often]
        step[often] = _mixed(x ^ np.where(wide(x) > 1, _mixed(y).view(np.int64) << 20, 0)) % many[often].astype(np.uint64)
    return ((_mixed(first) + step) % np.uint64(parts)).astype(np.int64)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, a plane for each byte of a number."""
    return b"".join([(x >> shift).astype(np.uint8).tobytes() for x in (c.astype(np.int32) for c in columns) for shift in (0, 8, 16, 24)])


def _expand(raw: memoryview, n: int, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(raw, np.uint8, 4 * n * columns).reshape(columns, 4, n)
    out = []
    for planes in flat:
        x = planes[3].astype(np.int32)
        for plane in planes[2::-1]:
            x <<= 8
            x |= plane
        out.append(x)
    return out


def _blob(rows: list[np.ndarray], base: int, press: zstandard.ZstdCompressor) -> bytes:
    """Sorted rows (c1, c2, c3, w, doc, k): numbers below base are the words' own, others are places in a list of identities."""
    *ids, doc, k, names = rows
    flat = np.concatenate(ids)
    odd = np.flatnonzero(flat >= base)
    used, place = np.unique(flat[odd], return_inverse=True)
    flat[odd] = base + place
    n = len(doc)
    c = np.split(flat, 4)
    head = np.array([n, len(used)], "<i8").tobytes() + names[used - base].astype("<i8").tobytes()
    return press.compress(head + _squeeze(np.diff(c[0], prepend=0), *c[1:], doc, k))


def _unblob(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n, m = np.frombuffer(raw[:16], "<i8").tolist()
    columns = _expand(raw[16 + 8 * m :], n, 6)
    columns[0] = np.cumsum(columns[0], dtype=np.int32)
    return columns, np.frombuffer(raw[16 : 16 + 8 * m], "<i8")


class Chunk:
    """Documents' tokens on their way to the parts."""

    def __init__(self, numbers: Numbers, head: Head):
        self.numbers, self.head, self.press = numbers, head, zstandard.ZstdCompressor(level=3)
        self.logs = np.log10(head.base(head.counts))
        self.clear()

    def clear(self) -> None:
        self.laid: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, t: np.ndarray, doc=None, held_out: bool = False, known: int = 0, base: float = 0.0) -> None:
        self.docs.append((doc, held_out, len(t), known, base))
        self.laid.append(t)
        self.size += len(t)

    def told(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, int, float]]:
        """(identities, numbered words that occur in learned texts, their log10 probability) of each text."""
        for t, cuts in self.numbers.of(texts):
            numbered = np.maximum(t, END)
            known = np.add.reduceat((t >= 0) & (self.head.counts[numbered] > 0), cuts[:-1], dtype=np.int64)
            base = np.add.reduceat(np.where(t >= 0, self.logs[numbered], 0.0), cuts[:-1])
            yield from zip(np.split(t, cuts[1:-1]), known.tolist(), base.tolist(), strict=True)

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens, each text led by DEPTH ends or by what a longer text had before; and their documents, -1 for the lead."""
        gap = np.zeros(DEPTH, np.int64)
        out, docs, size = [], [], 0
        for i, t in enumerate(self.laid):
            for start in range(0, len(t), CHUNK):
                part = t[start : start + CHUNK]
                if out and size + len(part) > CHUNK:
                    yield np.concatenate(out), np.concatenate(docs)
                    out, docs, size = [], [], 0
                out += [t[start - DEPTH : start] if start else gap, part]
                docs += [np.full(DEPTH, -1, np.int64), np.full(len(part), i, np.int64)]
                size += len(part)
        if out:
            yield np.concatenate(out), np.concatenate(docs)

    def asked(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(parts, words): words without a number that follow a word in the parts' contexts; each pair once a piece."""
        for laid, doc in self.pieces():
            at = np.flatnonzero((doc >= 0) & (laid < 0))
            at = at[laid[at - 1] != END]
            words, c = laid[at], [laid[at - d] for d in range(1, DEPTH + 1)]
            part = _parts(words, c, self.numbers.spread, self.head.parts)
            order = np.lexsort((words, part))
            part, words = part[order], words[order]
            first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (words[1:] != words[:-1])))[: len(part)])
            yield part[first], words[first]

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(part, blob)."""
        base, parts = len(self.head.counts), self.head.parts
        learned = np.array([not d[1] for d in self.docs], np.int64)
        for laid, doc in self.pieces():
            at = np.flatnonzero(doc >= 0)
            doc = doc[at]
            c = [laid[at - d] for d in range(1, DEPTH + 1)]
            part = _parts(laid[at], c, self.numbers.spread, parts)
            names, place = np.unique(laid[laid < 0], return_inverse=True)
            laid[laid < 0] = base + place
            c1, c2, c3, w = laid[at - 1], laid[at - 2], laid[at - 3], laid[at]
            low = (c3 << 2 * BITS) | (w << BITS) | doc
            high = (part << 2 * BITS) | (c1 << BITS) | c2
            order = np.argsort(low)
            order = order[np.argsort(high[order], kind="stable")]
            low, high = low[order], high[order]
            first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
            k = np.diff(first, append=len(order))
            keep = order[first]
            columns = [x[keep] for x in (c1, c2, c3, w)]
            marked = doc[keep] * 2 + learned[doc[keep]]
            part = part[keep]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield int(part[a]), _blob([*(x[a:b] for x in columns), marked[a:b], k[a:b], names], base, self.press)


DEALT = "key long, chunk long, blob binary, ids array<long>, held array<boolean>, n array<long>, known array<long>, base array<double>"
DEALT_NAMES = ["key", "chunk", "blob", "ids", "held", "n", "known", "base"]
#: Chunk numbers of what parts are told: counts of words, listed words of spread contexts.
COUNTS, LISTED = -2, -1
INFO = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]


def _addressed(parts: list[int], chunk: int, blobs: list[bytes]) -> pa.RecordBatch:
    """Blobs for parts as rows of DEALT."""
    none = [pa.nulls(len(blobs), pa.list_(t)) for t in INFO]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([chunk] * len(blobs), pa.int64()), pa.array(blobs, pa.binary()), *none], DEALT_NAMES)


def _asked(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(key, word): the words without a number whose counts the parts' tests need, from learned texts."""
    head = shared.value
    chunk = Chunk(held(("words", head.name), lambda: Numbers(head)), head)

    def out() -> Iterator[pa.RecordBatch]:
        for part, words in chunk.asked():
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words)], ["key", "word"])
        chunk.clear()

    for batch in batches:
        for t in chunk.numbers.each(batch.column(0)):
            chunk.add(t)
            if chunk.size >= CHUNK:
                yield from out()
    yield from out()


def _counts_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n) sorted by key, as one blob a batch and part."""
    for batch in batches:
        key, word, n = (np.asarray(c) for c in batch.columns)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
        blobs = [np.stack([word[a:b], n[a:b]]).astype("<i8").tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield _addressed(key[cut[:-1]].tolist(), COUNTS, blobs)


def _deal(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Blobs under the number of their part, and what is known of a chunk's documents under a negative number of the chunk."""
    from pyspark import TaskContext

    head = shared.value
    chunk, number = Chunk(held(("words", head.name), lambda: Numbers(head)), head), TaskContext.get().partitionId() << 32

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal number
        info = [pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*chunk.docs, strict=True), INFO, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - number]), pa.array([number]), pa.array([None], pa.binary()), *info], DEALT_NAMES)
        rows: list[tuple[int, bytes]] = []
        size = 0
        for row in chunk.blobs():
            rows.append(row)
            size += len(row[1])
            if size > 4 << 20:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)
        number += 1
        chunk.clear()

    def packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return _addressed([p for p, _ in rows], number, [b for _, b in rows])

    for batch in batches:
        for doc, out_of, (t, known, base) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), chunk.told(batch.column(2)), strict=True):
            chunk.add(t, doc, out_of, known, base)
            if chunk.size >= CHUNK:
                yield from out()
    if chunk.docs:
        yield from out()


# ---- contexts that several parts share -------------------------------------------------------------------------------
def _frequent(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(c1, c2, w, n, count): what follows spread words, and pairs of spread words, in learned texts.

    c2 is 0 for the single word; count is that of w, 0 for a word without a number.
    """
    head = shared.value
    numbers = held(("words", head.name), lambda: Numbers(head))
    names = np.array([0, *sorted(head.spread)], np.int64)  # 0 stands for no word
    texts: list[np.ndarray] = []
    leads: list[int] = []

    def out() -> pa.RecordBatch:
        t = np.concatenate(texts)
        real = np.ones(len(t), bool)
        for start, lead in zip(np.cumsum([0, *map(len, texts[:-1])]).tolist(), leads, strict=True):
            real[start : start + lead] = False
        texts.clear()
        leads.clear()
        wide = np.where(t > 0, numbers.spread[np.maximum(t, 0)] > 1, False)
        at = 1 + np.flatnonzero(wide[:-1] & real[1:])  # never the first of a text: the end before it is no spread word
        c1 = np.searchsorted(names, t[at - 1])
        both = at[at > 1]
        both = both[wide[both - 2]]
        c1, w = np.concatenate([c1, np.searchsorted(names, t[both - 1])]), np.concatenate([t[at], t[both]])
        c2 = np.concatenate([np.zeros(len(at), np.int64), np.searchsorted(names, t[both - 2])])
        kind, place = np.unique(w, return_inverse=True)
        key, n = np.unique((c1 * len(names) + c2) << BITS | place, return_counts=True)
        pair, w = key >> BITS, kind[key & (1 << BITS) - 1] if len(key) else key
        count = np.where(w >= 0, head.counts[np.maximum(w, 0)], 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[pair // len(names)], names[pair % len(names)], w, n.astype(np.int64), count)], ["c1", "c2", "w", "n", "count"])

    size = 0
    for batch in batches:
        for t in numbers.each(batch.column(0)):
            for start in range(0, len(t), CHUNK):  # a later piece is led by the two words before it
                lead = 2 if start else 0
                texts.append(t[start - lead : start + CHUNK])
                leads.append(lead)
                size += len(texts[-1])
                if size >= CHUNK:
                    yield out()
                    size = 0
    if texts:
        yield out()


def _shared_contexts(texts: DataFrame, counted: DataFrame, shared, head: Head) -> DataFrame | None:
    """(c1, c2, w, n, whole, rest, keep) of the listed words of spread words and pairs of them, written; None if there are none."""
    if not head.spread:
        return None
    grams = written(texts.mapInArrow(lambda it: _frequent(it, shared), "c1 long, c2 long, w long, n long, count long").groupBy("c1", "c2", "w").agg(F.sum("n").alias("n"), F.first("count").alias("count")), "frequent-grams")
    # at most as many contexts as there are spread words and pairs of them
    listed = F.when(F.col("n") >= LEAST, F.col("n"))
    stats = grams.groupBy("c1", "c2").agg(F.sum("n").alias("whole"), F.count(listed).alias("many"), F.coalesce(F.sum(listed), F.lit(0)).alias("listed_n"))
    rest = F.greatest(F.lit(1e-9), 1 - (F.col("listed_n") - DISCOUNT * F.col("many")) / F.col("whole"))
    stats = written(stats.withColumn("rest", rest), "frequent-contexts")
    few = min(len(head.spread) * (len(head.spread) + 1), 1 << 30)
    rows = grams.where(F.col("n") >= LEAST).join(hinted(stats, few), ["c1", "c2"])
    if head.tail:
        rows = rows.join(tail_counts(counted, head).select(F.col("word").alias("w"), F.col("n").alias("own")), "w", "left").withColumn("count", F.when(F.col("w") < 0, F.col("own")).otherwise(F.col("count")))
    rows = rows.withColumn("p0", (F.col("count") + 0.5) / (head.total + 0.5 * (head.distinct + 1)))
    mass = (F.col("n") - DISCOUNT) / F.col("whole")
    one = rows.where("c2 = 0").withColumn("p", mass + F.col("rest") * F.col("p0"))
    single = stats.where("c2 = 0").select(F.col("c1").alias("of"), F.col("rest").alias("rest1"))
    two = rows.where("c2 <> 0").join(one.select("c1", "w", F.col("p").alias("p1")), ["c1", "w"], "left").join(hinted(single, few), F.col("c1") == F.col("of")).drop("of")
    two = two.withColumn("short", F.coalesce("p1", F.col("rest1") * F.col("p0"))).withColumn("p", mass + F.col("rest") * F.col("short"))
    both = one.select("c1", "c2", "n", "p", F.col("p0").alias("short")).unionByName(two.select("c1", "c2", "n", "p", "short"))
    saved = both.groupBy("c1", "c2").agg(F.sum(F.col("n") * F.log2(F.col("p") / F.col("short"))).alias("saved"))
    keep = F.coalesce("saved", F.lit(0.0)) + (F.col("whole") - F.col("listed_n")) * F.log2("rest") >= GAIN * F.col("many")
    judged = stats.join(hinted(saved, few), ["c1", "c2"], "left").select("c1", "c2", "whole", "rest", (keep & (F.col("many") > 0)).alias("keep"))
    # a context without any listed word has one row of word -1, which is none
    out = judged.join(grams.where(F.col("n") >= LEAST), ["c1", "c2"], "left").select("c1", "c2", F.coalesce("w", F.lit(-1)).alias("w"), F.coalesce("n", F.lit(0)).alias("n"), "whole", "rest", "keep")
    return written(out, "frequent")


FREQUENT = [("c1", pa.int64()), ("c2", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("whole", pa.int64()), ("rest", pa.float64()), ("keep", pa.bool_())]


def _told(batches: Iterator[pa.RecordBatch], head: Head) -> Iterator[pa.RecordBatch]:
    """Listed words of spread contexts, as one blob a batch and part that needs them."""
    for batch in batches:
        c1 = np.asarray(batch.column("c1"))
        start = _mixed(c1)
        keys: dict[int, list[int]] = {}
        for i, (s, word) in enumerate(zip(start.tolist(), c1.tolist(), strict=True)):
            for j in range(head.spread[word]):
                keys.setdefault((s + j) % head.parts, []).append(i)
        blobs = []
        for rows in keys.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch.take(pa.array(rows)))
            blobs.append(sink.getvalue().to_pybytes())
        yield _addressed(list(keys), LISTED, blobs)


# ---- a part ----------------------------------------------------------------------------------------------------------
def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the place of each key among them; a part has less than 2^31 rows."""
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return key[fresh], place


class Part:
    """All contexts that end with some words: counted, tested, and used for every token after them."""

    def __init__(self, head: Head, blobs: list[tuple[int, bytes]], frequent: list[pa.RecordBatch], told: list[bytes]):
        self.base, self.head, self.told = len(head.counts), head, told
        read = [_unblob(b) for _, b in blobs]
        self.odd = np.unique(np.concatenate([names for _, names in read] + [x for b in frequent for x in (np.asarray(b.column("w")),)] or [np.zeros(0, np.int64)]))
        self.odd = self.odd[self.odd < 0]
        columns = []
        for rows, names in read:
            if len(names):
                place = (self.base + np.searchsorted(self.odd, names)).astype(np.int32)
                for x in rows[:4]:
                    odd = np.flatnonzero(x >= self.base)
                    x[odd] = place[x[odd] - self.base]
            columns.append(rows)
        self.rows = np.cumsum([0, *(len(c[0]) for c in columns)]).tolist()
        del read
        c1, c2, c3, self.w, self.doc, self.k = (np.concatenate([c[i] for c in columns]) for i in range(6))
        columns.clear()
        self.times = self.k * (self.doc & 1)  # of learned texts
        self.doc >>= 1
        self.frequent = frequent
        self.width = self.base + len(self.odd)
        self.contexts(c1, c2, c3)

    def contexts(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> None:
        """For each depth: the context of every row (there), the gram of every row, and the tables of both."""
        counts = np.ones(self.width, np.int64)  # of words that no context can list nothing is told
        counts[: self.base] = self.head.counts
        for blob in self.told:
            words, n = np.frombuffer(blob, "<i8").reshape(2, -1)
            counts[self.base + np.searchsorted(self.odd, words)] = n
        self.p0 = self.head.base(counts)
        first, at1 = _numbered(c1)
        second, at2 = _numbered(at1.astype(np.int64) * self.width + c2)
        _, at3 = _numbered(at2.astype(np.int64) * self.width + c3)
        self.levels: list[dict] = []
        short = None
        for at, there, up in ((at1, c1 != END, None), (at2, c2 != END, at1), (at3, c3 != END, at2)):
            short = self.level(at, there, up, short)
            self.levels.append(short)
            if len(self.levels) == 1:
                self.tell(short, {(int(c), 0): i for i, c in enumerate(first)}, 0)
            elif len(self.levels) == 2:
                self.tell(short, {(int(first[x // self.width]), int(x % self.width)): i for i, x in enumerate(second) if x % self.width} if self.frequent else {}, 1)
            before = self.levels[-2] if len(self.levels) > 1 else None
            self.test(short, before)
            if before is not None:  # what scores don't need
                for name in ("context", "word", "n", "p"):
                    del before[name]

    def level(self, at: np.ndarray, there: np.ndarray, up: np.ndarray | None, short: dict | None) -> dict:
        """Counts of the contexts at a depth and of their grams."""
        many = int(at.max()) + 1
        gram, of = _numbered(at.astype(np.int64) * self.width + self.w)
        times = np.where(there, self.times, 0)
        n = np.bincount(of, times, len(gram))
        x = {"at": at, "of": of, "there": there, "context": (gram // self.width).astype(np.int32), "word": (gram % self.width).astype(np.int32), "n": n, "whole": np.bincount(at, times, many)}
        if short is not None:
            row = np.zeros(len(gram), np.int32)
            row[of] = np.arange(len(of), dtype=np.int32)  # any row of the gram tells its shorter form
            x["up"] = short["of"][row]
        return self.weighed(x)

    def weighed(self, x: dict) -> dict:
        listed = x["n"] >= LEAST
        x["mass"] = np.where(listed, (x["n"] - DISCOUNT) / np.maximum(x["whole"][x["context"]], 1), 0.0)
        x["rest"] = np.maximum(1 - np.bincount(x["context"], x["mass"], len(x["whole"])), 1e-9)
        x["told"] = np.zeros(len(x["whole"]), bool)
        return x

    def tell(self, x: dict, places: dict[tuple[int, int], int], depth: int) -> None:
        """Put in what has been counted over all parts for the contexts that this part shares with others."""
        x["keep"] = np.zeros(len(x["whole"]), bool)
        key = x["context"].astype(np.int64) * self.width + x["word"] if self.frequent else None
        for b in self.frequent:
            c1, c2, w, n, whole, rest, keep = (np.asarray(b.column(name)) if kind != pa.bool_() else b.column(name).to_numpy(zero_copy_only=False) for name, kind in FREQUENT)
            rows = np.flatnonzero(c2 != 0) if depth else np.flatnonzero(c2 == 0)
            at = np.array([places.get(p, -1) for p in zip(c1[rows].tolist(), c2[rows].tolist(), strict=True)], np.int64)
            rows, at = rows[at >= 0], at[at >= 0]
            if not len(rows):
                continue
            fresh = at[~x["told"][at]]
            mine = np.isin(x["context"], np.unique(fresh))
            x["n"][mine], x["mass"][mine] = 0, 0.0
            x["told"][at], x["whole"][at], x["rest"][at], x["keep"][at] = True, whole[rows], rest[rows], keep[rows]
            word = np.where(w[rows] < 0, self.base + np.searchsorted(self.odd, w[rows]), w[rows])
            asked = at * self.width + word
            i = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            hit = (key[i] == asked) & (n[rows] >= LEAST)
            x["n"][i[hit]] = n[rows][hit]
            x["mass"][i[hit]] = (n[rows][hit] - DISCOUNT) / whole[rows][hit]

    def test(self, x: dict, short: dict | None) -> None:
        """Keep the contexts that save enough bits; those told of have been tested already."""
        x.setdefault("keep", np.zeros(len(x["whole"]), bool))
        p_short = self.p0[x["word"]] if short is None else short["p"][x["up"]]
        x.pop("up", None)
        x["p"] = x["mass"] + x["rest"][x["context"]] * p_short
        listed = np.flatnonzero(x["n"] >= LEAST)
        context, n = x["context"][listed], x["n"][listed]
        saved = np.bincount(context, n * np.log2(x["p"][listed] / p_short[listed]), len(x["whole"]))
        many, listed_n = np.bincount(context, minlength=len(x["whole"])), np.bincount(context, n, len(x["whole"]))
        own = (many > 0) & (saved + (x["whole"] - listed_n) * np.log2(x["rest"]) >= GAIN * many)
        x["keep"] = np.where(x["told"], x["keep"], own)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """For every row a and b: its probability is a + b times the word's own."""
        a, b = np.zeros(len(self.w)), np.ones(len(self.w))
        for x in self.levels:
            at = np.flatnonzero(x["keep"][x["at"]] & x["there"])
            rest = x["rest"][x["at"][at]]
            a[at] = x["mass"][x["of"][at]] + rest * a[at]
            b[at] *= rest
        return a, b


SCORED = "chunk long, ids array<long>, held array<boolean>, n array<long>, known array<long>, base array<double>, docs binary, sums binary, rare array<struct<doc: int, word: long, a: double, b: double, k: long>>"
_RARE = pa.list_(pa.struct([("doc", pa.int32()), ("word", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("k", pa.int64())]))


def _scored(chunks: list[int], docs: list[bytes], sums: list[bytes], rare: pa.Array) -> pa.RecordBatch:
    info = [pa.nulls(len(chunks), pa.list_(t)) for t in INFO]
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *info, pa.array(docs, pa.binary()), pa.array(sums, pa.binary()), rare], ["chunk", "ids", "held", "n", "known", "base", "docs", "sums", "rare"])


def _score_part(head: Head, blobs: list[tuple[int, bytes]], frequent: list[pa.RecordBatch], told: list[bytes]) -> Iterator[pa.RecordBatch]:
    part = Part(head, blobs, frequent, told)
    a, b = part.shares()
    odd = part.w >= part.base
    value = np.where(odd, 0.0, part.k * np.log10(a + b * part.p0[part.w]))
    docs, sums, offsets, picked = [], [], [0], []
    for i in range(len(blobs)):
        s = slice(part.rows[i], part.rows[i + 1])
        total = np.bincount(part.doc[s], value[s])
        at = np.flatnonzero(total)
        docs.append(at.astype("<i4").tobytes())
        sums.append(total[at].astype("<f8").tobytes())
        rows = part.rows[i] + np.flatnonzero(odd[s])
        picked.append(rows)
        offsets.append(offsets[-1] + len(rows))
    rows = np.concatenate(picked)
    fields = [pa.array(part.doc[rows].astype(np.int32)), pa.array(part.odd[part.w[rows] - part.base]), pa.array(a[rows]), pa.array(b[rows]), pa.array(part.k[rows].astype(np.int64))]
    rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RARE.value_type)))
    yield _scored([c for c, _ in blobs], docs, sums, rare)


def _parts_scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT sorted by key."""
    release()
    head = shared.value
    now, blobs, frequent, told = None, [], [], []
    for batch in batches:
        keys, chunks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (key, chunk) in enumerate(zip(keys, chunks, strict=True)):
            if key < 0:  # a chunk's documents
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(1), *one.columns[3:8], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, _RARE)], ["chunk", "ids", "held", "n", "known", "base", "docs", "sums", "rare"])
                continue
            if key != now:
                if blobs:
                    yield from _score_part(head, blobs, frequent, told)
                now, blobs, frequent, told = key, [], [], []
                held(("part", key), lambda: None)  # freed memory of the part before goes back to the system
            blob = batch.column(2)[i].as_py()
            if chunk == COUNTS:
                told.append(blob)
            elif chunk == LISTED:
                frequent += pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()
            else:
                blobs.append((chunk, blob))
    if blobs:
        yield from _score_part(head, blobs, frequent, told)


# ---- back to the documents -------------------------------------------------------------------------------------------
def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk follow each other, its documents' row first."""
    release()
    names = ["chunk", "doc", "doc_id", "held_out", "n_tokens", "known", "base", "score"]
    info, total, now = None, None, None

    def out() -> pa.RecordBatch:
        n = len(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, now)), pa.array(np.arange(n, dtype=np.int32)), *(x.values for x in info), pa.array(total)], names)

    for batch in batches:
        for i, chunk in enumerate(batch.column(0).to_pylist()):
            if chunk != now:
                if now is not None:
                    yield out()
                info, now = [batch.column(c)[i] for c in range(1, 6)], chunk
                total = np.zeros(len(info[0].values))
                continue
            total[np.frombuffer(batch.column(6)[i].as_buffer(), "<i4")] += np.frombuffer(batch.column(7)[i].as_buffer(), "<f8")
    if now is not None:
        yield out()


def score(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Learn from rows where `learned` holds, score all rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words and one end; null texts have the end alone. base_score is that of independent words. Null ids and
    repeated rows are scored like any other; other columns are not read; an empty table gives an empty result. With nothing
    to learn every word is as likely as any. Neither head nor part_tokens changes a score.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learned).alias("held_out"), F.col(text_col).alias("text"))
    counted = unigrams(slim.where(~F.col("held_out")).select("text"))
    # a bound of all tokens, for the number of parts: bytes less than half of which are words
    tokens = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    model = head_of(counted, tokens, head, part_tokens)
    if len(model.counts) + CHUNK >= 1 << BITS:
        raise ValueError(f"head and CHUNK need more than {BITS} bits")
    shared, slim_head = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(replace(model, words=[]))
    dealt = slim.mapInArrow(lambda it: _deal(it, shared), DEALT)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if model.tail:  # the tests need the counts of words without a number: each part is told of those that it asks for
        asked = slim.where(~F.col("held_out")).select("text").mapInArrow(lambda it: _asked(it, shared), "key long, word long").distinct()
        few = tail_counts(counted.where(F.col("n") >= LEAST), model)
        told = asked.join(few, "word").select("key", "word", "n").repartition(tasks, "key").sortWithinPartitions("key")
        dealt = dealt.unionByName(told.mapInArrow(_counts_told, DEALT))
    frequent = _shared_contexts(slim.where(~F.col("held_out")).select("text"), counted, shared, model)
    if frequent is not None:
        dealt = dealt.unionByName(frequent.select(*[n for n, _ in FREQUENT]).mapInArrow(lambda it: _told(it, slim_head.value), DEALT))
    sorted_parts = dealt.repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int")).sortWithinPartitions("key", "chunk")
    scored = written(sorted_parts.mapInArrow(lambda it: _parts_scored(it, slim_head), SCORED), "scored")
    slim_scored = scored.drop("rare").repartition("chunk").sortWithinPartitions("chunk", F.col("docs").isNotNull())
    rows = slim_scored.mapInArrow(_gathered, "chunk long, doc int, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    # words without a number: their counts come by a join; a document's part is summed before it meets the document
    rare = scored.where(F.size("rare") > 0).select("chunk", F.explode("rare").alias("x")).select("chunk", "x.*")
    counts = tail_counts(counted, model)
    base = (F.coalesce(F.col("n"), F.lit(0)) + 0.5) / (model.total + 0.5 * (model.distinct + 1))
    known = F.when(F.col("n") > 0, F.col("k")).otherwise(0)
    tail = rare.join(counts, "word", "left").groupBy("chunk", "doc").agg(F.sum(known).alias("more_known"), F.sum(F.col("k") * F.log10(base)).alias("more_base"), F.sum(F.col("k") * F.log10(F.col("a") + F.col("b") * base)).alias("more"))
    both = rows.join(tail, ["chunk", "doc"], "left")
    plus = lambda c, more: F.col(c) + F.coalesce(more, F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more").alias("score"))
