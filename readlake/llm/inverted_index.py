"""A distributed positional inverted index, and benchmark decontamination by it.

The index is sharded by document: a block holds the posting lists of some documents, so a phrase is answered inside every
block and no term's postings meet in one place. A block lists all its terms, so one index serves any benchmark. Within a
block, postings are positions in the documents laid end to end, a gap between two of them. A phrase is found by intersecting its terms' lists, each shifted
by the term's offset, from the rarest term of the whole index to the commonest.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import free_name, hinted, release, written

#: Words of a block (a longer document is a block of its own), and words of test items that one pass looks for.
BLOCK_WORDS, PASS_WORDS = 2_000_000, 1_000_000
#: Positions left free after a document.
GAP = 1 << 10
# ASCII but digits and letters becomes a space, A-Z becomes a-z; other bytes stay.
_CLEAN = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text, A-Z lower-cased."""
    return text.translate(_CLEAN).split() if text else []


BLOCK = "rids array<long>, ends array<long>, sizes array<long>, terms binary, counts array<int>, postings binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the posting lists of documents (rid, text): terms are a block's distinct words, one space apart."""
    rids: list[int] = []
    sizes: list[int] = []
    found: list[np.ndarray] = []
    held = 0
    number: defaultdict[bytes, int] = defaultdict(count().__next__)

    def block() -> pa.RecordBatch:
        lengths = np.array(sizes, np.int64)
        ends = np.cumsum(lengths + GAP) - GAP
        terms = np.concatenate(found)
        begin = np.repeat(ends - lengths - (np.cumsum(lengths) - lengths), lengths)
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(number)).astype(np.int32)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((rids, pa.int64()), (ends, pa.int64()), (sizes, pa.int64()), (counts, pa.int32()))]
        positions = (order + begin[order]).astype("<i8" if len(ends) and ends[-1] >= 1 << 31 else "<i4")
        return pa.RecordBatch.from_arrays([*lists[:3], pa.array([b" ".join(number)], pa.binary()), lists[3], pa.array([positions.tobytes()], pa.binary())], ["rids", "ends", "sizes", "terms", "counts", "postings"])

    for batch in batches:
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            w = words(text.as_py())
            rids.append(rid)
            sizes.append(len(w))
            found.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
            held += len(w) + 8
            if held >= BLOCK_WORDS:
                yield block()
                rids, sizes, found, held, number = [], [], [], 0, defaultdict(count().__next__)
    if rids:
        yield block()


def build(docs: DataFrame) -> DataFrame:
    """The written index of docs (rid, text): one row per block, the postings of all its terms.

    Null and empty texts have no postings; rid tells repeated rows apart and must not be null; an empty table has no block.
    Any benchmark and any search can be answered from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from _index(batches)

    return written(docs.select("rid", "text").mapInArrow(run, BLOCK), "postings")


class Postings:
    """The posting lists of one block, for the terms asked for, which are known by number."""

    def __init__(self, terms: bytes, counts: np.ndarray, postings: memoryview, begin: np.ndarray, ends: np.ndarray, asked: dict[bytes, int]):
        starts = np.cumsum(counts, dtype=np.int64) - counts
        self.at = {asked[w]: (int(starts[i]), int(counts[i])) for i, w in enumerate(terms.split(b" ")) if w in asked}
        self.flat = np.frombuffer(postings, "<i8" if len(ends) and ends[-1] >= 1 << 31 else "<i4")
        self.begin, self.ends = begin, ends

    def of(self, term: int) -> np.ndarray:
        a, n = self.at.get(term, (0, 0))
        return self.flat[a : a + n]

    def phrase(self, terms: tuple[int, ...], rarity: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase: offset-adjusted lists intersected from the rarest term on."""
        if not terms or any(t not in self.at for t in terms):
            return self.flat[:0]
        order = sorted(range(len(terms)), key=lambda k: (rarity[terms[k]], k))
        starts = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.of(terms[k])
            i = np.searchsorted(other, starts + k)
            starts = starts[other[np.minimum(i, len(other) - 1)] == starts + k]
        # a document is GAP away from the next, so only a longer phrase could meet two of them
        return starts if len(terms) <= GAP else starts[starts + len(terms) <= self.ends[np.searchsorted(self.ends, starts, "right")]]

    def near(self, terms: tuple[int, ...], slop: int, rarity: np.ndarray) -> np.ndarray:
        """Proximity: positions of the rarest term with every other term of the same document at most slop + len(terms) - 1 places away."""
        if not terms or any(t not in self.at for t in terms):
            return self.flat[:0]
        order = sorted(set(terms), key=lambda t: (rarity[t], t))
        at, reach = self.of(order[0]).astype(np.int64), slop + len(terms) - 1
        doc = np.searchsorted(self.ends, at, "right")
        low, high = np.maximum(at - reach, self.begin[doc]), np.minimum(at + reach, self.ends[doc] - 1)
        for t in order[1:]:
            other = self.of(t)
            i = np.searchsorted(other, low)
            good = (i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= high)
            at, low, high = at[good], low[good], high[good]
        return at


def _blocks(batches: Iterator[pa.RecordBatch], asked: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Postings]]:
    for batch in batches:
        for k in range(batch.num_rows):
            rids, ends, sizes = (np.asarray(batch.column(c)[k].values) for c in range(3))
            yield rids, ends, sizes, Postings(batch.column(3)[k].as_py(), np.asarray(batch.column(4)[k].values), batch.column(5)[k].as_buffer(), ends - sizes, ends, asked)


def frequencies(index: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """Occurrences of each of these distinct terms in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = {w: i for i, w in enumerate(shared.value)}, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                n = np.asarray(counts.values)
                for i, w in enumerate(terms.as_py().split(b" ")):
                    if w in asked:
                        total[asked[w]] += n[i]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(count_in, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    shared.destroy()
    return out


def search(index: DataFrame, phrases: list[str], slop: int | None = None) -> DataFrame:
    """(rid, phrase, at): every exact match of the phrases (at: word of its start), or with slop every proximity match.

    phrase is the place in the list. A phrase without words matches nothing, a repeated one as often as it is listed. With
    slop, `at` is the place of its rarest word, all others lie in the same document at most slop + its words - 1 away.
    """
    asked = [words(p.encode() if p else None) for p in phrases]
    vocabulary = sorted({w for p in asked for w in p})
    number = {w: i for i, w in enumerate(vocabulary)}
    shared = index.sparkSession.sparkContext.broadcast((number, [tuple(number[w] for w in p) for p in asked], frequencies(index, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asked, rare = shared.value
        for rids, ends, sizes, postings in _blocks(batches, number):
            for p, terms in enumerate(asked):
                at = postings.phrase(terms, rare) if slop is None else postings.near(terms, slop, rare)
                if len(at):
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(rids[doc]), pa.array(np.full(len(at), p, np.int64)), pa.array((at - (ends - sizes)[doc]).astype(np.int64))], ["rid", "phrase", "at"])

    return index.mapInArrow(run, "rid long, phrase long, at long")


@dataclass
class Windows:
    """Distinct windows of consecutive words of items, as stretches of the items laid end to end; and the items of each."""

    flat: np.ndarray  # term numbers
    start: np.ndarray
    size: np.ndarray
    owner_at: np.ndarray  # owners of window i: owner[owner_at[i] : owner_at[i + 1]]
    owner: np.ndarray

    def terms(self, i: int) -> tuple[int, ...]:
        return tuple(self.flat[self.start[i] : self.start[i] + self.size[i]].tolist())

    def rarest(self, rarity: np.ndarray) -> np.ndarray:
        """Of each window the term of least frequency."""
        out = np.empty(len(self.start), np.int64)
        for n in np.unique(self.size):
            rows = np.flatnonzero(self.size == n)
            t = self.flat[self.start[rows][:, None] + np.arange(n)]
            out[rows] = t[np.arange(len(rows)), np.argmin(rarity[t], axis=1)]
        return out

    def within(self, rows: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Those of the windows `rows` whose terms are all known."""
        ok = np.zeros(len(rows), bool)
        for n in np.unique(self.size[rows]):
            at = np.flatnonzero(self.size[rows] == n)
            ok[at] = known[self.flat[self.start[rows[at]][:, None] + np.arange(n)]].all(axis=1)
        return rows[ok]


def windows(items: list[list[int]], size: int) -> Windows:
    """Distinct windows of `size` consecutive words; a shorter item is one window, one without words none."""
    lengths = np.array([len(w) for w in items], np.int64)
    flat = np.array([x for w in items for x in w], np.int32)
    many = np.where(lengths > 0, np.maximum(1, lengths - size + 1), 0)
    item = np.repeat(np.arange(len(items)), many)
    start = (np.cumsum(lengths) - lengths)[item] + np.arange(many.sum()) - (np.cumsum(many) - many)[item]
    sizes = np.minimum(lengths, size)[item]
    starts, lens, owner, owner_n = [], [], [], []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        kind, inverse = np.unique(flat[start[rows][:, None] + np.arange(n)], axis=0, return_inverse=True)
        first = np.full(len(kind), len(start), np.int64)
        np.minimum.at(first, inverse.ravel(), rows)
        pairs = np.unique(np.stack([inverse.ravel(), item[rows]], axis=1), axis=0)
        starts.append(start[first])
        lens.append(np.full(len(kind), n))
        owner.append(pairs[:, 1])
        owner_n.append(np.bincount(pairs[:, 0], minlength=len(kind)))
    whole = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return Windows(flat, whole(starts), whole(lens), np.concatenate(([0], np.cumsum(whole(owner_n)))), whole(owner))


HITS = "rid long, n_words long, spans array<struct<a: long, b: long>>, items array<string>"


def _hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(rid, n_words, spans of hit words, items found) of every document of the index.

    Windows wait under their rarest term; a block visits those whose rarest term it holds.
    """
    names, number, asked, rarity = shared.value
    rarest = asked.rarest(rarity)
    for rids, ends, sizes, postings in _blocks(batches, number):
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        begin = ends - sizes
        known = np.zeros(len(rarity), bool)
        known[list(postings.at)] = True
        for i in asked.within(np.flatnonzero(known[rarest]), known).tolist() if len(rarest) else ():
            at = postings.phrase(terms := asked.terms(i), rarity)
            if len(at):
                doc = np.searchsorted(ends, at, "right")
                of = asked.owner[asked.owner_at[i] : asked.owner_at[i + 1]].tolist()
                for d, p in zip(doc.tolist(), (at - begin[doc]).tolist(), strict=True):
                    spans.setdefault(d, []).append((p, p + len(terms)))
                    items.setdefault(d, set()).update(of)
        none: list = []
        found = [sorted({names[i] for i in items.get(d, none)}) for d in range(len(rids))]
        yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(sizes), pa.array([_joined(spans[d]) if d in spans else none for d in range(len(rids))], _SPANS), pa.array(found, pa.list_(pa.string()))], ["rid", "n_words", "spans", "items"])


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


JUDGED = "rid long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<a: long, b: long>>, contaminated boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(rid, id, n_words, n_hit, n_items, items_sha256, spans, contaminated) of every row of docs.

    A document's word is hit inside any occurrence of a window of `size` consecutive words of an item; contaminated if at
    least one word and one in `one_in` of its words are hit. spans are the hit words as [a, b). Null and empty texts have no
    words; an item without words (or null) has no window; repeated items count once by id, repeated documents stay; null
    item ids are no item; other columns are not read. An empty benchmark hits nothing. The index is built once; the
    benchmark is looked up in passes of PASS_WORDS words, so its size bounds the number of passes, not a task's memory.
    """
    slim = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "numbered")
    judged = _judged(slim, benchmark, size, one_in, item_col, item_text)
    return judged.join(slim.select("rid", "id"), "rid").select("rid", "id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "contaminated")


def _judged(slim: DataFrame, benchmark: DataFrame, size: int, one_in: int, item_col: str, item_text: str) -> DataFrame:
    """What `contaminated` finds for each rid of a written table (rid, text), which keeps its numbers however often it is read."""
    spark, index, found = slim.sparkSession, build(slim), []
    for names, texts in _passes(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(item_text))):
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        found.append(spark.sparkContext.broadcast((names, number, windows([[number[w] for w in t] for t in texts], size), frequencies(index, vocabulary))))
    if len(found) == 1:  # one pass over the blocks does it all
        return index.mapInArrow(lambda it: _judge(_hits(it, found[0]), one_in), JUDGED)
    hits = [index.mapInArrow(lambda it, shared=shared: _hits(it, shared), HITS) for shared in found]
    whole = reduce(DataFrame.unionByName, hits).groupBy("rid").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return whole.mapInArrow(lambda it: _judge(it, one_in), JUDGED)


def _passes(benchmark: DataFrame) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    """Items' names and words, up to PASS_WORDS at a time; one empty pass if there are none."""
    names: list[str] = []
    texts: list[list[bytes]] = []
    held, any_pass = 0, False
    for name, text in benchmark.distinct().orderBy(*benchmark.columns).toLocalIterator(prefetchPartitions=False):
        w = words(text.encode() if text else None)
        if not w:
            continue
        names.append(name)
        texts.append(w)
        held += len(w)
        if held >= PASS_WORDS:
            yield names, texts
            names, texts, held, any_pass = [], [], 0, True
    if names or not any_pass:
        yield names, texts


def _judge(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, n, spans, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            joined = _joined([(s["a"], s["b"]) for s in spans])
            hit, items = sum(s["b"] - s["a"] for s in joined), set(items)
            rows.append((rid, n, hit, len(items), _digest(items), joined, hit > 0 and one_in * hit >= n))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], ["rid", "n_words", "n_hit", "n_items", "items_sha256", "spans", "contaminated"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns stay.

    Nulls, repeats and empty tables are treated as by `contaminated`; any column name of docs is safe. A benchmark of one
    pass is looked up in blocks that are indexed and judged in the pass that hands on the whole rows. For a larger one the
    rows are numbered and indexed in written tables.
    """
    spark = docs.sparkSession
    passes = _passes(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(item_text)))
    (names, texts), more = next(passes), next(passes, None)
    if more is None:
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        rarity = occurrences(docs.select(text_col), vocabulary)
        shared = spark.sparkContext.broadcast((names, number, windows([[number[w] for w in t] for t in texts], size), rarity))
        return docs.mapInArrow(lambda it: _clean(it, shared, one_in, text_col), docs.schema)
    rid = free_name(docs, "rid")
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(F.col(rid).alias("rid"), F.col(text_col).alias("text"))
    bad = _judged(slim, benchmark, size, one_in, item_col, item_text).where("contaminated").select(F.col("rid").alias(rid))
    bad = written(bad, "contaminated")
    return numbered.join(hinted(bad, bad.count()), rid, "left_anti").drop(rid)


def occurrences(texts: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """Occurrences of each of these distinct terms in one column of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = {w: i for i, w in enumerate(shared.value)}, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                w = [x for text in batch.column(0).slice(start, 256).cast(pa.binary()) for x in words(text.as_py())]
                total += np.bincount(np.fromiter(map(asked.get, w, repeat(-1)), np.int64, len(w)) + 1, minlength=len(total))
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1:][at])], ["term", "n"])

    rows = texts.mapInArrow(count_in, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _clean(batches: Iterator[pa.RecordBatch], shared, one_in: int, text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows of each batch that are not contaminated, by an index of the batch's texts."""
    release()
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_col)], ["rid", "text"])
        bad = np.zeros(batch.num_rows, bool)
        for found in _judge(_hits(_index(iter([texts])), shared), one_in):
            bad[np.asarray(found.column("rid"))] = found.column("contaminated").to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(~bad))
