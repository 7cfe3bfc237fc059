"""How far the sources of a language differ in their words: every pair of sources, and each source's own terms.

A source's relative frequency of a term, smoothed by one and scaled to whole numbers, is p = 1 + floor(10^9 (n + 1) / (N + V)).
The divergence f(p, q) = floor((p - q)^2 / q) of two sources is summed over all V terms of the language, but most terms are
in few of its sources. So each pair starts at V times the f of two zero counts, and only what differs from that is added:

* a term that one source has and the other lacks adds the same for every term of the same count, so such corrections come
  from a histogram of the source's counts, as if the other source had none of its terms;
* a term that both have adds what makes the sum of those two right. Only these come from the terms' postings. They are
  summed where a posting list is read, so no pair of postings is a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.common import hinted, release, written

# ASCII but letters becomes a space, A-Z becomes a-z; other bytes stay.
_CLEAN = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Counts that a task gathers before it hands them on, and pairs of postings that it treats at once.
HELD, PAIRS = 400_000, 1_000_000

COUNTS = "lang string, source string, term string, n long, d long"


def terms(text: bytes | None) -> list[bytes]:
    """The terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text, A-Z lower-cased."""
    return text.translate(_CLEAN).split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences n of each term, and documents d that hold it, by (lang, source): summed over many documents of a task."""
    release()
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in found.items():
            names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
            of = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*names, of, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "d"])
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            if not (w := terms(text.as_py())):
                continue
            n, d = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(w)
            d.update(set(w))
            held += len(n)
            if held >= HELD:
                yield from out()
                held = 0
    yield from out()


def index(docs: DataFrame, least: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The written postings (lang, term, source, n) of the terms that at least `least` documents of a language hold.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own; other columns don't matter.
    """
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    dealt = slim.mapInArrow(_count, COUNTS).repartition("lang", "term")  # sums, lists and document counts of a term all meet here
    postings = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    df = F.sum("d").over(Window.partitionBy("lang", "term"))
    return written(postings.withColumn("df", df).where(F.col("df") >= least).select("lang", "term", "source", "n"), "postings")


def scaled(n: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 1) / size) by long division in steps of 1000, exact in 64 bits up to 9 * 10^15 terms."""
    a = (n + 1) * 1000
    b = (a % size) * 1000
    c = (b % size) * 1000
    div = lambda x: F.call_function("div", x, size)
    return div(a) * 1_000_000 + div(b) * 1000 + div(c) + 1


def unlike(p: Column, q: Column) -> Column:
    """f(p, q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, postings: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The written table (lang, source, size, v, p0) of all groups of docs: size is N + V, p0 the p of a count of zero, 1 if V is 0."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    total = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = postings.groupBy("lang", "term").agg(F.count("*").alias("k")).groupBy("lang").agg(F.count("*").alias("v"))
    found = named.join(total, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("size"))
    return written(found.withColumn("p0", F.when(F.col("v") > 0, scaled(F.lit(0), F.col("size"))).otherwise(F.lit(1))), "groups")


SUMS = "lang string, source string, item string, value long"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what terms in both sources of a pair add to the corrections of each alone.

    Rows (lang, term, source, p, p0) come term by term. A task holds the postings of a stretch of terms and a sum for each
    pair of sources that it has met.
    """
    release()
    number: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def add(key: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for k, x in zip(key[first].tolist(), np.add.reduceat(value[order], first).tolist(), strict=True):
            sums[k] = sums.get(k, 0) + x

    def pairs(run: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        """run: which term a posting is of. The partners of a posting are the postings of its run, PAIRS of all pairs at a time."""
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        sizes = np.diff(np.append(starts, len(run)))
        at, n = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(run):
            before = upto[lo] - n[lo]
            hi = max(lo + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
            left = np.repeat(np.arange(lo, hi), n[lo:hi])
            right = at[left] + np.arange(len(left)) - (upto[left] - n[left] - before)
            other = left != right
            left, right = left[other], right[other]
            if len(left):
                a, a0, b, b0 = p[left], p0[left], p[right], p0[right]
                add(group[left] << 32 | group[right], _f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0))
            lo = hi

    waiting: list[pa.RecordBatch] = []

    def settle(last: bool) -> None:
        """Treat all terms that are complete: all but the last one, unless no rows follow."""
        table = pa.Table.from_batches(waiting).combine_chunks()
        lang, term = table.column("lang"), table.column("term")
        new = np.concatenate(([True], pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy()))
        end = len(table) if last else int(np.flatnonzero(new)[-1])
        waiting[:] = table.slice(end).to_batches()
        table = table.slice(0, end)
        coded = [table.column(x).combine_chunks().dictionary_encode() for x in ("lang", "source")]
        key = coded[0].indices.to_numpy().astype(np.int64) << 32 | coded[1].indices.to_numpy()
        own, inverse = np.unique(key, return_inverse=True)
        group = np.array([number.setdefault((coded[0].dictionary[k >> 32].as_py(), coded[1].dictionary[k & 0xFFFFFFFF].as_py()), len(number)) for k in own.tolist()], np.int64)
        if end:
            pairs(np.cumsum(new[:end]), group[inverse], table.column("p").to_numpy(), table.column("p0").to_numpy())

    held = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            held += batch.num_rows
        if held >= 100_000:
            settle(False)
            held = 0
    if waiting:
        settle(True)
    names = list(number)
    rows = [(*names[k >> 32], names[k & 0xFFFFFFFF][1], x) for k, x in sums.items() if x]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "item", "value"])


def pair_divergence(postings: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all terms of the language, for each two sources of it; 0 where V is 0."""
    n = found.count()
    other = found.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pair = found.join(hinted(other, n), "lang").where(F.col("source") != F.col("item"))
    start = pair.select("lang", "source", "item", (F.col("v") * unlike(F.col("p0"), F.col("q0"))).alias("value"))
    counts = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(hinted(found, n), ["lang", "source"])
    counts = counts.select("lang", "source", "k", "p0", scaled(F.col("n"), F.col("size")).alias("p"))
    one = counts.join(hinted(other, n), "lang").where(F.col("source") != F.col("item"))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    alone = one.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (unlike(p, q0) - unlike(p0, q0))).alias("has"), F.sum(F.col("k") * (unlike(q0, p) - unlike(q0, p0))).alias("lacks"))
    alone = alone.select("lang", F.explode(F.array(F.struct("source", "item", F.col("has").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("lacks").alias("value")))).alias("x")).select("lang", "x.*")
    listed = postings.join(hinted(found, n), ["lang", "source"]).select("lang", "term", "source", scaled(F.col("n"), F.col("size")).alias("p"), "p0")
    both = listed.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_both, SUMS)
    return start.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def own_terms(postings: DataFrame, found: DataFrame, most: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the terms of each source that are more frequent there than in its language, the first `most`."""
    n = found.count()
    whole = found.groupBy("lang").agg((F.sum(F.col("size") - F.col("v")) + F.max("v")).alias("whole"))
    total = F.sum("n").over(Window.partitionBy("lang", "term"))
    d = postings.withColumn("all", total).join(hinted(found, n), ["lang", "source"]).join(hinted(whole, n), "lang")
    d = d.select("lang", "source", F.col("term").alias("item"), scaled(F.col("n"), F.col("size")).alias("p"), scaled(F.col("all"), F.col("whole")).alias("q")).where(F.col("p") > F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return d.select("lang", "source", "item", unlike(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = 3, most: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): `pair_divergence`, all ranks, as part `pair`, and `own_terms` as part `term`.

    Ranks count from 1 in each group and part, by falling value, then by the item's bytes. Null texts, languages and sources
    are ''; repeated rows count each; groups without terms take part in pairs; an empty table gives an empty result. There
    are as many pair rows as pairs of sources, as the result asks.
    """
    postings = index(docs, least, text_col, lang_col, source_col)
    found = groups(docs, postings, lang_col, source_col)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pair_divergence(postings, found).withColumn("rank", rank)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pair, "pair").unionByName(part(own_terms(postings, found, most), "term"))
