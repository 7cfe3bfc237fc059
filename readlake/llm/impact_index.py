"""Ranked search over an impact-ordered inverted index, score at a time.

A posting's impact, (10^9 tf) div (1000 tf + 8 m), is a whole number that no query changes. The index is sharded by document:
a shard's row for a term holds the term's postings grouped by equal impact, largest first. A query takes the groups of all
its terms in falling order of weight times impact. What each term has left bounds what any document can still gain; when
the bound proves that no further document can be among the first k, the scores of those that still can are completed and
compared exactly. A task carries the k best of each query from shard to shard, so later shards stop sooner.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.common import release, written

# ASCII but digits and letters becomes a space, A-Z becomes a-z; other bytes stay.
_CLEAN = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Postings of a shard (a document is never cut), terms of the queries of one pass, and postings that a search reads first.
SHARD_POSTINGS, PASS_TERMS, FIRST = 2_000_000, 1_000_000, 2_048
#: Rows of an index batch that go to the writer at once.
ROWS = 20_000

#: One row for a shard and term; the row without a term has the ids of the shard's documents, which docs refer to by place.
INDEX = "shard long, term string, df int, impacts array<int>, ends array<int>, docs array<int>, ids array<long>"


def terms(text: bytes | None) -> list[bytes]:
    """The terms [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text, A-Z lower-cased."""
    return text.translate(_CLEAN).split() if text else []


@dataclass(frozen=True)
class Index:
    """postings: the written table INDEX; documents: those with a term; total: all their terms."""

    postings: DataFrame
    documents: int
    total: int


def _shard(shard: int, ids: list, found: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], names: list[bytes], documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard. found: (terms, tf) of each document."""
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(t) for t, _ in found])
    by_name = np.empty(len(names), np.int64)
    by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    term, tf = by_name[np.concatenate([t for t, _ in found])], np.concatenate([n for _, n in found])
    m = np.array([25 + 75 * n * documents // total for n in sizes], np.int64)[doc]
    impact = 10**9 * tf // (1000 * tf + 8 * m)
    order = np.lexsort((doc, -impact, term))
    term, impact, doc = term[order], impact[order], doc[order]
    new_term = np.concatenate(([True], term[1:] != term[:-1]))
    group = np.flatnonzero(new_term | np.concatenate(([True], impact[1:] != impact[:-1])))
    start = np.flatnonzero(new_term)
    size = np.diff(np.append(start, len(term)))
    ends = np.append(group[1:], len(term)) - np.repeat(start, np.diff(np.append(np.searchsorted(group, start), len(group))))
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
    of_groups, of_docs = np.append(np.searchsorted(group, start), len(group)), np.append(start, len(term))
    none = lambda n: pa.nulls(n, pa.list_(pa.int64()))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(start), shard)), pa.array(sorted(names), pa.binary()).cast(pa.string()), pa.array(size.astype(np.int32)), lists(of_groups, impact[group]), lists(of_groups, ends), lists(of_docs, doc), none(len(start))],
        names := ["shard", "term", "df", "impacts", "ends", "docs", "ids"],
    )
    whole = [pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.list_(pa.int32()))] * 3, pa.array([ids], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(whole, names)
    for at in range(0, rows.num_rows, ROWS):
        yield rows.slice(at, ROWS)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all terms of all documents (rows). Null texts and texts without a term have no postings; ids are whole numbers
    or null; repeated rows are documents of their own; an empty table has no shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n, total = 0, 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                k = len(terms(text.as_py()))
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    sums = docs.select(text_col).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    documents, total = sums[0] or 0, sums[1] or 0

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shard, held = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        sizes: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                w = terms(text.as_py())
                if not w:
                    continue
                tf = Counter(w)
                ids.append(i)
                sizes.append(len(w))
                found.append((np.fromiter(map(number.__getitem__, tf), np.int32, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))))
                held += len(tf)
                if held >= SHARD_POSTINGS:
                    yield from _shard(shard, ids, found, sizes, list(number), documents, total)
                    shard, held, ids, sizes, found = shard + 1, 0, [], [], []
                    number.clear()
        if ids:
            yield from _shard(shard, ids, found, sizes, list(number), documents, total)

    return Index(written(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(invert, INDEX), "impacts"), documents, total)


class Shard:
    """A shard's postings of the terms asked for. Groups of all terms are laid end to end: impacts, and where postings begin and end."""

    def __init__(self, ids: pa.Array, rows: pa.Table, asked: int):
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        impacts, ends, docs = (rows.column(c).combine_chunks() for c in ("impacts", "ends", "docs"))
        self.impacts, self.docs = impacts.flatten().to_numpy().astype(np.int64), docs.flatten().to_numpy()
        groups, n = impacts.value_lengths().to_numpy().astype(np.int64), docs.value_lengths().to_numpy().astype(np.int64)
        begin = np.repeat(np.cumsum(n) - n, groups)
        self.end = begin + ends.flatten().to_numpy()
        self.begin = np.concatenate(([0], self.end[:-1]))
        self.row = np.full(asked, -1)
        self.row[rows.column("number").to_numpy()] = np.arange(len(n))
        self.last = np.cumsum(groups)
        self.first = self.last - groups

    def _postings(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these groups, and which of the groups each is of."""
        n = self.end[groups] - self.begin[groups]
        of = np.repeat(np.arange(len(groups)), n)
        return self.docs[self.begin[groups][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]], of

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(docs, scores) that hold all of the shard's first k with a score of floor or more (and above 0); others may be among them."""
        row = self.row[asked]
        row, weights = row[(row >= 0) & (weights > 0)], weights[(row >= 0) & (weights > 0)]
        n = self.last[row] - self.first[row]
        term = np.repeat(np.arange(len(row)), n)
        groups = self.first[row][term] + np.arange(len(term)) - (np.cumsum(n) - n)[term]
        gain = weights[term] * self.impacts[groups]
        order = np.argsort(-gain, kind="stable")
        groups, term, gain = groups[order], term[order], gain[order]
        # what a document can still get after the first s groups: of each term the group that is next
        following = np.zeros(len(gain), np.int64)  # of the same term
        by_term = np.argsort(term, kind="stable")
        same = term[by_term][1:] == term[by_term][:-1]
        following[by_term[:-1][same]] = gain[by_term[1:][same]]
        heads = np.concatenate((gain[by_term[:1]], gain[by_term[1:][~same]])) if len(gain) else gain
        bound = int(heads.sum()) - np.cumsum(gain - following)
        upto = np.cumsum(self.end[groups] - self.begin[groups])
        scores, at, read, left, least = np.zeros(len(self.ids), np.int64), 0, FIRST, 0, floor
        while at < len(groups):
            to = min(len(groups), max(at + 1, int(np.searchsorted(upto, read, "right"))))
            docs, of = self._postings(groups[at:to])
            np.add.at(scores, docs, gain[at:to][of])
            at, read, left = to, read * 2, int(bound[to - 1])
            if len(scores) >= k:
                least = max(floor, int(np.partition(scores, -k)[-k]))
            if left < least:
                break
        possible = (scores > 0) & (scores + left >= least)
        if at < len(groups):  # complete the scores of those that can still be among the first
            docs, of = self._postings(groups[at:])
            mine = possible[docs]
            np.add.at(scores, docs[mine], gain[at:][of[mine]])
        docs = np.flatnonzero(possible)
        return docs, scores[docs]


def _search(batches: Iterator[pa.RecordBatch], asked: list[tuple[np.ndarray, np.ndarray]], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in all shards of a task. Rows come shard by shard, the shard's row of ids first."""
    release()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(asked)  # scores, ids, whether the id is known

    def settle(waiting: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(waiting)
        shard = Shard(table.column("ids").slice(0, 1).combine_chunks().flatten(), table.slice(1), width)
        for q, (terms_, weights) in enumerate(asked):
            scores, ids, known = best[q]
            docs, new = shard.best(terms_, weights, k, int(scores[k - 1]) if len(scores) == k else 0)
            if len(docs):
                scores, ids, known = np.concatenate((scores, new)), np.concatenate((ids, shard.ids[docs])), np.concatenate((known, shard.known[docs]))
                first = np.lexsort((ids, ~known, -scores))[:k]
                best[q] = scores[first], ids[first], known[first]

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False)).tolist()
        for at, to in zip([0, *begins], [*begins, batch.num_rows], strict=True):
            if at in begins and waiting:
                settle(waiting)
                waiting = []
            if to > at:
                waiting.append(batch.slice(at, to - at))
    if waiting:
        settle(waiting)
    n = [len(x[0]) for x in best]
    score, ids, known = (np.concatenate([x[i] for x in best]) if best else np.zeros(0) for i in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(ids.astype(np.int64), mask=~known.astype(bool)), pa.array(score.astype(np.int64))], ["query", "id", "score"])


def _passes(queries: DataFrame) -> Iterator[tuple[list, list[Counter]]]:
    """Names and terms of the queries, PASS_TERMS of all terms at a time."""
    names: list = []
    found: list[Counter] = []
    held = 0
    for name, text in queries.toLocalIterator(prefetchPartitions=False):
        w = Counter(terms(text.encode() if text else None))
        if not w:
            continue
        names.append(name)
        found.append(w)
        held += len(w)
        if held >= PASS_TERMS:
            yield names, found
            names, found, held = [], [], 0
    if names:
        yield names, found


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, query_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_col, rank, id, score): the k best documents of every query (row), all with a score above 0 if they are fewer.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), times its occurrences in the query. Equal scores rank by
    ascending id, null ids last. Null texts and texts without a term find nothing; an empty index or no query gives an
    empty result. Queries are looked up in passes of PASS_TERMS terms: a pass is what the driver and each task hold.
    """
    spark, found = queries.sparkSession, []
    slim = queries.select(F.col(query_col), F.col(text_col).cast("string"))
    kind = slim.schema.fields[0].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for names, counts in _passes(slim):
        vocabulary = sorted(set().union(*counts))
        number = {w: i for i, w in enumerate(vocabulary)}
        asked = F.broadcast(spark.createDataFrame([(w.decode(), i) for w, i in number.items()], "asked string, number long"))
        listed = index.postings.where("term is not null").join(asked, F.col("term") == F.col("asked"))
        df = dict(listed.groupBy("number").agg(F.sum("df").cast("long")).collect())
        weight = {i: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for i, n in df.items()}
        of = [[number[w] for w in c if number[w] in weight] for c in counts]
        terms_ = [(np.array(t, np.int64), np.array([weight[i] * c[vocabulary[i]] for i in t], np.int64)) for t, c in zip(of, counts, strict=True)]
        shared, width = spark.sparkContext.broadcast(terms_), len(vocabulary)
        columns = ["shard", "number", "impacts", "ends", "docs", "ids"]
        rows = listed.select(*columns).unionByName(index.postings.where("term is null").withColumn("number", F.lit(None).cast("long")).select(*columns))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("number"))
        hits = rows.mapInArrow(lambda it, shared=shared, width=width: _search(it, shared.value, width, k), "query long, id long, score long")
        salt = F.spark_partition_id() % max(1, math.isqrt(parts))
        first = _first(_first(hits.withColumn("salt", salt), ["query", "salt"], k).drop("rank", "salt"), ["query"], k)
        named = spark.createDataFrame(list(enumerate(names)), f"number long, name {kind}")
        found.append(first.join(F.broadcast(named), F.col("query") == F.col("number")).select(F.col("name").alias(query_col), "rank", "id", "score"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"`{query_col}` {kind}, rank int, id long, score long")
