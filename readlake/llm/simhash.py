"""SimHash fingerprints and their search by permuted block tables. DataFrame functions only.

A text's terms are its pairs of neighbouring words, weighted by their length, each as often as it occurs. Every term's
64-bit hash votes with its weight, for or against each bit. Two bits share one 64-bit sum (32 bits each), so 32 sums gather all 64 votes in the
aggregation's generated code.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.common import free_name, hinted, written

BITS = 64
LANES = 0x0000000100000001
#: Quantiles of the id that carry the order's buckets, rows of a bucket, and buckets at most.
KNOTS, BUCKET_ROWS, MOST_BUCKETS = 64, 2_000, 1 << 20


def terms(text: Column) -> Column:
    """Array of (h, w): the hash and weight of each pair of neighbouring words; a single word is a term itself; no word: empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    term = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), (F.length(a) + F.length(b)).cast("long").alias("w"))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), term)
    # bound once: the array is built by the inner transform, then used by the outer
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(F.transform(w, lambda x: term(x, F.lit(""))))))


def votes() -> list[Column]:
    """The 32 paired sums over exploded terms `t`, and the total weight."""
    h, w = F.col("t.h"), F.col("t.w")
    paired = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(LANES)) * w).alias(f"s{i}") for i in range(32)]
    return [*paired, F.sum(w).alias("total")]


def verdict() -> Column:
    """The fingerprint of the sums: a bit is 1 if over half of the weight voted for it; no terms: 0."""
    total, bits = F.col("total"), F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(F.col(f"s{i}"), 32)
        for b, s in ((i, low), (i + 32, high)):
            mask = 1 << b if b < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(s * 2 > total, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fp, one row for each distinct value of keys; null and empty texts have 0.

    The sums need texts of under 2^30 code points each. Equal texts have equal fingerprints.
    """
    exploded = texts.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("t"))
    return exploded.groupBy(*keys).agg(*votes()).select(*keys, verdict().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def permuted_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the blocks that lead each permuted table: within the radius some table's leading blocks all agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(masks[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def blocks_for(queries: int, radius: int) -> int:
    """The fewest blocks at which about one query at most shares a permuted table's leading bits with a random fingerprint."""
    blocks = radius + 1
    while queries >> (BITS * (blocks - radius) // blocks) and blocks < radius + 4:
        blocks += 1
    return blocks


def within(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(q, fp, distance): for each distinct query fingerprint q all distinct prints within the radius.

    Both are joined on every permuted table's leading bits; a pair is kept only from the first table on which it agrees,
    so no pair is found twice. Few queries are broadcast (their rows are counted), many are dealt by the leading bits.
    Null fingerprints find nothing; either side may be empty or hold repeats.
    """
    one = lambda df, c: df.where(F.col("fp").isNotNull()).select(F.col("fp").alias(c)).distinct()
    asked = one(queries, "q")
    n = asked.count()
    masks = permuted_tables(radius, blocks or blocks_for(n, radius))
    keyed = lambda df, c: df.select(c, F.posexplode(F.array(*[F.col(c).bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))
    pairs = keyed(one(prints, "fp"), "fp").join(hinted(keyed(asked, "q"), n * len(masks)), ["t", "key"])
    apart = F.col("q").bitwiseXOR(F.col("fp"))
    distance = F.bit_count(apart)
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return pairs.where((distance <= radius) & (F.col("t") == first)).select("q", "fp", distance.alias("distance"))


def neighbours(rows: DataFrame, asked: Column, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """rows (a written table with fp) and near: of rows where `asked` holds, how many other rows lie within the radius; else null.

    Equal fingerprints are counted once and weighed by their rows, so no pair of copies is listed. rows may have any other
    columns but near.
    """
    counted = rows.groupBy("fp").agg(F.count("*").alias("n"))
    found = within(rows.where(asked), rows, radius, blocks).join(counted, "fp").groupBy("q").agg(F.sum("n").alias("found"))
    found = written(found, "neighbours")
    q = free_name(rows, "q")
    out = rows.join(hinted(found.select(F.col("q").alias(q), F.col("found").alias(q + "_n")), found.count()), F.col("fp") == F.col(q), "left")
    return out.select(*rows.columns, F.when(asked, F.coalesce(q + "_n", F.lit(1)) - 1).cast("long").alias("near"))


def _bucket(ids: DataFrame, rows: int, id_col: str) -> tuple[Column, int]:
    """A non-decreasing map of the id to about equal buckets: a piecewise linear distribution through a few quantiles."""
    parts = ids.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = max(1, min(MOST_BUCKETS, max(int(parts), rows // BUCKET_ROWS)))
    knots = ids.agg(F.percentile_approx(id_col, [i / KNOTS for i in range(KNOTS + 1)], 10_000).alias("k")).first()["k"] or [0]
    knots = sorted(set(knots))
    c = F.col(id_col)

    def part(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            a, b = knots[lo], knots[min(lo + 1, len(knots) - 1)]
            share = F.least(F.lit(1.0), (c - a).cast("double") / max(1, b - a))
            return (F.lit(float(lo)) + F.greatest(F.lit(0.0), share)) / max(1, len(knots) - 1)
        mid = (lo + hi) // 2
        return F.when(c < knots[mid], part(lo, mid)).otherwise(part(mid, hi))

    at = part(0, max(1, len(knots) - 1))
    return F.when(c.isNull(), 0).otherwise(F.least(F.lit(n - 1), F.floor(at * n).cast("int"))), n


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, rn, ghost, id, text, next_text) in ascending id order; the last row's next is the first row.

    Order within equal ids: by text hash; null ids come first. Every bucket of the order also gets a copy of the next
    bucket's first row (ghost), so each next text is found within its bucket. No rows: none.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucket, buckets = _bucket(slim, slim.count(), "id")
    placed = slim.select(bucket.alias("bucket"), "id", "text", F.lit(0).alias("ghost"))
    # the first row of each bucket, and the non-empty bucket before it: as many rows as buckets
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("h"))).alias("f"))
    order = Window.orderBy("bucket")
    back = firsts.select("bucket", "f", F.lag("bucket").over(order).alias("before"), F.max("bucket").over(Window.partitionBy(F.lit(0))).alias("last"))
    back = back.select(F.col("bucket").alias("of"), "f", F.coalesce("before", "last").alias("to"))
    ghosts = placed.join(hinted(back, buckets), (F.col("bucket") == F.col("of")) & (F.coalesce(F.col("id"), F.lit(-(1 << 63))) == F.col("f.i")) & (F.xxhash64("text") == F.col("f.h")))
    ghosts = ghosts.select(F.col("to").alias("bucket"), "id", "text", F.lit(1).alias("ghost"))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return placed.unionByName(ghosts).select("bucket", F.row_number().over(w).alias("rn"), "ghost", "id", "text", F.lead("text").over(w).alias("next_text"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half replaced by the next document's beginning).

    Columns id, n_chars, edited_sha256, fp, edited_fp, next_fp. Null texts count as empty. Repeated rows stay.
    """
    rows = with_next(docs, id_col, text_col)
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(coalesce(next_text, ''), 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("bucket", "rn", "ghost", "id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["bucket", "rn", "ghost", "id", "n_chars", "sha"]
    two = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v")).select(*keys, "v.which", "v.text")
    prints = fingerprints(two, [*keys, "which"])
    one = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    one = one.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn")))
    return one.where("ghost = 0").select("id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")
