"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only.

A list holds canonical URLs (host and path, one string) and rules (a host that fits its subdomains, and a path prefix).
Both are keys of one Bloom filter. Its blocks are eight 64-bit words; a key sets one bit in each word of one block. Every
distinct (host, path) is probed with the few keys that could fit it, the survivors meet the list in a hash join on the whole
key, so a false positive of the filter never reaches a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import hinted, written

#: Words of a block, and bits of the filter for each listed key.
WORDS, BITS_PER_KEY = 8, 16
#: Blocks that may be broadcast: 72 bytes each, so 9 MB at most.
BROADCAST_BLOCKS = 1 << 17
#: (label counts, path length) pairs of one rule list.
MOST_SHAPES = 512


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, w0..w7): the filter's blocks that have a bit set."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*[F.bit_or(_bit(F.col(key), j)).alias(f"w{j}") for j in range(WORDS)])


def possible(probes: DataFrame, bloom: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """probes whose key may be in the filter: all that are, and few others."""
    asked = probes.withColumn("block", _block(F.col(key), blocks))
    hit = asked.join(hinted(bloom, blocks, BROADCAST_BLOCKS), "block")
    for j in range(WORDS):
        hit = hit.where(F.col(f"w{j}").bitwiseAND(_bit(F.col(key), j)) != 0)
    return hit.select(*probes.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (rule, host, path, verdict); the longest rule that fits gives rule and verdict (ties: the least rule string).
    listed: (url), canonical: host and path; without a rule a listed URL is blocked, any other is allowed. Null urls and
    urls without :// have empty host and path, which no rule fits. Repeated pages stay. Lists may hold nulls (ignored),
    repeats, and may be empty. Columns of pages named host, path, rule or verdict are replaced; others stay.
    """
    seen = pages.withColumn("__host", host(F.col(url_col))).withColumn("__path", path(F.col(url_col)))
    rules = rules.where("rule is not null and host is not null and path is not null").select("rule", lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().limit(MOST_SHAPES + 1).collect()
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"rules of more than {MOST_SHAPES} shapes (label count, path length)")
    entries = rules.select(F.concat(F.lit("r"), "host", F.lit(" "), "path").alias("key"), F.struct((-F.length("rule")).alias("n"), "rule", "verdict").alias("found"))
    entries = entries.unionByName(listed.where("url is not null").select(F.concat(F.lit("u"), F.col("url")).alias("key"), F.struct(F.lit(1).alias("n"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")).alias("found")))
    entries = written(entries.groupBy("key").agg(F.min("found").alias("found")), "url-list")
    blocks = max(1, -(-entries.count() * BITS_PER_KEY // (64 * WORDS)))
    bloom = written(bloom_blocks(entries, blocks), "url-bloom")

    urls = seen.select("__host", "__path").distinct()
    labels, chars = F.size(F.split("__host", r"\.")), F.length("__path")
    keys = [F.concat(F.lit("u"), "__host", "__path")]
    for s in shapes:
        fits = (labels >= s["labels"]) & (chars >= s["chars"])
        keys.append(F.when(fits, F.concat(F.lit("r"), F.substring_index("__host", ".", -s["labels"]), F.lit(" "), F.substring("__path", 1, s["chars"]))))
    probes = urls.select("__host", "__path", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    exact = possible(probes, bloom, blocks).join(entries, "key")
    best = exact.groupBy("__host", "__path").agg(F.min("found").alias("__found"))
    out = seen.join(best, ["__host", "__path"], "left")
    return out.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__found.rule"), "verdict": F.coalesce("__found.verdict", F.lit("allow"))}).select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict"
    )
