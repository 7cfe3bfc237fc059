"""Four-line records: parsing, checks, inference over files, and the way back to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from readlake.functions.columns import UNKNOWN, has_illegal_base, header_signature, second_id


def parse(lines: DataFrame, keys: list[str], number: str = "ln", line: str = "line") -> DataFrame:
    """(keys, rec, header, seq, plus, qual, problem) from numbered lines (from 0): four lines are a record.

    problem is null for a good record, else why it is bad: `truncated`, `no @`, `no +`. header is without its @.
    """
    of = lambda k: F.max(F.when(F.col(number) % 4 == k, F.col(line)))
    g = lines.groupBy(*keys, F.floor(F.col(number) / 4).cast("long").alias("rec")).agg(of(0).alias("__h"), of(1).alias("seq"), of(2).alias("plus"), of(3).alias("qual"), F.count("*").alias("__n"))
    at = F.substring("__h", 1, 1) == "@"
    plus = F.substring("plus", 1, 1) == "+"
    problem = F.when(F.col("__n") < 4, "truncated").when(~at, "no @").when(~plus, "no +")
    return g.select(*keys, "rec", F.when(at, F.expr("substring(__h, 2)")).otherwise(F.col("__h")).alias("header"), "seq", "plus", "qual", problem.alias("problem"))


def checked(records: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """All records (PERMISSIVE), the good ones (DROPMALFORMED), or an error at the first bad one (FAILFAST)."""
    if mode == "PERMISSIVE":
        return records
    if mode == "DROPMALFORMED":
        return records.where(F.col("problem").isNull()).drop("problem")
    stop = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("bad record "), F.col("rec").cast("string"), F.lit(": "), F.col("problem"))).cast("string"))
    return records.withColumn("seq", F.coalesce(stop, "seq")).drop("problem")


#: Fixed value: delimiters that a header may have at most.
DELIMITERS = 64


def reasons() -> dict[str, Column]:
    """What can be wrong with a record (header, seq, plus, qual, problem), each a condition that is never null."""
    header, seq, plus, qual = map(F.col, ("header", "seq", "plus", "qual"))
    named = plus.startswith("+")
    spellings = F.size(F.array_distinct(F.regexp_extract_all(seq, F.lit(f"({UNKNOWN})"), F.lit(1))))
    found = {
        "truncated": F.col("problem") == "truncated",
        "no @": F.col("problem") == "no @",
        "no +": ~named,
        "odd second id": named & second_id(plus) & (F.substring(plus, F.lit(2), F.length(plus)) != header),
        "illegal base": has_illegal_base(seq),
        "mixed unknowns": spellings > 1,
        "length mismatch": F.length(seq) != F.length(qual),
        "many delimiters": F.length(header_signature(header)) > DELIMITERS,
    }
    return {name: F.coalesce(c, F.lit(False)) for name, c in found.items()}


def with_problems(records: DataFrame, observation: Observation | None = None) -> DataFrame:
    """records with `problems`, all that is wrong with each, in one pass; nothing that a null stands in the way of telling.

    observation: counts the records (`records`), those with any problem (`bad`) and each reason, as the rows pass by.
    """
    of = reasons()
    d = records.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in of.items()])))
    if observation is None:
        return d
    has = lambda name: F.count_if(F.array_contains("problems", name)).alias(name)
    return d.observe(observation, F.count("*").alias("records"), F.count_if(F.size("problems") > 0).alias("bad"), *map(has, of))


def problem_counts(records: DataFrame) -> DataFrame:
    """(reason, n): how many records have each reason; `none` those without any. A record counts once for each of its reasons."""
    d = with_problems(records).select(F.explode(F.when(F.size("problems") > 0, F.col("problems")).otherwise(F.array(F.lit("none")))).alias("reason"))
    return d.groupBy("reason").agg(F.count("*").alias("n"))


def limited(records: DataFrame, most: int) -> DataFrame:
    """records with `problems`, or an error if more than `most` have any; they are counted in a pass of their own first."""
    bad = with_problems(records).agg(F.count_if(F.size("problems") > 0)).first()[0]
    if bad > most:
        counts = ", ".join(f"{r.reason} {r.n}" for r in problem_counts(records).where("reason <> 'none'").orderBy(F.desc("n"), "reason").collect())
        raise ValueError(f"{bad} bad records, more than {most}: {counts}")
    return with_problems(records)


def decisive(seq: Column) -> Column:
    """Whether a sequence is in color space: whether 0-3 comes before any base letter after the first character; null if neither does."""
    first = F.regexp_extract(F.substring(seq, F.lit(2), F.length(seq)), "[0-3ACGTacgt]", 0)
    return F.when(first != "", first.rlike("[0-3]"))


def inferred(records: DataFrame, keys: list[str], order: str = "rec") -> DataFrame:
    """(keys, llen, second_id, color_space): what a file's records tell.

    llen and second_id are those of the first record; a file is in color space if its first record that decides holds 0-3
    before any base letter after the first character.
    """
    flag = decisive(F.col("seq"))
    g = records.groupBy(*keys).agg(
        F.min_by(F.length("seq"), order).alias("__l"), F.min_by(second_id(F.col("plus")), order).alias("__s"), F.min_by(flag, F.when(flag.isNotNull(), F.col(order))).alias("__c")
    )
    return g.select(*keys, F.col("__l").cast("long").alias("llen"), F.col("__s").alias("second_id"), F.coalesce("__c", F.lit(False)).alias("color_space"))


def record_text(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """A record's four lines."""
    return F.concat_ws("\n", F.concat(F.lit("@"), header), seq, plus, qual)


def split_by(records: DataFrame, large: Column) -> tuple[DataFrame, DataFrame]:
    """(regular, oversized) rows."""
    flag = F.coalesce(large, F.lit(False))
    return records.where(~flag), records.where(flag)


def merged(regular: DataFrame, large: DataFrame, order: str = "rec") -> DataFrame:
    """Both parts of `split_by` in one, in order again: parts of the result follow each other, rows are sorted in each."""
    return regular.unionByName(large).repartitionByRange(order).sortWithinPartitions(order)
