"""Header column: tokens, shapes, types, changes and deltas against the record before.

Caches start anew with every block of records, so blocks can be read and written independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions.columns import header_signature, header_tokens
from readlake.operators.ordered import BLOCK, filled, previous


def tokens(df: DataFrame, header: str = "header", order: str = "rec") -> DataFrame:
    """(order, slot, token)."""
    return df.select(order, F.posexplode(header_tokens(F.col(header))).alias("slot", "token"))


def shape_changes(df: DataFrame, header: str = "header", order: str = "rec") -> DataFrame:
    """(order, signature, header) of records whose delimiters differ from the record before; those are kept verbatim."""
    d = previous(df.select(order, F.col(header).alias("header"), header_signature(F.col(header)).alias("signature")), F.col("signature"), "__prev", order)
    return d.where(F.col("__prev").isNotNull() & ~F.col("__prev.v").eqNullSafe(F.col("signature"))).select(order, "signature", "header")


#: Tokens of a word of the bitmap.
WORD = 32


def change_bitmap(df: DataFrame, header: str = "header", order: str = "rec") -> DataFrame:
    """(order, word, changed): bit i of a word is set if token WORD * word + i differs from the record before.

    The first record and other shapes have all set.
    """
    d = previous(df.select(order, header_tokens(F.col(header)).alias("t")), F.col("t"), "__prev", order)
    changed = F.filter(F.transform("t", lambda x, i: F.when(~F.get(F.col("__prev.v"), i).eqNullSafe(x), i)), lambda i: i.isNotNull())
    words = d.select(order, F.posexplode(_words(changed, F.size("t"))).alias("word", "changed"))
    return words.select(order, "word", "changed")


def _words(slots: Column, size: Column) -> Column:
    """Slot numbers as bits of an array of words."""
    of = lambda w: F.aggregate(F.filter(slots, lambda i: F.floor(i / WORD) == w), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (i % WORD).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.ceil(size / WORD).cast("int") - 1), of)


def own_kind(token: Column) -> Column:
    """Kind of a token that stands alone."""
    digits = token.rlike("^(0|0?[1-9][0-9]{0,17})$")
    hexed = token.rlike("^0?([1-9a-f][0-9a-f]{0,14}|[1-9A-F][0-9A-F]{0,14})$")
    return F.when(digits, "dec").when(hexed, "hex").otherwise("str")


def _number(token: Column, kind: Column) -> Column:
    return F.when(kind == "dec", token.cast("long")).when(kind == "hex", F.conv(F.when(kind == "hex", token), 16, 10).cast("long"))


def typed(df: DataFrame, header: str = "header", order: str = "rec", block: int = BLOCK) -> DataFrame:
    """(order, block, slot, session, fresh, token, kind, zero, number): kind dec, hex or str; zero: one leading zero.

    Digits that follow a token with a-f digits in their slot are hexadecimal too, until a string token or another shape.
    Empty tokens, tokens from 00 on, mixed case, over 18 decimal or 15 hexadecimal digits are strings. `number` is the value.
    fresh: the record has another shape than the one before, or is the first.
    """
    d = previous(df.select(order, F.col(header).alias("h"), header_signature(F.col(header)).alias("sig")), F.col("sig"), "__prev", order)
    d = d.withColumn("fresh", F.coalesce(~F.col("__prev.v").eqNullSafe(F.col("sig")), F.lit(True)))
    t = d.select(order, "fresh", F.posexplode(header_tokens(F.col("h"))).alias("slot", "token")).withColumn("block", F.floor(F.col(order) / block))
    token = F.col("token")
    t = t.withColumn("own", own_kind(token))
    w = Window.partitionBy("block", "slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("session", F.sum(F.when(F.col("fresh") | (F.col("own") == "str"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy("block", "slot", "session").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after_hex = F.coalesce(F.max(F.col("own") == "hex").over(inside), F.lit(False)) & (F.length(token) <= 15)
    t = t.withColumn("kind", F.when((F.col("own") == "dec") & after_hex, "hex").otherwise(F.col("own")))
    zero = (F.col("kind") != "str") & (F.length(token) > 1) & token.startswith("0")
    return t.select(order, "block", "slot", "session", "fresh", "token", "kind", zero.alias("zero"), _number(token, F.col("kind")).alias("number"))


def _against_last(types: DataFrame, order: str) -> DataFrame:
    """types with `before`, the slot's token in the record before, and `cached`, the last number of the slot's session, else 0."""
    w = Window.partitionBy("block", "slot").orderBy(order)
    cached = F.last(F.when(F.col("kind") != "str", F.col("number")), ignorenulls=True).over(Window.partitionBy("block", "slot", "session").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return types.withColumn("before", F.lag("token").over(w)).withColumn("cached", F.coalesce(cached, F.lit(0).cast("long")))


def deltas(types: DataFrame, order: str = "rec") -> DataFrame:
    """(order, slot, kind, less, delta) of changed number tokens: distance to the last number of the slot's session, else to 0."""
    d = _against_last(types, order).where((F.col("kind") != "str") & ~F.col("before").eqNullSafe(F.col("token")))
    return d.select(order, "slot", "kind", (F.col("number") < F.col("cached")).alias("less"), F.abs(F.col("number") - F.col("cached")).alias("delta"))


def encoded(df: DataFrame, header: str = "header", order: str = "rec", block: int = BLOCK) -> DataFrame:
    """(order, header, changed, entries): what the headers of whole numbers of records can be rebuilt from, row by row.

    A record that is the first of its block, or of another shape than the one before, keeps its header. All others have
    `changed`, the words of their bitmap, and for each bit that is set an entry (kind, zero, caps, less, delta, text): a
    number is its distance to the last number of its slot, any other token its text. A null header has nothing.
    """
    d = _against_last(typed(df, header, order, block), order)
    is_text = F.col("kind") == "str"
    entry = F.struct(
        "slot", "kind", "zero", F.col("token").rlike("[A-F]").alias("caps"), (F.col("number") < F.col("cached")).alias("less"), F.abs(F.col("number") - F.col("cached")).alias("delta"), F.when(is_text, F.col("token")).alias("text")
    )
    changed = F.when(~F.col("before").eqNullSafe(F.col("token")), entry)
    rows = d.groupBy(order, "block").agg(F.max("fresh").alias("fresh"), F.max("slot").alias("last"), F.sort_array(F.collect_list(changed)).alias("e"))
    firsts = rows.groupBy("block").agg(F.min(order).alias("first"))
    rows = rows.join(firsts, "block").where(~F.col("fresh") & (F.col(order) != F.col("first")))
    kept = rows.select(order, _words(F.transform("e", lambda x: x["slot"]), F.col("last") + 1).alias("changed"), F.transform("e", lambda x: x.dropFields("slot")).alias("entries"))
    out = df.select(order, F.col(header).alias("header")).join(kept, order, "left")
    return out.withColumn("header", F.when(F.col("changed").isNull(), F.col("header")))


def rebuilt(kept: DataFrame, order: str = "rec", block: int = BLOCK) -> DataFrame:
    """(order, header) from what `encoded` keeps, and nothing else.

    A token is the last one that its slot was given: numbers are running sums of their distances since the last string or
    whole header of the slot. All windows lie inside a block and slot.
    """
    k = kept.withColumn("block", F.floor(F.col(order) / block))
    whole = k.where(F.col("header").isNotNull()).select(order, "block", F.posexplode(header_tokens(F.col("header"))).alias("slot", "text"))
    whole = whole.withColumn("kind", own_kind(F.col("text"))).withColumn("step", _number(F.col("text"), F.col("kind")))
    bits = F.filter(F.sequence(F.lit(0), F.size("changed") * WORD - 1), lambda i: F.call_function("shiftright", F.get(F.col("changed"), F.floor(i / WORD).cast("int")), (i % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1)
    pairs = k.where(F.col("changed").isNotNull()).select(order, "block", F.explode(F.arrays_zip(bits.alias("slot"), F.col("entries").alias("e"))).alias("x")).select(order, "block", "x.slot", "x.e.*")
    pairs = pairs.withColumn("step", F.when(F.col("less"), -F.col("delta")).otherwise(F.col("delta")))
    rows = whole.withColumn("fresh", F.lit(True)).unionByName(pairs.drop("less", "delta").withColumn("fresh", F.lit(False)), allowMissingColumns=True)
    upto = lambda *keys: Window.partitionBy("block", "slot", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("session", F.sum(F.when(F.col("fresh") | (F.col("kind") == "str"), 1).otherwise(0)).over(upto()))
    number = F.sum("step").over(upto("session"))
    rows = rows.withColumn("number", number)
    digits = F.when(F.col("kind") == "dec", F.col("number").cast("string")).when(F.col("caps"), F.hex("number")).otherwise(F.lower(F.hex("number")))
    token = F.when(F.col("fresh") | (F.col("kind") == "str"), F.col("text")).otherwise(F.concat(F.when(F.col("zero"), "0").otherwise(""), digits))
    given = rows.select(order, "slot", token.alias("given"))
    shaped = k.where(F.col("header").isNotNull() | F.col("changed").isNotNull()).select(order, "block", F.when(F.col("header").isNotNull(), header_signature(F.col("header"))).alias("own"))
    shaped = filled(shaped, F.col("own"), "sig", order).select(order, "block", "sig")
    grid = shaped.select(order, "block", "sig", F.explode(F.sequence(F.lit(0), F.length("sig"))).alias("slot")).join(given, [order, "slot"], "left")
    grid = grid.withColumn("token", F.last("given", ignorenulls=True).over(upto()))
    mark = F.expr("substring(sig, slot + 1, 1)")
    headers = grid.groupBy(order).agg(F.sort_array(F.collect_list(F.struct("slot", F.concat("token", mark).alias("x")))).alias("parts"))
    out = headers.select(F.col(order).alias("__of"), F.array_join(F.transform("parts", lambda p: p["x"]), "").alias("header"))
    return kept.select(order).join(out, F.col(order) == F.col("__of"), "left").select(order, "header")
