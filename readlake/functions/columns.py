"""Column expressions: base and quality codes, header parts, variable-length integer sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the four bases and of an unknown base, and what a sequence may hold.
SPELLINGS, CODES = "0Aa1Cc2Gg3Tt", "000111222333"
UNKNOWN, ILLEGAL = "[Nn.]", "[^0-3ACGTacgt.Nn]"
#: First quality byte, first escaped quality, quality assumed where there is none.
QUALITY_ZERO, ESCAPE, DEFAULT_QUALITY = 33, 63, 7


def base_codes(seq: Column) -> Column:
    """Codes 0 to 3 as text; unknown bases stay `N`, anything else stays as it is."""
    return F.translate(F.regexp_replace(seq, UNKNOWN, "N"), SPELLINGS, CODES)


def imputed(codes: Column) -> Column:
    """Unknown bases coded as 0."""
    return F.translate(codes, "N", "0")


def decoded_bases(codes: Column, color: bool = False) -> Column:
    return codes if color else F.translate(codes, "0123", "ACGT")


def has_illegal_base(seq: Column) -> Column:
    return seq.rlike(ILLEGAL)


def quality(char: Column) -> Column:
    """Quality of one character of a quality line."""
    return F.ascii(char) - QUALITY_ZERO


def quality_symbol(q: Column) -> Column:
    """The model's symbol: qualities from ESCAPE on share one."""
    return F.least(q, F.lit(ESCAPE))


def header_tokens(header: Column) -> Column:
    """Runs of ASCII letters and digits; every other character ends a token, empty tokens are kept."""
    return F.split(header, "[^0-9A-Za-z]")


def header_signature(header: Column) -> Column:
    return F.regexp_replace(header, "[0-9A-Za-z]", "")


def varint_length(n: Column) -> Column:
    """Symbols of an unsigned number: 1 up to 0x7f, 2 below 0x7ffe, 6 below 2^32, else 10."""
    return F.when(n <= 0x7F, 1).when(n < 0x7FFE, 2).when(n < 1 << 32, 6).otherwise(10)


def signed_varint_length(n: Column) -> Column:
    """Symbols of a signed number: 1 from -125 to 127, 3 for 16 bits, 5 for 32 bits, else 9."""
    return F.when(n.between(-125, 127), 1).when(n.between(-(1 << 15), (1 << 15) - 1), 3).when(n.between(-(1 << 31), (1 << 31) - 1), 5).otherwise(9)


def second_id(plus: Column) -> Column:
    """Whether the third line repeats a header."""
    return F.trim(F.substring(plus, 2, 1 << 30)) != ""


def oversized(header: Column, seq: Column, qual: Column, header_limit: int = 8191, line_limit: int = 65535) -> Column:
    return (F.length(header) >= header_limit) | (F.length(seq) >= line_limit) | (F.length(qual) >= line_limit)


def file_type(head: Column) -> Column:
    """What the first characters of a file tell: archive, fastq, empty or other."""
    return F.when(F.coalesce(F.length(head), F.lit(0)) == 0, "empty").when(head.startswith("whoami="), "archive").when(head.startswith("@"), "fastq").otherwise("other")
