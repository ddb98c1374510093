"""String helpers with the reference semantics of trimming, length and word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a script-language trim removes, and the same as a regex class body.
BLANKS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE = (
    r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def ltrim(col: Column) -> Column:
    return F.ltrim(col, F.lit(BLANKS))


def rtrim(col: Column) -> Column:
    return F.rtrim(col, F.lit(BLANKS))


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def squeeze(col: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return trim(F.regexp_replace(col, f"[{WHITESPACE}]+", " "))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units, so characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def ascii_words(col: Column) -> Column:
    r"""Text on which Java's ``\b`` and ``.`` mean ASCII word boundary and any but a line break.

    Java counts all letters as word characters, so every non-ASCII character becomes ``~``; the
    two Unicode line separators become newlines first.
    """
    return F.regexp_replace(F.translate(col, "\u2028\u2029", "\n\n"), r"[^\x00-\x7F]", "~")


def leading_int(col: Column) -> Column:
    """Integer at the start of a string, else null."""
    return F.regexp_extract(col, rf"^[{WHITESPACE}]*([+-]?\d+)", 1).try_cast("bigint")


def leading_float(col: Column) -> Column:
    """Decimal number at the start of a string, else null."""
    number = rf"^[{WHITESPACE}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.regexp_extract(col, number, 1).try_cast("double")


def first_non_empty(col: Column) -> Column:
    return F.when(col != "", col)
