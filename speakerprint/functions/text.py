"""Native text expressions with explicit, engine-independent white space rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.functions.vectors import as_col

# White space trimmed and split on (ASCII only, so that engines agree).
SPACE = " \t\n\r"
SPLIT = "[ \\t\\n\\r]+"
# White space that a script's trim removes, the byte order mark included.
SCRIPT_SPACE = " \t\n\r\x0b\x0c\xa0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def words(text: str | Column) -> Column:
    """Words of a text, empty strings removed."""
    return F.filter(F.split(as_col(text), SPLIT), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    return F.size(words(text)).cast("bigint")


def strip(text: str | Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(as_col(text), F.lit(SPACE))


def script_strip(text: str | Column) -> Column:
    """Trim what a script's trim removes on both sides."""
    return F.btrim(as_col(text), F.lit(SCRIPT_SPACE))


def unfence(text: str | Column, any_case: bool = False) -> Column:
    """Remove Markdown code fences (``` or ```json) and trim."""
    pattern = "```json|```"
    return script_strip(F.regexp_replace(as_col(text), ("(?i)" if any_case else "") + pattern, ""))


def explode_items(df: DataFrame, keep: Sequence[str], array: str, name: str) -> DataFrame:
    """One row per element of an array column, empty arrays giving none.

    An inner ``explode`` would make Spark derive a size filter and compute the array a second
    time below the projection; the outer form with a null check does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def runs(word_array: str, k: int) -> Column:
    """The k-word run starting at each word of a word array column; null where fewer words follow."""
    out = w = F.col(word_array)
    for j in range(2, k + 1):
        out = F.zip_with(out, F.slice(w, j, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def run_hashes(word_array: str, k: int) -> Column:
    """128-bit hashes ``(h1, h2)`` of all k-word runs, built from one hash per word."""
    w = F.col(word_array)
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1)))
    hashed = F.transform(
        starts,
        lambda i: F.struct(F.xxhash64(F.slice(w, i, k)).alias("h1"), F.xxhash64(F.slice(w, i, k), F.lit(1)).alias("h2")),
    )
    return F.coalesce(hashed, F.array().cast("array<struct<h1:bigint,h2:bigint>>"))
