"""Column helpers shared by the text operators (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE_CLASS = r"[\x20\x09-\x0D]"


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` once.

    A lambda that names an expression evaluates it once per element; binding
    it as the element of a one-item array evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def bounded_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``keys``.

    Rows per slice of the hash range are counted first (at most 65,536 numbers
    come to the driver), so that the sort only ever sees about ``n`` rows, however
    many partitions the table has.
    """
    h = F.xxhash64(*keys)
    at = F.shiftright(h, 48)
    counts = sorted((r[0], r[1]) for r in df.groupBy(at.alias("at")).count().collect())
    total, last = 0, -(1 << 15)
    for last, k in counts:
        total += k
        if total >= n:
            break
    return df.filter(at <= last).orderBy(h).limit(n)
