"""Quality rules: cross-document line frequency (built-in expressions only).

Lines are normalised (lower-cased, digits 1-9 read as 0, blanks collapsed)
and hashed with their host.  For every (host, line) the *distinct* documents
are counted, copies of one text counting once, so that a page that was fetched
many times does not flag its own lines.  A line above the host's limit is
removed; a document that keeps too few of its words is depleted and rejected.

Shuffles carry hashes, never texts: one for (line, text) pairs, which partial
aggregation collapses for copies, one for the counts per line, one for the
flagged lines (an equi-join whose hot keys adaptive execution splits) and one
for each document's own flagged hashes.

Defined cases: a null or empty text has no words and no lines and fails the
base rule; rows without a host share one host of their own; a document
without removed lines is never depleted; repeated rows get one verdict each; the work on a
very long text of many lines is in proportion to its length (its rows are its lines);
an empty table gives an empty result.  Only ``doc_id``, ``text`` and the host
column are read, under names of this module's own, so extra columns never
clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import bind, free_name, text_or_empty, words

SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class LineLimits:
    """A line is removed in a host when it stands in more than ``min_docs`` of the host's
    distinct documents and in more than the square root of their number; a
    document is depleted when less than ``min_left`` of its words stay.

    The count decides in small hosts.  In large ones the limit grows, but far slower than the host: a
    host of 3 million documents loses the lines that 1,733 of them share.
    """

    min_docs: int = 20
    min_left: float = 0.3


def _n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more among the words ``w``.

    Where no window hash repeats the answer is 0.  Else (hash, position) pairs
    are sorted; equal neighbours mark the repeated windows, whose positions
    are then merged in order.
    """

    def repeated(h: Column) -> Column:
        return bind(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda g, j: F.coalesce(g["h"] == F.get(s, j + 1)["h"], F.lit(False))
                    | F.coalesce(g["h"] == F.get(s, j - 1)["h"], F.lit(False)),
                ),
                lambda g: g["i"],
            ),
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        )

    hashes = F.transform(
        F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda third, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), third),
    )
    return bind(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            bind(F.sort_array(repeated(h)), covered)
        ),
    )


def _word_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_repeat_words)."""
    return bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _n_repeat_words(w).alias("n_repeat_words"),
        ),
    )


def _base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def base_columns(text: Column) -> list[Column]:
    """counts (n_words, word_chars, n_repeat_words), n_symbols and n_dup_lines of a text."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    return [
        _word_counts(t).alias("counts"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def _lines(host: Column, text: Column) -> Column:
    """(i, h, w) of the lines with a word: number, hash of host and normalised line, words."""
    t = F.regexp_replace(F.lower(text_or_empty(text)), r"[1-9]", "0")
    lines = F.split(F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " "), "\n", -1)
    hashed = F.transform(
        lines,
        lambda x, i: bind(
            F.trim(x),
            lambda y: F.when(
                y != "",
                F.struct(
                    i.alias("i"), F.xxhash64(host, y).alias("h"), F.size(F.split(y, " ")).cast("long").alias("w")
                ),
            ),
        ),
    )
    return F.filter(hashed, lambda x: x.isNotNull())


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\x00"))


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def frequent_lines(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> DataFrame:
    """(h, n_docs): hashes of the (host, line) pairs above the host's limit."""
    rows = docs.select(
        _host(host).alias("host"),
        F.xxhash64(F.col("text")).alias("copy"),
        F.transform(_lines(_host(host), F.col("text")), lambda x: x["h"]).alias("lines"),
    )
    sizes = rows.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    per_line = (
        rows.select("host", "copy", F.explode_outer("lines").alias("h"))
        .filter(F.col("h").isNotNull())
        .distinct()
        .groupBy("host", "h")
        .agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > limits.min_docs)
    )
    return per_line.join(sizes, "host").filter(F.col("n_docs") * F.col("n_docs") > F.col("host_docs")).select("h", "n_docs")


def _removed(docs: DataFrame, limits: LineLimits, host: str) -> DataFrame:
    """(row_key, removed): the numbers and words of each document's frequent lines."""
    own = docs.select(
        _row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        F.explode_outer(_lines(_host(host), F.col("text"))).alias("x"),
    ).select("row_key", "x.h", F.struct("x.i", "x.w").alias("line"))
    hit = own.filter(F.col("h").isNotNull()).join(frequent_lines(docs, limits, host).select("h"), "h")
    return hit.groupBy("row_key").agg(F.collect_set("line").alias("removed"))


def line_verdicts(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> DataFrame:
    """One row per document: base columns, words removed with frequent lines, verdict."""
    base = docs.select(
        "doc_id",
        _row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        *base_columns(F.col("text")),
    )
    n_gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["w"])
    n_words, left = F.col("counts.n_words"), F.col("counts.n_words") - F.col("n_removed_words")
    return (
        base.join(_removed(docs, limits, host), "row_key", "left")
        .withColumn("n_removed_words", F.coalesce(n_gone, F.lit(0).cast("long")))
        .withColumn("base_failed", _base_failed(n_words, F.col("counts.n_repeat_words")))
        .select(
            "doc_id",
            "counts.n_words",
            "counts.word_chars",
            "n_symbols",
            "n_dup_lines",
            "counts.n_repeat_words",
            "base_failed",
            "n_removed_words",
            (~F.col("base_failed") & (left >= limits.min_left * n_words)).alias("kept"),
        )
    )


def clean_documents(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> DataFrame:
    """The kept documents, all columns, with frequent lines taken out of ``text``.

    ``n_chars``, where there is one, follows the new text.
    """
    key, removed = free_name(docs, "row_key"), free_name(docs, "removed")
    hits = _removed(docs, limits, host).select(F.col("row_key").alias(key), F.col("removed").alias(removed))
    t = text_or_empty(F.col("text"))
    passed = docs.withColumn(key, _row_key(F.col("doc_id"), F.col("text"))).filter(
        bind(_word_counts(t), lambda c: ~_base_failed(c["n_words"], c["n_repeat_words"]))
    )
    # the numbers of the lines that stay, by one hash set per text
    gone = F.transform(removed, lambda x: x["i"])
    left = bind(
        F.split(t, "\n", -1),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"
        ),
    )
    joined = passed.join(hits, key, "left").withColumn(
        removed, F.when(F.col(removed).isNull(), F.col("text")).otherwise(left)
    )
    enough = F.size(words(F.col(removed))) >= limits.min_left * F.size(words(F.col("text")))
    out = {"text": F.col(removed)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(F.col(removed)).cast(docs.schema["n_chars"].dataType)
    return joined.filter(enough).select(*[(out[c].alias(c) if c in out else F.col(f"`{c}`")) for c in docs.columns])
