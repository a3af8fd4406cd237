"""URL filters by a temporal list join.

A dated list log (list_name, pattern, action add/remove, day) becomes validity intervals:
an entry holds from the day it is added until the day it is removed.  Every
capture is then judged against the entries that were active when it was
fetched, not against today's list.

A pattern is a host (it covers all hosts below it) or a host with a path
prefix of whole segments.  A capture's candidates are its host, every parent of
it, and every prefix of its path; there are only as many as the URL has parts.
The join is an equi-join on the pattern; all intervals of one pattern form one
sorted array, so a capture meets one row per pattern and no interval pairs
arise.  List changes are folded per (list, pattern, day) before anything is
ordered, so a pattern that a list repeats in every edition has at most one row
per day.  The list side is broadcast where its row count is within the checked
bound; beyond it the join shuffles, and a host with a third of all captures
is split by adaptive execution (the list side has one row per pattern).

Defined cases: null or malformed URLs and captures without a time match
nothing and are kept; an interval includes its first day and excludes its last;
several changes on one day: the removal wins; adds without a removal in
between continue one interval; a removal without an add does nothing; repeated
captures give one row each; either table may be empty.  A very long URL has as many
candidates as the longest listed pattern has host labels and path segments,
not as many as the URL has: longer candidates could match nothing.  Only the
columns named here are read, further ones do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_PATTERNS = 500_000
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(/[^?#]*)?"


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to): days on which an entry is active; valid_to may be null."""
    per_day = (
        entries.filter("pattern is not null and day is not null and action in ('add', 'remove')")
        .groupBy("list_name", F.lower("pattern").alias("pattern"), "day")
        .agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    )
    order = Window.partitionBy("list_name", "pattern").orderBy("day")
    changes = per_day.withColumn("was", F.lag("on", 1, 0).over(order)).filter("on <> was")
    return (
        changes.withColumn("valid_to", F.lead("day").over(order))
        .filter("on = 1")
        .select("list_name", "pattern", F.col("day").alias("valid_from"), "valid_to")
    )


def candidates(url: Column, most_labels: int, most_segments: int) -> Column:
    """The patterns that could list a URL: its host, the host's parents, host + path prefixes;
    none with more host labels (for a host alone) or path segments than any listed pattern has."""
    host = F.lower(F.regexp_extract(url, URL, 1))
    path = F.regexp_extract(url, URL, 2)
    labels = F.split(host, r"\.", -1)
    last = F.slice(labels, F.greatest(F.size(labels) - most_labels + 1, F.lit(1)), F.lit(most_labels))
    hosts = F.transform(last, lambda _, i: F.array_join(F.slice(last, i + 1, F.lit(most_labels)), "."))
    parts = F.slice(F.array_remove(F.split(F.lower(path), "/", -1), ""), F.lit(1), F.lit(most_segments))
    paths = F.transform(parts, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(host != "", F.array_distinct(F.concat(hosts, paths))).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (capture_id, url, fetched): n_active and the sorted active entries, blocked."""
    lists = (
        intervals(entries)
        .groupBy("pattern")
        .agg(F.array_sort(F.collect_list(F.struct("list_name", "valid_from", "valid_to"))).alias("spans"))
    )
    labels, segments = F.size(F.split(F.split("pattern", "/", -1)[0], r"\.", -1)), F.size(F.split("pattern", "/", -1)) - 1
    n, most_labels, most_segments = lists.agg(F.count("*"), F.max(labels), F.max(segments)).first()
    if n <= BROADCAST_PATTERNS:
        lists = F.broadcast(lists)
    numbered = captures.select(F.monotonically_increasing_id().alias("rid"), "capture_id", "url", "fetched")
    rows = numbered.select(
        "rid",
        "capture_id",
        F.to_date("fetched").alias("day"),
        F.explode_outer(candidates(F.col("url"), most_labels or 0, most_segments or 0)).alias("pattern"),
    )
    active = F.filter(
        "spans",
        lambda s: (F.col("day") >= s["valid_from"]) & (s["valid_to"].isNull() | (F.col("day") < s["valid_to"])),
    )
    named = F.transform(active, lambda s: F.concat_ws(":", s["list_name"], F.col("pattern")))
    found = rows.join(lists, "pattern", "left").select("rid", "capture_id", named.alias("found"))
    return (
        found.groupBy("rid")
        .agg(F.first("capture_id").alias("capture_id"), F.array_sort(F.flatten(F.collect_list("found"))).alias("active"))
        .select(
            "capture_id",
            F.size("active").cast("long").alias("n_active"),
            F.array_join("active", ",").alias("active"),
            (F.size("active") > 0).alias("blocked"),
        )
    )
