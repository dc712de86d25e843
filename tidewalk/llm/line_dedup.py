"""Line dedup over overlapping windows of three lines, in DataFrame functions alone.

A line ends at a line feed. The hashes of every three consecutive lines are compared over all documents; a window that
occurs earlier (smaller ``doc_id``, or same document and earlier line) is a later occurrence, and the lines that later
occurrences cover are removed. Windows are judged on the input, not on what is left.

Defined results: a null text has no lines and stays null; an empty text is one empty line; a text of fewer than three
lines has no window and stays whole; a null ``doc_id`` comes before all others; rows equal in ``doc_id`` and text count as
one document, and each gets that document's result; an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewalk.llm.columns import fresh

WINDOW = 3
COUNTS = ("n_lines", "n_removed", "n_spans")
#: Copies of each repeated window that its occurrences are dealt to, so that a hot window spreads over tasks.
SALT = 8


def _lines() -> Column:
    return F.split("text", "\n")


def later_windows(documents: DataFrame) -> DataFrame:
    """doc_id, text hash and first line of each window that occurs earlier too."""
    key = documents.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), _lines().alias("lines")).filter(F.size("lines") >= WINDOW)
    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    hashed = F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.get("lines", i + j) for j in range(WINDOW)]).alias("h1"),
        F.xxhash64(F.lit("second"), *[F.get("lines", i + j) for j in range(WINDOW)]).alias("h2"),
        i.alias("i"),
    ))
    windows = key.select("doc_id", "th", F.explode(hashed).alias("w")).select("doc_id", "th", "w.*")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    windows = windows.withColumn("salt", F.pmod(F.hash("th", "i"), F.lit(SALT)))
    return windows.join(first, ["h1", "h2", "salt"]).filter(F.struct("doc_id", "th", "i") > F.col("first")).select("doc_id", "th", "i")


def dedup_lines(documents: DataFrame, counts: bool = True, drop_emptied: bool = False) -> DataFrame:
    """documents with ``text`` less the covered lines and, with ``counts``, n_lines, n_removed and n_spans (runs of removed lines).

    Columns of those names are replaced by the counts. ``drop_emptied`` leaves out documents that lose lines and keep nothing but white space.
    """
    id_, th, starts, covered, lines, rest = fresh(documents, "id", "th", "starts", "covered", "lines", "rest")
    found = later_windows(documents).groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.collect_set("i").alias(starts))
    joined = documents.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(th)) & F.col("text").isNotNull(), "left")
    hidden = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(*[s + j for j in range(WINDOW)]))))
    joined = joined.withColumn(covered, F.coalesce(hidden, F.array().cast("array<int>"))).withColumn(lines, _lines())
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    joined = joined.withColumn(rest, F.when(F.size(covered) == 0, F.col("text")).otherwise(rebuilt))
    if drop_emptied:
        joined = joined.filter((F.size(covered) == 0) | F.col(rest).rlike(r"\S"))
    runs = F.size(F.array_except(F.col(covered), F.transform(covered, lambda c: c + 1)))
    numbers = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.size(covered).cast("long").alias("n_removed"), runs.cast("long").alias("n_spans")] if counts else []
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text" and not (counts and c in COUNTS)]
    return joined.select(*others, *numbers, F.col(rest).alias("text"))
