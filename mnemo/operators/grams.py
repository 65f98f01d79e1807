"""Substring joins: which rows hold which needles, without comparing every row with every needle.

A text that holds a needle holds each of its grams. Rows are exploded into their distinct grams of
four characters (read by one linear pass of a pattern), joined with one gram of each needle, and
the few candidates are verified by ``contains``. Needles of under four characters are grams of
their own length. All of it is one plan of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; a look-ahead, so that they overlap."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _gram_of(needle: Column, n: int) -> Column:
    """One gram of a needle: the first without white space, which few texts lack, or the first."""
    every = F.regexp_extract_all(needle, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.coalesce(F.get(F.filter(every, lambda g: ~g.rlike(r"\s")), F.lit(0)), F.get(every, F.lit(0)))


def holding(needles: DataFrame, rows: DataFrame, texts: Sequence[str], least: int = 1) -> DataFrame:
    """Pairs of ``needles`` (needle, ...) and ``rows`` where one of the ``texts`` holds the needle.

    Case is ignored. Null and empty needles are held by nothing; a pair comes once, whichever and
    however many of the texts hold it. ``least`` is the length below which needles are left out.
    The two sides' column names must differ. Needles with one common gram meet many rows, so the
    smaller side is broadcast by its size or a hot gram's rows are split by adaptive execution.
    """
    low = needles.withColumn("needle", F.lower("needle")).filter(F.length("needle") >= least)
    # A line break between texts; a needle across it is refused by the verification.
    joined = F.lower(F.concat_ws("\n", *texts))
    held = None
    for column in texts:
        has = F.coalesce(F.lower(column).contains(F.col("needle")), F.lit(False))
        held = has if held is None else held | has
    out = None
    for n in range(min(least, GRAM), GRAM + 1):
        sized = low.filter(F.length("needle") >= n if n == GRAM else F.length("needle") == n)
        sized = sized.withColumn("_gram", _gram_of(F.col("needle"), n))
        met = rows.withColumn("_gram", F.explode(_grams(joined, n))).join(sized, "_gram").filter(held)
        out = met if out is None else out.unionByName(met)
    return out.drop("_gram")
