"""Sums over a document's keys of what a table says of each key.

The keys of a document and how often it holds each are two arrays of its row. What
is said of a key is said once, in a table of distinct keys; it goes to the keys
that over 1/SHARE of the holders share by broadcast (fewer than SHARE keys), and to
all others by a shuffle, which then has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.llm.common import with_group

#: A key is sent to all tasks where it has over one in so many of all (row, key) pairs.
SHARE = 50_000


def holdings(rows: DataFrame) -> DataFrame:
    """(row, key, times): one for each of the distinct keys of a row."""
    pair = F.explode(F.arrays_zip("keys", "times")).alias("p")
    return rows.select("row", pair).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))


def holders(rows: DataFrame) -> DataFrame:
    """(of, n): each distinct key and how many rows hold it."""
    return rows.select(F.explode("keys").alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n"))


def with_sums(rows: DataFrame, said: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """rows (a stored table with row, keys and times) with sums over what `said` (a stored
    table with of, n and more) says of their keys; 0 for rows without keys."""
    pairs = with_group(holdings(rows), said, "key", "of", bound=SHARE, share=SHARE)
    found = pairs.groupBy("row").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    return rows.drop("keys", "times").join(found, "row", "left").fillna(0, list(sums))
