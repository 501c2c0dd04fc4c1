"""Who sings when: windows of a chart grouped by the likeness of their voice vectors.

Clusters merge two by two, those whose members differ least on average first, while that
mean is within a limit, or down to a given number of speakers. The merges are found by chains of nearest
neighbours: a chain grows to the nearest cluster until two are each other's nearest, which
then merge; for means these are the merges that the closest pair first would make, without a search over all pairs
each time. Of equally near clusters a chain takes the one before in it, else the one with
the earliest window. Merges of equal height count in the order in which they were found.

The distance is 1 less the cosine. A vector that is null, zero or of another length than
the chart's first is like no other (distance 1). Distances of a chart's windows are one
matrix, so a chart must fit into a task; charts are dealt out by their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.operators.sequences import in_chart, islands


def distances(vectors: np.ndarray) -> np.ndarray:
    """1 less the cosine, by pairs of rows."""
    size = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(size > 0, size, 1.0)[:, None]
    return 1.0 - unit @ unit.T


def merges(apart: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges; a and b are windows of the two clusters."""
    d = apart.astype(float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    found, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            nearest = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[nearest]:
                break
            chain.append(nearest)
        b, a = sorted((chain.pop(), chain.pop()), reverse=True)
        found.append((float(d[a, b]), a, b))
        # the mean distance of the members, from those of the two
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    return found


def labels(vectors: np.ndarray, limit: float | None, number: int | None) -> list[int]:
    """The speaker of each row, numbered by their first row."""
    n = len(vectors)
    steps = sorted(merges(distances(vectors)), key=lambda m: m[0])
    steps = steps[: max(0, n - number)] if number else [m for m in steps if m[0] <= limit]
    of = list(range(n))

    def top(i: int) -> int:
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    for _, a, b in steps:
        a, b = sorted((top(a), top(b)))
        of[b] = a
    numbers: dict[int, int] = {}
    return [numbers.setdefault(top(i), len(numbers)) for i in range(n)]


def named(vectors: list, limit: float | None, number: int | None) -> list[str]:
    """The speaker of each vector."""
    given = [np.zeros(0) if v is None else np.nan_to_num(np.asarray(v, float)) for v in vectors]
    size = next((len(v) for v in given if len(v)), 1)
    return [name(k) for k in labels(np.array([v if len(v) == size else np.zeros(size) for v in given]), limit, number)]


def speakers(windows: DataFrame, limit: float | None = 0.5, number: int | None = None) -> DataFrame:
    """(chart_id, pos, speaker) of windows (chart_id, pos, vector): A, B and so on, by their
    first window. Clusters merge while their mean distance is within the limit, or, where a
    number is given, until there are so many."""
    if not number and limit is None:
        raise ValueError("a limit or a number of speakers")

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("pos")
        return x[["chart_id", "pos"]].assign(speaker=named(x["vector"], limit, number))

    return windows.select("chart_id", "pos", "vector").groupBy("chart_id").applyInPandas(fold, "chart_id long, pos int, speaker string")


def name(k: int) -> str:
    """A to Z, then AA, AB and so on."""
    return (name(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def segments(windows: DataFrame, gap: float = 0.0) -> DataFrame:
    """(chart_id, seg, s, e, speaker): windows (pos, start_s, end_s, speaker) of one speaker
    in a row, with silences of at most `gap` between them, are one segment."""
    w = in_chart("pos")
    new = (F.col("speaker") != F.lag("speaker").over(w)) | (F.col("start_s") - F.lag("end_s").over(w) > gap)
    rows = islands(windows.withColumn("new", F.coalesce(new, F.lit(False))), F.col("new"), "seg")
    return rows.groupBy("chart_id", "seg").agg(F.min("start_s").alias("s"), F.max("end_s").alias("e"), F.first("speaker").alias("speaker")).withColumn("seg", F.col("seg").cast("int"))
