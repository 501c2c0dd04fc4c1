"""Samples of recordings in blocks: (chart_id, at, samples), where `at` is the number of the
first sample. Each block but a chart's last has at least as many as a frame looks at.

A block meets the head of the next one by a join, so that a chart's blocks are worked on
by many tasks. A block that is missing, or null, is silence to the block before and has no
frames of its own. A frame that looks beyond a chart's end sees silence there.

Samples that can be made or read where they are worked on (from a sound file, say) need not be
stored or sent: a Reader gives the blocks (at, samples) of a chart in order, from the chart's rows,
which are what its samples come from. Such a chart is worked on in one task, a stretch of
samples at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

Blocks = Iterator[tuple[int, np.ndarray]]
Reader = Callable[[pa.Table], Blocks]

#: Samples of a stretch, at least.
STRETCH = 1 << 14


def by_chart(rows: DataFrame) -> GroupedData:
    """Charts dealt out over as many tasks as Spark is set to: their rows are few and small, but not
    the work on their samples, so they are not to be gathered by their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "chart_id").groupBy("chart_id")


def in_order(rows: pa.Table) -> pa.Table:
    """A chart's rows by `at`, if they are blocks."""
    return rows.sort_by("at") if "at" in rows.column_names else rows


def stored(rows: pa.Table) -> Blocks:
    """A Reader of rows (at, samples)."""
    for at, x in zip(rows["at"].to_pylist(), rows["samples"], strict=True):
        yield at, np.asarray(x.values.to_numpy() if x.is_valid else [], float)


def stretches(blocks: Blocks, reach: int, size: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(at, samples, after) of a chart's blocks in order: those that follow one on the other are put
    together until they have `size` samples; after holds the next block's first samples."""
    start, held, n = 0, [], 0
    for at, x in blocks:
        if not len(x):
            continue
        if n and (n >= size or at != start + n):
            yield start, np.concatenate(held).astype(float), x[: reach if at == start + n else 0].astype(float)
            held, n = [], 0
        start = start if n else at
        held.append(x)
        n += len(x)
    if n:
        yield start, np.concatenate(held).astype(float), np.zeros(0)


def with_heads(samples: DataFrame, reach: int) -> DataFrame:
    """(chart_id, at, samples, after): after holds the next block's first samples."""
    own = samples.where("size(samples) > 0").select("chart_id", F.col("at").cast("long").alias("at"), "samples")
    heads = own.select(F.col("chart_id").alias("of"), F.col("at").alias("next"), F.slice("samples", 1, reach).alias("after"))
    rows = own.join(heads, (F.col("chart_id") == F.col("of")) & (F.col("at") + F.size("samples") == F.col("next")), "left")
    return rows.select("chart_id", "at", "samples", "after")


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(chart_id, at, samples, after) of the rows of a batch; no head is an empty one."""
    for chart, at, *both in zip(*(batch.column(i) for i in range(4)), strict=True):
        own, after = (x.values.to_numpy().astype(float) if x.is_valid else np.zeros(0) for x in both)
        yield chart.as_py(), at.as_py(), own, after


def frames_of(samples: np.ndarray, after: np.ndarray, skip: int, hop: int, reach: int) -> np.ndarray:
    """Rows of `reach` samples, one every hop of the block's own samples from `skip` on."""
    n = max(0, -(-(len(samples) - skip) // hop))
    whole = np.zeros(max(0, n - 1) * hop + reach)
    both = np.concatenate((samples[skip:], after))[: len(whole)]
    whole[: len(both)] = both
    return np.lib.stride_tricks.sliding_window_view(whole, reach)[::hop][:n]
