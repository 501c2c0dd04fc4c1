"""Notes of several voices from a grid of loudness by frame and semitone.

A note is a stretch of frames of one semitone that are all at least `low` and of which one
is at least `high` (two thresholds, so that a note that has begun may fade), and that lasts
`fewest` frames or more. Where the grid says that a frame is an onset, a stretch is cut
before it. All are windows over the frames of a chart's semitone: a chart's semitones may lie
in different tasks. Frames of the grid that repeat count once, with their loudest;
nulls are no frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOP_S = 256 / 16000


def note_events(grid: DataFrame, high: float = 0.5, low: float = 0.3, fewest: int = 6, onset: float = 0.5, hop_s: float = HOP_S) -> DataFrame:
    """(chart_id, pos, start_s, end_s, midi, amplitude, peak) of grid (chart_id, frame, midi,
    amplitude and, if there is one, onset): amplitude is the mean over the note's frames; pos
    numbers a chart's notes by start and pitch."""
    begins = F.max("onset") if "onset" in grid.columns else F.lit(None).cast("double")
    loud = grid.where(F.col("amplitude") >= low).groupBy("chart_id", "midi", "frame").agg(F.max("amplitude").alias("amplitude"), F.coalesce(begins, F.lit(0.0)).alias("onset"))
    w = Window.partitionBy("chart_id", "midi").orderBy("frame")
    before = F.lag("frame").over(w)
    struck = (F.col("onset") >= onset) & (F.coalesce(F.lag("onset").over(w), F.lit(0.0)) < onset)
    rows = loud.withColumn("new", F.coalesce((F.col("frame") - before > 1) | struck, F.lit(True)).cast("int"))
    rows = rows.withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    notes = rows.groupBy("chart_id", "midi", "stretch").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.avg("amplitude").alias("amplitude"), F.max("amplitude").alias("peak"))
    notes = notes.where((F.col("peak") >= high) & (F.col("last") - F.col("first") + 1 >= fewest))
    pos = F.row_number().over(Window.partitionBy("chart_id").orderBy("first", "midi")) - 1
    return notes.select("chart_id", pos.alias("pos"), (F.col("first") * hop_s).alias("start_s"), ((F.col("last") + 1) * hop_s).alias("end_s"), F.col("midi").cast("int").alias("midi"), "amplitude", "peak")
