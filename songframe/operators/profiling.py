"""The style of a library: distributions of note, line and chart measures.

From parsed charts (chart_id, bpm) and notes in beats. Freestyle notes do not count,
nor do lines without other notes; charts without tempo have no samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songframe.functions import timing
from songframe.functions.text import relative_beats, starts_hold
from songframe.operators import metrics
from songframe.sources import chart_text


def usable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (chart_id, text) to profile, and (chart_id, reason) of the others: relative
    beats, or no lines or tempo."""
    relative = F.coalesce(relative_beats(F.col("text")), F.lit(False))
    head = chart_text.headers(files).select("chart_id", "bpm")
    some = chart_text.notes(files).select("chart_id").distinct().withColumn("some", F.lit(True))
    rows = files.join(head, "chart_id").join(some, "chart_id", "left")
    empty = F.col("some").isNull() | ~F.coalesce(F.col("bpm") > 0, F.lit(False))
    rows = rows.withColumn("reason", F.when(relative, "relative beats").when(empty, "no lines or tempo"))
    return rows.where("reason IS NULL").select("chart_id", "text"), rows.where("reason IS NOT NULL").select("chart_id", "reason")


def samples(charts: DataFrame, notes: DataFrame) -> DataFrame:
    """(metric, value): one for each note, neighbouring pair, line or chart."""
    spb = timing.seconds_per_beat(F.col("bpm"))
    rows = notes.where("kind <> 'freestyle'").join(charts.where("bpm > 0").select("chart_id", "bpm"), "chart_id")
    line = Window.partitionBy("chart_id", "track", "line_no").orderBy("note_index")
    end = F.col("start_beat") + F.col("duration")
    after = F.lead("start_beat").over(line)
    pairs = rows.select(
        "chart_id", "track", "line_no", "note_index", "bpm", "start_beat", "pitch", "kind", "text", end.alias("end"), (F.col("duration") * spb * 1000).alias("note_duration_ms"),
        F.abs(F.lead("pitch").over(line) - F.col("pitch")).alias("pitch_step"), F.when(after.isNotNull(), F.greatest(F.lit(0.0), (after - end) * spb * 1000)).alias("intra_line_gap_ms"),
    )
    lines = pairs.groupBy("chart_id", "track", "line_no").agg(F.count(F.lit(1)).alias("notes_per_line"), F.max("bpm").alias("bpm"), F.min_by("start_beat", "note_index").alias("begin"), F.max_by("end", "note_index").alias("end"))
    before = F.lag("end").over(Window.partitionBy("chart_id").orderBy("track", "line_no"))
    lines = lines.select("notes_per_line", ((F.col("end") - F.col("begin")) * spb).alias("line_span_s"), F.when(before.isNotNull(), F.greatest(F.lit(0.0), (F.col("begin") - before) * spb)).alias("inter_line_gap_s"))
    share = lambda c: F.avg(c.cast("int"))
    whole = pairs.groupBy("chart_id").agg(share(starts_hold(F.col("text"))).alias("hold_note_fraction"), share(F.col("kind").isin("golden", "rapgolden")).alias("golden_fraction"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"))
    out = metrics.pooled(pairs, "note_duration_ms", "pitch_step", "intra_line_gap_ms")
    for more, names in ((lines, lines.columns), (whole, whole.columns[1:])):
        out = out.unionByName(metrics.pooled(more, *names))
    return out


def first_skipped(files: DataFrame, n: int = 20) -> DataFrame:
    """The first n (by chart_id) of the files that usable() leaves out: a report's list."""
    return usable(files)[1].orderBy("chart_id").limit(n)


def profile(files: DataFrame) -> DataFrame:
    """The distribution of every measure over the usable files."""
    good, _ = usable(files)
    return metrics.distribution(samples(chart_text.headers(good), chart_text.notes(good)))


def as_json(profile: DataFrame) -> DataFrame:
    """One row `value`: a JSON object of the distributions by metric; a few rows in all."""
    fields = F.struct(*(c for c in profile.columns if c != "metric"))
    entries = F.array_sort(F.collect_list(F.struct("metric", fields.alias("of"))))
    return profile.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
