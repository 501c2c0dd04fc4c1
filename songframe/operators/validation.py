"""Rules that a chart must meet; one row (chart_id, track, line_no, rule) a problem.

track and line_no are null for rules on the header or the whole chart. Within a
line only the first bad note counts; the next line goes on from the last note that
was in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions.text import stripped

LEAST_BPM = 1.0


def header_problems(charts: DataFrame) -> DataFrame:
    """charts: chart_id, title, artist, audio, bpm; null counts as missing."""
    blank = lambda c: stripped(F.coalesce(c, F.lit(""))) == ""
    rules = F.array(
        F.when(blank("title"), F.lit("title")),
        F.when(blank("artist"), F.lit("artist")),
        F.when(blank("audio"), F.lit("audio")),
        F.when(F.coalesce("bpm", F.lit(0.0)) < LEAST_BPM, F.lit("bpm")),
    )
    rows = charts.select("chart_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return rows.select("chart_id", F.lit(None).cast("int").alias("track"), F.lit(None).cast("int").alias("line_no"), "rule")


def note_problems(charts: DataFrame, notes: DataFrame) -> DataFrame:
    """notes: chart_id, track, line_no, note_index, start_beat, duration, kind.

    A fold over a track's notes in order, in the row of the track: the last beat that was
    in order, the line that already has its problem, and the problems."""
    none = F.lit(None).cast("int")
    found = "array<struct<track:int,line_no:int,rule:string>>"
    start = F.struct(F.lit(-1).alias("last"), none.alias("bad"), F.array().cast(found).alias("found"))

    def step(state: Column, x: Column) -> Column:
        skip = state["bad"].eqNullSafe(x["line_no"])
        late = F.coalesce(x["start_beat"] < state["last"], F.lit(False))
        short = F.coalesce(x["duration"] < 1, F.lit(False))
        wrong = F.when(late, F.lit("beat order")).when(short, F.lit("duration"))
        last = F.when(skip | late, state["last"]).otherwise(F.coalesce(x["start_beat"], state["last"]))
        problem = F.array(F.struct(F.col("track").cast("int").alias("track"), x["line_no"].cast("int").alias("line_no"), wrong.alias("rule")))
        new = ~skip & wrong.isNotNull()
        return F.struct(last.alias("last"), F.when(new, x["line_no"].cast("int")).otherwise(state["bad"]).alias("bad"), F.when(new, F.concat(state["found"], problem)).otherwise(state["found"]).alias("found"))

    row = F.struct(*(F.col(c).cast("int").alias(c) for c in ("line_no", "note_index", "start_beat", "duration")))
    tracks = notes.groupBy("chart_id", "track").agg(F.array_sort(F.collect_list(row)).alias("notes"), F.bool_and(F.col("kind") == "freestyle").alias("free"))
    tracks = tracks.select("chart_id", "free", F.aggregate("notes", start, step)["found"].alias("found"))
    whole = tracks.groupBy("chart_id").agg(F.bool_and("free").alias("free"), F.flatten(F.collect_list("found")).alias("found"))
    rows = charts.select("chart_id").join(whole.withColumnRenamed("chart_id", "of"), F.col("chart_id") == F.col("of"), "full")
    on_chart = lambda rule: F.array(F.struct(none.alias("track"), none.alias("line_no"), F.lit(rule).alias("rule"))).cast(found)
    more = F.when(F.col("of").isNull(), on_chart("no notes")).when(F.col("free"), on_chart("all freestyle")).otherwise(F.array().cast(found))
    rows = rows.select(F.coalesce("chart_id", "of").alias("chart_id"), F.explode(F.concat(more, F.coalesce("found", F.array().cast(found)))).alias("x"))
    return rows.select("chart_id", "x.track", "x.line_no", "x.rule")


def problems(charts: DataFrame, notes: DataFrame) -> DataFrame:
    return header_problems(charts).unionByName(note_problems(charts, notes))
