"""The engine's functions under names that SQL can call.

    sql.register(spark)
    spark.sql("SELECT beat_to_time(start_beat, bpm, gap_ms), midi_of(f0) FROM notes")
    spark.sql("SELECT * FROM voice_speakers(0.5, TABLE(windows) PARTITION BY chart_id ORDER BY pos)")

Those of numbers are SQL functions: Catalyst puts their bodies into the plan, as the columns
of functions.timing are. syllables and similarity work on Arrow batches. Table
functions take a chart's rows, which Spark deals out and sorts as the query says, and give
rows of their own behind the columns that the rows are dealt out by.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StringType, StructField, StructType

from songframe.functions import arrow
from songframe.operators import speakers

#: name and parameters, type, body.
NUMBERS = (
    ("seconds_per_beat(bpm DOUBLE)", "DOUBLE", "15.0D / bpm"),
    ("beat_to_time(beat DOUBLE, bpm DOUBLE, gap_ms DOUBLE)", "DOUBLE", "gap_ms / 1000.0D + beat * (15.0D / bpm)"),
    ("time_to_beat(t DOUBLE, t0 DOUBLE, bpm DOUBLE)", "INT", "greatest(0, CAST(rint((t - t0) / (15.0D / bpm)) AS INT))"),
    ("gap_of(first_onset DOUBLE)", "DOUBLE", "greatest(0.0D, first_onset * 1000.0D - 200.0D)"),
    ("midi_of(hz DOUBLE)", "DOUBLE", "69 + 12 * log2(hz / 440.0D)"),
    ("hz_of(midi DOUBLE)", "DOUBLE", "440.0D * pow(2.0D, (midi - 69) / 12.0D)"),
    ("voiced(f0 DOUBLE, conf DOUBLE)", "BOOLEAN", "coalesce(conf > 0.5D AND f0 > 0, FALSE)"),
    ("overlap_of(s DOUBLE, e DOUBLE, t0 DOUBLE, t1 DOUBLE)", "DOUBLE", "least(e, t1) - greatest(s, t0)"),
    ("ratio_of(a DOUBLE, b DOUBLE)", "DOUBLE", "coalesce(try_divide(a, b), 0.0D)"),
    ("tempo_multiple(est DOUBLE, file_bpm DOUBLE)", "DOUBLE", "pow(2.0D, rint(log2(CASE WHEN est > 0 AND file_bpm > 0 THEN file_bpm / est END)))"),
    ("tempo_deviation(est DOUBLE, file_bpm DOUBLE)", "DOUBLE", "round(abs(file_bpm / est / pow(2.0D, rint(log2(CASE WHEN est > 0 AND file_bpm > 0 THEN file_bpm / est END))) - 1), 4)"),
    ("preview_start(duration DOUBLE, t0 DOUBLE, bpm DOUBLE)", "DOUBLE", "CASE WHEN duration > 0 THEN bround(least(duration * 0.25D, greatest(0.0D, t0 + 30 * (15.0D / bpm))), 2) END"),
    ("few_words(n_words DOUBLE, duration DOUBLE)", "BOOLEAN", "coalesce(duration > 60 AND n_words / (duration / 60) < 15, FALSE)"),
)


@udtf
class VoiceSpeakers:
    """voice_speakers(limit, TABLE(windows) PARTITION BY chart_id ORDER BY pos): the windows'
    speakers by the likeness of their vector."""

    @staticmethod
    def analyze(limit: AnalyzeArgument, windows: AnalyzeArgument) -> AnalyzeResult:
        if not windows.isTable:
            raise ValueError("the second argument is a table: TABLE(windows) PARTITION BY chart_id ORDER BY pos")
        names = [f.name for f in windows.dataType.fields]
        if missing := {"chart_id", "pos", "vector"} - set(names):
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        keys = [StructField(n, windows.dataType[n].dataType) for n in ("chart_id", "pos")]
        return AnalyzeResult(StructType([*keys, StructField("speaker", StringType())]))

    def __init__(self):
        self.rows, self.limit = [], 0.0

    def eval(self, limit: float, row: Row) -> None:
        self.rows.append((row["chart_id"], row["pos"], row["vector"]))
        self.limit = float(limit)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            chart, pos, vectors = zip(*self.rows, strict=True)
            yield from zip(chart, pos, speakers.named(vectors, self.limit, None), strict=True)


def register(spark: SparkSession) -> None:
    """Name all functions in the session; again if they were."""
    for head, kind, body in NUMBERS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("syllables_of", arrow.syllables_of)
    spark.udf.register("similarity_of", arrow.similarity_of)
    spark.udtf.register("voice_speakers", VoiceSpeakers)
