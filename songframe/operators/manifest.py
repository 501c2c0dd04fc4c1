"""Which charts of a library a replay takes, and what it knows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.functions import text as T
from songframe.sources import chart_text

FEWEST_WORDS, LEAST_SPAN_S = 30, 60.0


def long_enough(words: DataFrame, fewest: int = FEWEST_WORDS, least: float = LEAST_SPAN_S) -> DataFrame:
    """(chart_id, n_words, span_s, wpm) of charts whose timed words (chart_id, line_no,
    word_no, start_s, end_s) are `fewest` or more and span `least` seconds or more, from
    the first word's start to the last one's end."""
    place = F.struct("line_no", "word_no")
    out = words.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n_words"), (F.max_by("end_s", place) - F.min_by("start_s", place)).alias("span_s"))
    return out.where((F.col("n_words") >= fewest) & (F.col("span_s") >= least)).withColumn("wpm", F.col("n_words") / (F.col("span_s") / 60))


def manifest(files: DataFrame, words: DataFrame, fewest: int = FEWEST_WORDS, least: float = LEAST_SPAN_S) -> DataFrame:
    """(chart_id, lang_group, n_words, span_s, wpm) of files (chart_id, text) that are not
    marked relative in their first bytes, have a tempo, and are long enough."""
    good = files.where(~F.coalesce(T.relative_header(F.col("text")), F.lit(False)))
    head = chart_text.headers(good).where("bpm > 0").select("chart_id", T.language_group(T.language_code(F.col("language"))).alias("lang_group"))
    return head.join(long_enough(words, fewest, least), "chart_id")
