"""The engine's tables on the driver's tables, and the same as SQL.

Our convention: a user's events are a chart; 57600 seconds are one chart second,
so a beat of 1/16 s is an hour. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.functions import timing

HOUR_SCALE = 57600
BPM, GAP_MS = 240.0, 0.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart_id, pos, event_type, kind, start_s, end_s, f0, conf, midi (null if
    unvoiced), voiced; an event's end never passes the next onset of its chart."""
    order = Window.partitionBy("chart_id").orderBy("start_s", "event_id")
    f0 = F.col("value") * 10
    conf = F.regexp_extract("props", r"([0-9]+)", 1).cast("double") / 100
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("chart_id"),
        "event_id",
        "event_type",
        "value",
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6 / HOUR_SCALE).alias("start_s"),
        F.when(f0.between(65, 1000), f0).otherwise(0.0).alias("f0"),
        conf.alias("conf"),
    )
    ends = F.col("start_s") + 0.08 + F.col("value") / 500
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("end_s", F.coalesce(F.least(ends, F.lead("start_s").over(order)), ends))
    rows = rows.withColumn("voiced", timing.voiced(F.col("f0"), F.col("conf")))
    kind = F.when(F.col("event_type") == "signup", "golden").when(F.col("event_type") == "error", "freestyle").otherwise("normal")
    midi = F.when(F.col("voiced"), timing.midi_of(F.col("f0")))
    return rows.select("chart_id", "pos", "event_id", "event_type", kind.alias("kind"), "start_s", "end_s", "f0", "conf", midi.alias("midi"), "voiced")


#: CTEs e (raw) and notes.
NOTES = """
e AS (SELECT user_id AS chart_id, event_id, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 / 57600 AS start_s,
             CASE WHEN value * 10 BETWEEN 65 AND 1000 THEN value * 10 ELSE 0.0 END AS f0, regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 100 AS conf FROM events),
notes AS (SELECT chart_id, row_number() OVER o - 1 AS pos, event_id, event_type,
                 CASE event_type WHEN 'signup' THEN 'golden' WHEN 'error' THEN 'freestyle' ELSE 'normal' END AS kind, start_s,
                 coalesce(least(start_s + 0.08 + value / 500, lead(start_s) OVER o), start_s + 0.08 + value / 500) AS end_s, f0, conf,
                 CASE WHEN conf > 0.5 AND f0 > 0 THEN 69 + 12 * log2(f0 / 440) END AS midi, conf > 0.5 AND f0 > 0 AS voiced
          FROM e WINDOW o AS (PARTITION BY chart_id ORDER BY start_s, event_id))
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart_id, line_index, text: the lines of every document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chart_id"), F.posexplode(F.split("text", "\n")).alias("line_index", "text"))


LINES = """
lines AS (SELECT doc_id AS chart_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::INT AS line_index,
                 unnest(string_split(text, chr(10))) AS text FROM documents)
"""

#: Blank-separated words of lines.
RAW_WORDS = LINES + """,
raw_words AS (SELECT chart_id, line_index, unnest(generate_series(0, len(w) - 1))::INT AS word_index, unnest(w) AS word
              FROM (SELECT chart_id, line_index, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM lines))
"""


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes of the generated and of the reference chart."""
    return rows.where(F.col("event_type").isin("view", "signup")), rows.where(F.col("event_type").isin("click", "purchase"))


SIDES = NOTES + """,
gen AS (SELECT * FROM notes WHERE event_type IN ('view', 'signup')),
ref AS (SELECT * FROM notes WHERE event_type IN ('click', 'purchase'))
"""


def segments(rows: DataFrame) -> DataFrame:
    """Speaker segments: purchases and signups, one chart second each."""
    own = rows.where(F.col("event_type").isin("purchase", "signup"))
    return own.select("chart_id", F.col("pos").alias("seg"), F.col("start_s").alias("s"), (F.col("start_s") + 1.0).alias("e"), F.col("event_type").alias("speaker"))


def spoken(rows: DataFrame) -> DataFrame:
    """The words that segments are matched with: all other events."""
    return rows.where(~F.col("event_type").isin("purchase", "signup"))


SEGMENTS = NOTES + """,
segments AS (SELECT chart_id, pos AS seg, start_s AS s, start_s + 1.0 AS e, event_type AS speaker FROM notes WHERE event_type IN ('purchase', 'signup')),
spoken AS (SELECT * FROM notes WHERE event_type NOT IN ('purchase', 'signup'))
"""
