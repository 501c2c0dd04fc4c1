"""Functions that SQL can call, against the columns and operators that they stand for."""

import math

import pytest
from pyspark.sql import functions as F

from songframe.functions import sql, timing
from songframe.operators import speakers

COLUMNS = {
    "seconds_per_beat(b)": lambda: timing.seconds_per_beat(F.col("b")),
    "beat_to_time(a, b, c)": lambda: timing.beat_to_time(F.col("a"), F.col("b"), F.col("c")),
    "time_to_beat(a, c, b)": lambda: timing.time_to_beat(F.col("a"), F.col("c"), F.col("b")),
    "gap_of(a)": lambda: timing.gap_of(F.col("a")),
    "midi_of(b)": lambda: timing.midi_of(F.col("b")),
    "hz_of(a)": lambda: timing.hz_of(F.col("a")),
    "voiced(b, c)": lambda: timing.voiced(F.col("b"), F.col("c")),
    "overlap_of(a, b, c, d)": lambda: timing.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")),
    "ratio_of(a, d)": lambda: timing.ratio(F.col("a"), F.col("d")),
    "tempo_multiple(a, b)": lambda: timing.tempo_multiple(F.col("a"), F.col("b")),
    "tempo_deviation(a, b)": lambda: timing.tempo_deviation(F.col("a"), F.col("b")),
    "preview_start(a, c, b)": lambda: timing.preview_start(F.col("a"), F.col("c"), F.col("b")),
    "few_words(d, a)": lambda: timing.few_words(F.col("d"), F.col("a")),
}


def test_all_have_a_column():
    assert sorted(h.split("(")[0] for h, *_ in sql.NUMBERS) == sorted(c.split("(")[0] for c in COLUMNS)


@pytest.mark.parametrize("call", COLUMNS)
def test_numbers_equal_columns(spark, call):
    sql.register(spark)
    sql.register(spark)
    rows = [(a, b, c, d) for a in (0.0, 0.03125, 2.5, 100.25, None) for b in (60.0, 321.0, None) for c in (0.2, 1200.0) for d in (0.0, 3.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = frame.select(F.expr(call).alias("x"), COLUMNS[call]().alias("y")).collect()
    assert all(r.x == r.y or (isinstance(r.x, float) and isinstance(r.y, float) and math.isnan(r.x) and math.isnan(r.y)) for r in got)


def test_texts(spark):
    sql.register(spark)
    got = spark.sql("SELECT syllables_of('manos') AS a, similarity_of('ab', 'ab') AS b").first()
    assert "".join(got.a) == "manos" and got.b == 1.0


def test_table_function_equals_the_operator(spark):
    sql.register(spark)
    rows = [(c, p, [float((p + c) % 3 == k) + 0.1 * p for k in range(3)]) for c in range(4) for p in range(9)] + [(None, 0, None)]
    windows = spark.createDataFrame(rows, "chart_id long, pos int, vector array<double>")
    got = spark.sql("SELECT * FROM voice_speakers(0.2, TABLE({w}) PARTITION BY chart_id ORDER BY pos)", w=windows)
    assert got.dtypes == [("chart_id", "bigint"), ("pos", "int"), ("speaker", "string")]
    assert sorted(map(str, got.collect())) == sorted(map(str, speakers.speakers(windows, limit=0.2).collect()))
    with pytest.raises(Exception, match="lacks vector"):
        spark.sql("SELECT * FROM voice_speakers(0.2, TABLE({w}) PARTITION BY chart_id ORDER BY pos)", w=windows.drop("vector")).collect()
