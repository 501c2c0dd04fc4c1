"""Queries over the notes of charts in order, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.functions import arrow, timing
from songframe.operators import metrics, profiling, recurrences
from songframe.operators import sequences as S
from songframe.operators.storage import new_place
from songframe.plans import tables as T
from songframe.plans.book import Book
from songframe.sources import library

Q = Book()

#: Lines by silences over 0.6 s.
LINED = T.NOTES + """,
flags AS (SELECT *, coalesce(start_s - lag(end_s) OVER o > 0.6, FALSE) AS new_line FROM notes WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
lined AS (SELECT *, sum(new_line::INT) OVER (PARTITION BY chart_id ORDER BY pos)::BIGINT AS line_no, round_even(coalesce(midi, 60), 0)::INT AS pitch FROM flags)
"""
#: The same on sung notes alone.
SUNG = LINED.replace("flags AS (SELECT *", "sung AS (SELECT * FROM notes WHERE kind <> 'freestyle'),\nflags AS (SELECT *").replace("FROM notes WINDOW", "FROM sung WINDOW")
#: First and last notes of lines, and the silence between lines.
LINE_TABLE = """,
line_rows AS (SELECT chart_id, line_no, count(*) AS n_notes, arg_min(start_s, pos) AS start_s, arg_max(end_s, pos) AS end_s FROM lined GROUP BY ALL),
silences AS (SELECT *, greatest(0, start_s - lag(end_s) OVER (PARTITION BY chart_id ORDER BY line_no)) AS silence_s,
                    lag(end_s) OVER (PARTITION BY chart_id ORDER BY line_no) IS NULL AS head FROM line_rows)
"""


def lined(spark: SparkSession, sf_dir: str, sung: bool = False) -> DataFrame:
    rows = T.notes(spark, sf_dir)
    rows = S.with_lines(rows.where("kind <> 'freestyle'") if sung else rows)
    return rows.withColumn("pitch", F.rint(F.coalesce("midi", F.lit(60.0))).cast("int"))


@Q.add(
    "WITH " + SUNG + LINE_TABLE + """,
steps AS (SELECT chart_id, pitch, kind, (end_s - start_s) * 1000 AS duration_ms, abs(pitch - lag(pitch) OVER o) AS step,
                 greatest(0, lead(start_s) OVER o - end_s) * 1000 AS gap_ms, lead(start_s) OVER o IS NULL AS last FROM lined WINDOW o AS (PARTITION BY chart_id, line_no ORDER BY pos)),
whole AS (SELECT chart_id, avg((kind IN ('golden', 'rapgolden'))::INT) AS golden, max(pitch) - min(pitch) AS pitch_range FROM lined GROUP BY chart_id),
samples AS (
  SELECT 'note_duration_ms' AS metric, duration_ms AS value FROM steps UNION ALL SELECT 'pitch_step', step FROM steps WHERE step IS NOT NULL
  UNION ALL SELECT 'intra_line_gap_ms', gap_ms FROM steps WHERE NOT last UNION ALL SELECT 'notes_per_line', n_notes FROM line_rows
  UNION ALL SELECT 'line_span_s', end_s - start_s FROM line_rows UNION ALL SELECT 'inter_line_gap_s', silence_s FROM silences WHERE NOT head
  UNION ALL SELECT 'golden_fraction', golden FROM whole UNION ALL SELECT 'pitch_range', pitch_range FROM whole)
SELECT metric, count(*) AS n, round(avg(value), 3) AS mean, """ + ", ".join(f"round(quantile_cont(value, {p / 100}), 3) AS p{p}" for p in metrics.PERCENTS) + " FROM samples GROUP BY metric"
)
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of note, line and chart measures over all charts."""
    rows = S.pitch_steps(S.intra_line_gaps(lined(spark, sf_dir, sung=True)))
    own = rows.select(((F.col("end_s") - F.col("start_s")) * 1000).alias("note_duration_ms"), F.col("step").alias("pitch_step"), F.col("gap_ms").alias("intra_line_gap_ms"))
    per_line = S.line_table(rows).select(F.col("n_notes").alias("notes_per_line"), (F.col("end_s") - F.col("start_s")).alias("line_span_s"), F.col("silence_s").alias("inter_line_gap_s"))
    whole = rows.groupBy("chart_id").agg(F.avg(F.col("kind").isin("golden", "rapgolden").cast("int")).alias("golden_fraction"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"))
    samples = metrics.pooled(own, *own.columns).unionByName(metrics.pooled(per_line, *per_line.columns)).unionByName(metrics.pooled(whole, "golden_fraction", "pitch_range"))
    return metrics.distribution(samples)


@Q.add(Q.sql["style_profile"])
def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile as the one JSON object that a report is, read back from a file."""
    profile, path = style_profile(spark, sf_dir), new_place(spark, "profile")
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in profile.schema if f.name != "metric")
    library.write_json(profiling.as_json(profile).select("value"), path)
    text = library.read_json(spark, path, "value string")
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{fields}>>")).alias("metric", "of")).select("metric", "of.*")


@Q.add("WITH " + T.NOTES + "SELECT chart_id, pos, round(0 / 1000 + round_even(start_s / 0.0625, 0)::INT * 15 / 240.0, 6) AS t FROM notes")
def beat_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = F.rint(F.col("start_s") / timing.GRID_S).cast("int")
    return T.notes(spark, sf_dir).select("chart_id", "pos", F.round(timing.beat_to_time(beat, F.lit(T.BPM), F.lit(T.GAP_MS)), 6).alias("t"))


@Q.add("WITH " + T.NOTES + "SELECT chart_id, pos, greatest(0, round_even((start_s - first) / 0.0625, 0)::INT) AS beat FROM (SELECT *, min(start_s) OVER (PARTITION BY chart_id) AS first FROM notes)")
def time_to_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir).withColumn("first", F.min("start_s").over(Window.partitionBy("chart_id")))
    return rows.select("chart_id", "pos", timing.time_to_beat(F.col("start_s"), F.col("first"), F.lit(T.BPM)).alias("beat"))


@Q.add("WITH " + LINED + "SELECT chart_id, line_no, count(*) AS n_notes, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s FROM lined GROUP BY ALL")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lined(spark, sf_dir).groupBy("chart_id", "line_no")
    return rows.agg(F.count(F.lit(1)).alias("n_notes"), F.round(F.min("start_s"), 6).alias("start_s"), F.round(F.max("end_s"), 6).alias("end_s"))


@Q.add("WITH " + LINED + "SELECT chart_id, pos, round(gap, 3) AS gap_ms FROM (SELECT chart_id, pos, greatest(0, lead(start_s) OVER o - end_s) * 1000 AS gap, lead(start_s) OVER o AS after FROM lined WINDOW o AS (PARTITION BY chart_id, line_no ORDER BY pos)) WHERE after IS NOT NULL")
def intra_line_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.intra_line_gaps(lined(spark, sf_dir)).where("gap_ms IS NOT NULL").select("chart_id", "pos", F.round("gap_ms", 3).alias("gap_ms"))


@Q.add("WITH " + LINED + "SELECT * FROM (SELECT chart_id, pos, abs(pitch - lag(pitch) OVER (PARTITION BY chart_id, line_no ORDER BY pos)) AS step FROM lined) WHERE step IS NOT NULL")
def pitch_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pitch_steps(lined(spark, sf_dir)).where("step IS NOT NULL").select("chart_id", "pos", "step")


@Q.add("WITH " + LINED + LINE_TABLE + "SELECT chart_id, line_no, round(silence_s, 6) AS silence_s FROM silences WHERE NOT head")
def inter_line_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_table(lined(spark, sf_dir)).where("silence_s IS NOT NULL").select("chart_id", "line_no", F.round("silence_s", 6).alias("silence_s"))


FILLED = T.NOTES + """,
filled AS (SELECT chart_id, pos, start_s, end_s, event_id, midi IS NOT NULL AS known,
                  coalesce(last_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 60) AS midi
           FROM notes WINDOW o AS (PARTITION BY chart_id ORDER BY pos))
"""


@Q.add("WITH " + FILLED + "SELECT chart_id, pos, round(midi, 6) AS midi FROM filled")
def ffill_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filled(T.notes(spark, sf_dir), "midi", 60.0).select("chart_id", "pos", F.round("midi", 6).alias("midi"))


@Q.add("WITH " + FILLED + "SELECT chart_id, (round_even(median(midi), 0) - 12)::INT AS pitch_offset FROM filled GROUP BY chart_id")
def pitch_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.filled(T.notes(spark, sf_dir), "midi", 60.0).groupBy("chart_id")
    return rows.agg((F.rint(metrics.median("midi")).cast("int") - 12).alias("pitch_offset"))


REANCHORED = """
w AS (SELECT chart_id, pos, start_s, end_s, pos // 4 AS line_index FROM notes),
x AS (SELECT *, lag(line_index) OVER o AS l0, lead(line_index, 1) OVER o AS l1, lead(line_index, 2) OVER o AS l2,
             lead(start_s, 1) OVER o AS s1, lead(end_s, 1) OVER o AS e1, lead(start_s, 2) OVER o AS s2 FROM w WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
y AS (SELECT *, coalesce(l1 = line_index AND l2 = line_index AND l0 IS DISTINCT FROM line_index AND s1 - end_s > 1.5 AND s2 - e1 <= 1.5, FALSE) AS early FROM x)
SELECT chart_id, pos, early, round(CASE WHEN early THEN greatest(0, s1 - 0.06 - least(end_s - start_s, 1.0)) ELSE start_s END, 6) AS start_s,
       round(CASE WHEN early THEN s1 - 0.06 ELSE end_s END, 6) AS end_s FROM y
"""


@Q.add("WITH " + T.NOTES + "," + REANCHORED)
def reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early first words of lines of four."""
    words = T.notes(spark, sf_dir).select("chart_id", "pos", "start_s", "end_s", F.floor(F.col("pos") / 4).alias("line_index"))
    return S.reanchored(words).select("chart_id", "pos", "early", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


BEATS = """,
beats AS (SELECT chart_id, line_no, min(round_even(start_s / 0.0625, 0))::INT AS first_beat, max(round_even(end_s / 0.0625, 0))::INT AS end_beat FROM lined GROUP BY ALL)
"""


@Q.add("WITH " + LINED + BEATS + "SELECT chart_id, line_no, CASE WHEN b IS NOT NULL THEN least(b, first_beat - 1) END AS break_beat FROM (SELECT *, lag(end_beat) OVER (PARTITION BY chart_id ORDER BY line_no) AS b FROM beats)")
def break_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = lambda c: F.rint(F.col(c) / timing.GRID_S).cast("int")
    lines = lined(spark, sf_dir).groupBy("chart_id", "line_no").agg(F.min(beat("start_s")).alias("first_beat"), F.max(beat("end_s")).alias("end_beat"))
    return S.with_breaks(lines).select("chart_id", "line_no", "break_beat")


@Q.add(
    "WITH " + T.NOTES + """,
p AS (SELECT chart_id, pos, start_s, end_s, generate_subscripts(w, 1)::INT - 1 AS part_index, unnest(w) AS part FROM (SELECT *, string_split(event_type, 'i') AS w FROM notes)),
s AS (SELECT *, greatest(1, length(part)) AS n, sum(greatest(1, length(part))) OVER (PARTITION BY chart_id, pos ORDER BY part_index) AS upto, sum(greatest(1, length(part))) OVER (PARTITION BY chart_id, pos) AS total FROM p)
SELECT chart_id, pos, part_index, round(start_s + (end_s - start_s) * ((upto - n) / total), 6) AS part_start, round(start_s + (end_s - start_s) * (upto / total), 6) AS part_end FROM s"""
)
def proportional_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's span over the parts of its type's name between letters i."""
    parts = T.notes(spark, sf_dir).select("chart_id", "pos", "start_s", "end_s", F.posexplode(F.split("event_type", "i")).alias("part_index", "part"))
    return S.spread(parts).select("chart_id", "pos", "part_index", F.round("part_start", 6).alias("part_start"), F.round("part_end", 6).alias("part_end"))


KEPT = """,
m AS (SELECT *, event_type = 'purchase' AS matched, event_type IN ('view', 'purchase') AS in_vocabulary FROM notes),
r AS (SELECT *, sum(matched::INT) OVER (PARTITION BY chart_id ORDER BY pos) AS run FROM m),
kept AS (SELECT * FROM r WINDOW p AS (PARTITION BY chart_id, run, matched) QUALIFY matched OR run > 0 AND (count(*) OVER p <= 4 OR count(*) FILTER (in_vocabulary) OVER p >= 0.5 * count(*) OVER p))
"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir)
    return rows.withColumns({"matched": F.col("event_type") == "purchase", "in_vocabulary": F.col("event_type").isin("view", "purchase")})


@Q.add("WITH " + T.NOTES + KEPT + "SELECT chart_id, pos, run::BIGINT AS run, matched FROM kept")
def unmatched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are matches, views are in the vocabulary."""
    return S.kept_words(_marked(spark, sf_dir)).select("chart_id", "pos", "run", "matched")


@Q.add("WITH " + T.NOTES + "SELECT chart_id, pos, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN pos END IGNORE NULLS) OVER (PARTITION BY chart_id ORDER BY pos), 0)::INT AS line FROM notes")
def line_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir).withColumn("line", F.when(F.col("event_type") == "purchase", F.col("pos")))
    return S.carried(rows, "line").select("chart_id", "pos", "line")


@Q.add(
    "WITH " + T.NOTES + """,
k AS (SELECT chart_id, pos, CASE WHEN voiced THEN start_s END AS s, CASE WHEN voiced THEN end_s END AS e FROM notes),
x AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, first_value(s IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
             pos = 0 OR lag(s) OVER o IS NOT NULL AS head FROM k WINDOW o AS (PARTITION BY chart_id ORDER BY pos))
SELECT chart_id, pos, round(CASE WHEN s IS NOT NULL THEN s WHEN head THEN b ELSE greatest(coalesce(a, b), b) END, 6) AS start_s, round(coalesce(e, greatest(coalesce(a, b), b)), 6) AS end_s FROM x"""
)
def wedged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of unvoiced events from their neighbours."""
    rows = T.notes(spark, sf_dir).select("chart_id", "pos", *(F.when(F.col("voiced"), F.col(c)).alias(c) for c in ("start_s", "end_s")))
    return S.wedged(rows).select("chart_id", "pos", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


PLACED = """,
b AS (SELECT chart_id, pos, greatest(0, round_even(start_s / 0.0625, 0))::INT AS beat, greatest(0, round_even(end_s / 0.0625, 0))::INT AS endbeat FROM notes),
n AS (SELECT *, lead(beat) OVER (PARTITION BY chart_id ORDER BY pos) AS next_beat FROM b),
RECURSIVE_PLACED AS (
  SELECT chart_id, pos, beat AS start_beat, CASE WHEN next_beat IS NULL THEN greatest(2, endbeat - beat) ELSE greatest(1, least(greatest(2, endbeat - beat), next_beat - beat)) END AS duration FROM n WHERE pos = 0
  UNION ALL
  SELECT n.chart_id, n.pos, greatest(n.beat, p.start_beat + p.duration + 1),
         CASE WHEN next_beat IS NULL THEN greatest(2, endbeat - beat) ELSE greatest(1, least(greatest(2, endbeat - beat), next_beat - greatest(n.beat, p.start_beat + p.duration + 1))) END
  FROM n JOIN RECURSIVE_PLACED p ON n.chart_id = p.chart_id AND n.pos = p.pos + 1)
"""


def in_beats(rows: DataFrame) -> DataFrame:
    zero, bpm = F.lit(0.0), F.lit(T.BPM)
    return rows.withColumns({"beat": timing.time_to_beat(F.col("start_s"), zero, bpm), "endbeat": timing.time_to_beat(F.col("end_s"), zero, bpm)})


@Q.add("WITH RECURSIVE " + T.NOTES + PLACED + "SELECT chart_id, pos::INT AS pos, start_beat, duration FROM RECURSIVE_PLACED")
def note_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrences.placed(in_beats(T.notes(spark, sf_dir)))


@Q.add(
    "WITH RECURSIVE " + LINED.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
f AS (SELECT chart_id, pos, new_line, coalesce(last_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 60) AS midi,
             (event_id % 10)::INT AS n_frames FROM lined WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
g AS MATERIALIZED (SELECT *, lead(midi) OVER o AS after, lead(new_line) OVER o AS after_new FROM f WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
r AS (SELECT chart_id, pos, midi FROM g WHERE pos = 0
      UNION ALL
      SELECT g.chart_id, g.pos, CASE WHEN after IS NOT NULL AND NOT new_line AND NOT after_new AND n_frames < 5 AND abs(g.midi - r.midi) >= 5 AND abs(g.midi - after) >= 5 THEN (r.midi + after) / 2 ELSE g.midi END
      FROM g JOIN r ON g.chart_id = r.chart_id AND g.pos = r.pos + 1)
SELECT chart_id, pos::INT AS pos, round(midi, 6) AS midi FROM r"""
)
def jitter_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last digit of an event's id stands for its count of voiced frames."""
    rows = lined(spark, sf_dir)
    rows = rows.withColumn("new_line", F.coalesce(F.col("line_no") != F.lag("line_no").over(S.in_chart("pos")), F.lit(False))).withColumn("n_frames", (F.col("event_id") % 10).cast("int"))
    out = recurrences.without_jitter(S.filled(rows, "midi", 60.0))
    return out.withColumn("midi", F.round("midi", 6))


#: Where a line from note lo to before note hi is cut; lists count from 1.
CUT = """CASE WHEN (s[{hi}] + d[{hi}] - s[{lo} + 1]) * 0.0625 > 6.0 AND {hi} - {lo} >= 4 THEN list_sort(list_transform(list_filter(range({lo} + 1, {hi}), lambda i: t[i + 1] <> '~'), lambda i: {{'g': s[i] + d[i] - s[i + 1], 'm': abs(i - 1 - ({lo} + ({hi} - {lo}) // 2)), 'i': i}}))[1].i END"""


@Q.add(
    "WITH RECURSIVE " + LINED.replace("> 0.6", "> 3.0") + """,
b AS MATERIALIZED (SELECT chart_id, line_no, pos, greatest(0, round_even(start_s / 0.0625, 0)::INT) AS beat, greatest(1, greatest(0, round_even(end_s / 0.0625, 0)::INT) - greatest(0, round_even(start_s / 0.0625, 0)::INT)) AS dur,
             CASE WHEN kind = 'golden' THEN '~' ELSE 'la' END AS txt, row_number() OVER (PARTITION BY chart_id, line_no ORDER BY pos) - 1 AS i FROM lined),
l AS MATERIALIZED (SELECT chart_id, line_no, list(beat ORDER BY i) AS s, list(dur ORDER BY i) AS d, list(txt ORDER BY i) AS t, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT chart_id, line_no, s, d, t, 0::BIGINT AS lo, n AS hi, """ + CUT.format(lo="0", hi="n") + """ AS cut FROM l
      UNION ALL
      SELECT chart_id, line_no, s, d, t, x.lo, x.hi, """ + CUT.format(lo="x.lo", hi="x.hi") + """ FROM (SELECT chart_id, line_no, s, d, t, unnest([{'lo': lo, 'hi': cut}, {'lo': cut, 'hi': hi}]) AS x FROM c WHERE cut IS NOT NULL))
SELECT b.chart_id, b.pos::INT AS pos, (count(*) - 1)::INT AS part FROM b JOIN c ON c.chart_id = b.chart_id AND c.line_no = b.line_no AND c.cut IS NULL AND c.lo <= b.i GROUP BY b.chart_id, b.pos"""
)
def long_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by silences over 3 s, so that some are long."""
    rows = in_beats(S.with_lines(T.notes(spark, sf_dir), gap=3.0)).withColumn("duration", F.greatest(F.lit(1), F.col("endbeat") - F.col("beat")))
    rows = rows.select("chart_id", "line_no", "pos", F.col("beat").alias("start_beat"), "duration", F.when(F.col("kind") == "golden", "~").otherwise("la").alias("text"))
    return recurrences.short_lines(rows, T.BPM)


@Q.add(
    "WITH RECURSIVE " + LINED.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
f AS (SELECT chart_id, line_no, coalesce(last_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 60) AS midi FROM lined WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
v AS MATERIALIZED (SELECT chart_id, line_no, median(midi) AS value FROM f GROUP BY ALL),
r AS (SELECT chart_id, list(value) AS x, min(value) AS lo, max(value) AS hi, 0 AS k FROM v GROUP BY chart_id
      UNION ALL
      SELECT chart_id, x, coalesce(list_avg(list_filter(x, lambda y: NOT abs(y - hi) < abs(y - lo))), lo), coalesce(list_avg(list_filter(x, lambda y: abs(y - hi) < abs(y - lo))), hi), k + 1 FROM r WHERE k < 25)
SELECT chart_id, line_no::INT AS pos, (abs(value - hi) < abs(value - lo))::INT AS label, round(lo, 6) AS low, round(hi, 6) AS high FROM v JOIN r USING (chart_id) WHERE k = 25"""
)
def register_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two means of the pitches of each chart's lines. Pitches are the SQL's to the last bit: that
    tells which way a line goes that is as far from the lowest as from the highest."""
    rows = lined(spark, sf_dir).withColumn("midi", F.when(F.col("voiced"), arrow.midi_of("f0")))
    rows = S.filled(rows, "midi", 60.0).groupBy("chart_id", "line_no").agg(metrics.median("midi").alias("value"))
    return recurrences.two_registers(rows.withColumn("pos", F.col("line_no").cast("int"))).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@Q.add(
    "WITH RECURSIVE " + T.NOTES.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
f AS (SELECT *, round_even(m, 0) AS near FROM (SELECT chart_id, floor(start_s / 4)::INT AS pos, start_s AS t, f0, 69 + 12 * log2(f0 / 440) AS m FROM notes WHERE f0 > 0) QUALIFY count(*) OVER (PARTITION BY chart_id, pos) >= 8),
g AS (SELECT *, coalesce(near <> lag(near) OVER (PARTITION BY chart_id, pos ORDER BY t, f0), TRUE) AS new FROM f),
h AS (SELECT *, sum(new::INT) OVER (PARTITION BY chart_id, pos ORDER BY t, f0 ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT chart_id, pos, run, min(t) AS a, max(t) AS b, list(m) AS m FROM h GROUP BY ALL),
heads AS (SELECT *, sum((run = 1 OR b - a >= 0.25)::INT) OVER (PARTITION BY chart_id, pos ORDER BY run) AS part FROM runs),
parts AS (SELECT chart_id, pos, part, min(a) AS a, max(b) AS b, flatten(list(m)) AS m FROM heads GROUP BY ALL),
named AS (SELECT *, CASE WHEN part = 1 AND b - a < 0.25 AND count(*) OVER (PARTITION BY chart_id, pos) > 1 THEN 2 ELSE part END AS own FROM parts),
q AS MATERIALIZED (SELECT chart_id, pos, min(a) AS a, flatten(list(m)) AS m, row_number() OVER (PARTITION BY chart_id, pos ORDER BY own) AS k FROM named GROUP BY chart_id, pos, own),
r AS (SELECT chart_id, pos, k, 1 AS no, a, m FROM q WHERE k = 1
      UNION ALL
      SELECT q.chart_id, q.pos, q.k, CASE WHEN same THEN no ELSE no + 1 END, CASE WHEN same THEN q.ra ELSE q.a END, CASE WHEN same THEN list_concat(q.rm, q.m) ELSE q.m END
      FROM (SELECT q.*, r.no, r.a AS ra, r.m AS rm, round_even(list_aggregate(q.m, 'median'), 0) = round_even(list_aggregate(r.m, 'median'), 0) AS same FROM q JOIN r ON q.chart_id = r.chart_id AND q.pos = r.pos AND q.k = r.k + 1) q),
d AS (SELECT * FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY chart_id, pos, no ORDER BY k DESC) = 1) QUALIFY count(*) OVER (PARTITION BY chart_id, pos) >= 2)
SELECT chart_id, pos, no - 1 AS part, round(CASE WHEN no = 1 THEN pos * 4.0 ELSE a END, 6) AS part_start, round(coalesce(lead(a) OVER (PARTITION BY chart_id, pos ORDER BY no), pos * 4.0 + 4), 6) AS part_end, round(list_aggregate(m, 'median'), 6) AS midi FROM d"""
)
def held_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sustained pitches over windows of four chart seconds, all events voiced."""
    rows = T.notes(spark, sf_dir).where("f0 > 0").withColumn("pos", F.floor(F.col("start_s") / 4).cast("int"))
    rows = rows.select("chart_id", "pos", (F.col("pos") * 4.0).alias("start_s"), (F.col("pos") * 4.0 + 4).alias("end_s"), F.col("start_s").alias("t"), "f0")
    out = recurrences.held_parts(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("part_start", "part_end", "midi")})
