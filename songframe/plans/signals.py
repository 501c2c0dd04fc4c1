"""Queries on what models would hear: letter scores, samples and vectors, all made from
the tables by Spark, and what the operators make of them."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.functions import sql, timing
from songframe.operators import letter_alignment, note_events, pitch_track, recurrences, sample_blocks, speakers, storage, tempo
from songframe.plans import tables as T
from songframe.plans.book import Book
from songframe.sources import sounds
from songframe.streaming import status

Q = Book()

#: Seconds of a frame of letter scores.
HOP_S = 0.02


def sung_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, pos, word): every sixteenth event's type is a word of the chart, with its
    value where that is even, which has no letters."""
    rows = T.notes(spark, sf_dir).where("pos % 16 = 0").select("chart_id", (F.col("pos") / 16).cast("int").alias("pos"), "event_type", "event_id")
    return rows.select("chart_id", "pos", F.when(F.col("event_id") % 7 == 0, F.concat(F.col("event_id").cast("string"), F.lit("!"))).otherwise(F.initcap("event_type")).alias("word"))


def letter_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, frame, scores): an event is a frame; scores are noise, of which some letter of
    the word that its time belongs to has less. Multiples of 1/64, so that sums are exact."""
    rows = T.notes(spark, sf_dir)
    word = F.first_value("event_type").over(T.Window.partitionBy("chart_id", F.floor(F.col("pos") / 16)).orderBy("pos"))
    rows = rows.withColumn("word", word)
    letter = F.substring("word", (F.col("pos") % 16 * F.char_length("word") / 16).cast("int") + 1, 1)
    number = F.ascii(letter) - 96
    noise = lambda k: (F.col("event_id") * 7919 + k * 104729) % 251 + F.when(k == number, 0).otherwise(96)
    scores = F.transform(F.sequence(F.lit(0), F.lit(len(letter_alignment.LETTERS))), lambda k: -noise(k) / 64.0)
    return rows.select("chart_id", F.col("pos").alias("frame"), scores.alias("scores"))


#: CTEs z (letters of the words), x (states), em (scores) and way (best scores and steps of every frame).
TRELLIS = T.NOTES.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
words AS MATERIALIZED (SELECT chart_id, (pos // 16)::INT AS pos, CASE WHEN event_id % 7 = 0 THEN event_id::VARCHAR || '!' ELSE upper(event_type[1]) || event_type[2:] END AS word,
                 CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS norm FROM notes WHERE pos % 16 = 0),
fit AS (SELECT chart_id FROM words GROUP BY ALL HAVING avg((norm <> '')::INT) >= 0.8),
z AS MATERIALIZED (SELECT chart_id, string_agg(norm, '' ORDER BY pos) AS z FROM words SEMI JOIN fit USING (chart_id) GROUP BY chart_id),
em AS MATERIALIZED (SELECT chart_id, pos AS frame, list_transform(range(27), lambda k: -((event_id * 7919 + k * 104729) % 251 + CASE WHEN k = ascii(word[floor(pos % 16 * length(word) / 16)::INT + 1]) - 96 THEN 0 ELSE 96 END) / 64.0) AS s
                    FROM (SELECT *, first_value(event_type) OVER (PARTITION BY chart_id, pos // 16 ORDER BY pos) AS word FROM notes)),
x AS MATERIALIZED (SELECT chart_id, list_transform(range(2 * length(z) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 0 ELSE ascii(z[i // 2 + 1]) - 96 END) AS sym FROM z WHERE length(z) > 0),
way AS (SELECT chart_id, 0::BIGINT AS frame, sym, list_transform(range(len(sym)), lambda i: CASE WHEN i < 2 THEN s[sym[i + 1] + 1] ELSE '-infinity'::DOUBLE END) AS v, CAST([] AS INT[]) AS back
        FROM x JOIN em USING (chart_id) WHERE frame = 0
        UNION ALL
        SELECT w.chart_id, w.frame + 1, sym, list_transform(range(len(sym)), lambda i: greatest(v[i + 1], coalesce(v[i], '-infinity'), CASE WHEN i % 2 = 1 AND i >= 3 AND sym[i + 1] <> sym[i - 1] THEN v[i - 1] ELSE '-infinity'::DOUBLE END) + s[sym[i + 1] + 1]),
               list_transform(range(len(sym)), lambda i: CASE WHEN i % 2 = 1 AND i >= 3 AND sym[i + 1] <> sym[i - 1] AND v[i - 1] > greatest(v[i + 1], v[i]) THEN 2 WHEN i >= 1 AND v[i] > v[i + 1] THEN 1 ELSE 0 END::INT)
        FROM way w JOIN em ON em.chart_id = w.chart_id AND em.frame = w.frame + 1),
steps AS MATERIALIZED (SELECT chart_id, frame, back, v, sym FROM way),
ends AS (SELECT chart_id, max(frame) AS frame FROM steps GROUP BY ALL),
path AS (SELECT chart_id, frame, back, CASE WHEN v[len(sym) - 1] > v[len(sym)] THEN len(sym) - 1 ELSE len(sym) END AS state FROM steps SEMI JOIN ends USING (chart_id, frame) WHERE greatest(v[len(sym) - 1], v[len(sym)]) > '-infinity'::DOUBLE
         UNION ALL
         SELECT p.chart_id, s.frame, s.back, p.state - p.back[p.state] FROM path p JOIN steps s ON s.chart_id = p.chart_id AND s.frame = p.frame - 1),
letters AS (SELECT chart_id, state // 2 - 1 AS k, min(frame) AS a, max(frame) + 1 AS b, sum(exp(s[sym[state] + 1])) AS p FROM path JOIN em USING (chart_id, frame) JOIN x USING (chart_id) WHERE state % 2 = 0 GROUP BY ALL),
owned AS (SELECT chart_id, pos, norm, sum(length(norm)) OVER (PARTITION BY chart_id ORDER BY pos) - length(norm) AS skip FROM words),
times AS (SELECT o.chart_id, o.pos, min(a) * 0.02::DOUBLE AS s, max(b) * 0.02::DOUBLE AS e, sum(p) / sum(b - a) AS score, string_agg(a || '-' || b, ' ' ORDER BY k) AS spans FROM owned o JOIN letters l ON l.chart_id = o.chart_id AND l.k >= skip AND l.k < skip + length(norm) GROUP BY ALL),
told AS (SELECT w.chart_id, w.pos, w.word, s, e, coalesce(score, 0) AS score, coalesce(spans, '') AS spans FROM words w LEFT JOIN times t ON t.chart_id = w.chart_id AND t.pos = w.pos WHERE w.chart_id IN (SELECT chart_id FROM times)),
near AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, first_value(s IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
                pos = 0 OR lag(s) OVER o IS NOT NULL AS head FROM told WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
aligned AS (SELECT chart_id, pos, word, CASE WHEN s IS NOT NULL THEN s WHEN head THEN b ELSE greatest(coalesce(a, b), b) END AS start_s, coalesce(e, greatest(coalesce(a, b), b)) AS end_s, score, spans FROM near)
"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letter_alignment.aligned_words(letter_frames(spark, sf_dir), sung_words(spark, sf_dir), HOP_S)


@Q.add("WITH RECURSIVE " + TRELLIS + "SELECT chart_id, pos, word, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(score, 6) AS score, spans FROM aligned")
def forced_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their times and the first and last frame of each letter."""
    frame = lambda t: F.rint(t / HOP_S).cast("int").cast("string")
    spans = F.array_join(F.transform("char_spans", lambda x: F.concat(frame(x["s"]), F.lit("-"), frame(x["e"]))), " ")
    return _aligned(spark, sf_dir).select("chart_id", "pos", "word", *(F.round(c, 6).alias(c) for c in ("start_s", "end_s", "score")), spans.alias("spans"))


@Q.add(
    "WITH RECURSIVE " + TRELLIS + """,
song AS (SELECT chart_id, avg(score) AS score, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM notes v WHERE v.voiced AND v.chart_id = a.chart_id AND v.pos * 0.02 >= a.start_s - 0.05 AND v.pos * 0.02 < a.end_s + 0.05)) AS hit
         FROM aligned a WHERE score > 0 GROUP BY chart_id)
SELECT chart_id, round(score, 6) AS score, n, hit, score >= 0.15 AND hit >= 0.85 * n AS passes FROM song"""
)
def alignment_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which alignments can be believed; an event's pitch is that of its frame."""
    frames = T.notes(spark, sf_dir).select("chart_id", (F.col("pos") * HOP_S).alias("t"), "f0", "conf")
    return letter_alignment.trusted(_aligned(spark, sf_dir), frames).withColumn("score", F.round("score", 6))


#: Samples a second, samples of an event, and how pitch is looked for in these.
RATE, EVENT_SAMPLES = 8000, 32 * 32
PITCH = pitch_track.Settings(rate=RATE, hop=256, window=512)


def event_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, at, true): each event is a block of a tone with two overtones at its frequency, or
    of silence."""
    return T.notes(spark, sf_dir).select("chart_id", (F.col("pos") * EVENT_SAMPLES).alias("at"), F.col("f0").alias("true"))


def tones(rows: pa.Table) -> sample_blocks.Blocks:
    """The samples of event_tones(): sin(x) + sin(2x + 1) / 2 + sin(3x + 2) / 4, from the turns of
    a sample and of 32."""
    i, second, third = np.arange(32), 0.5 * np.exp(1j), 0.25 * np.exp(2j)
    for at, f0 in zip(rows["at"].to_pylist(), rows["true"].to_pylist(), strict=True):
        turn = 2j * math.pi * f0 / RATE
        z = np.multiply.outer(np.exp(turn * 32 * i), np.exp(turn * i)).ravel()
        yield at, (z * (1 + z * (second + third * z))).imag.astype(np.float32)


@Q.add("WITH " + T.NOTES + "SELECT chart_id, pos * 4 + k AS frame, round((pos * 4 + k) * 0.032::DOUBLE, 6) AS t, f0 > 0 AS voiced, CASE WHEN f0 > 0 THEN TRUE END AS near FROM notes, (SELECT unnest([0, 1]) AS k)")
def pitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that see one event only: have they a pitch, and is it within a semitone of the
    event's? The SQL states what was rendered."""
    rows = pitch_track.pitch_track_in_place(event_tones(spark, sf_dir), tones, PITCH, keep="true").where("frame % 4 < 2")
    near = F.when(F.col("f0") > 0, F.abs(timing.midi_of(F.col("f0")) - timing.midi_of(F.col("true"))) < 1)
    return rows.select("chart_id", "frame", F.round("t", 6).alias("t"), timing.voiced(F.col("f0"), F.col("conf")).alias("voiced"), near.alias("near"))


#: Samples a second and of an event, where an event is half a second of a beat.
BEAT_RATE, BEAT_SAMPLES = 2000, 1024
TEMPO = tempo.Settings(rate=BEAT_RATE, hop=32, window=128)


def event_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, at): each event is a block of clicks at a tempo that the chart's number gives."""
    return T.notes(spark, sf_dir).select("chart_id", (F.col("pos") * BEAT_SAMPLES).alias("at"))


def clicks(rows: pa.Table) -> sample_blocks.Blocks:
    """The samples of event_clicks(): exp(-40 x) sin(800 pi x), x seconds after a click."""
    chart = rows["chart_id"][0].as_py()
    if chart is None:
        return
    beat, fades = 60.0 / (70.0 + math.fmod(chart * 37, 100)), -40 + 800j * math.pi
    i, at = np.arange(BEAT_SAMPLES), rows["at"].to_numpy()
    table = np.exp(fades * i / BEAT_RATE)
    for own in np.split(at, range(32, len(at), 32)):
        after = np.mod((own[:, None] + i) / BEAT_RATE, beat).ravel()
        new = np.concatenate(([True], after[1:] < after[:-1]))
        new[::BEAT_SAMPLES] = True
        starts = np.flatnonzero(new)
        lasts = np.diff(starts, append=len(after))
        x = (np.repeat(np.exp(fades * after[starts]), lasts) * table[np.arange(len(after)) - np.repeat(starts, lasts)]).imag
        yield from zip(own.tolist(), x.astype(np.float32).reshape(-1, BEAT_SAMPLES), strict=True)


@Q.add("SELECT DISTINCT user_id AS chart_id, 70.0::DOUBLE + user_id * 37 % 100 AS true_bpm, TRUE AS within FROM events")
def tempo_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the tempo that is heard, in its octave, within 2 percent of the clicks'? The SQL states what was rendered."""
    true = 70.0 + F.col("chart_id") * 37 % 100
    return tempo.tempo_in_place(event_clicks(spark, sf_dir), clicks, TEMPO).select("chart_id", true.alias("true_bpm"), F.coalesce(timing.tempo_deviation(F.col("bpm"), true, None) < 0.02, F.lit(False)).alias("within"))


#: Windows of a chart, and the mean cosine distance up to which voices are one.
CHART_WINDOWS, VOICE_LIMIT = 25, 0.85


def voice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, pos, start_s, end_s, vector): 25 vectors are a chart, one every second and a half, each
    of two seconds."""
    rows = T.read(spark, sf_dir, "embeddings")
    pos = (F.col("vec_id") % CHART_WINDOWS).cast("int")
    return rows.select(F.floor(F.col("vec_id") / CHART_WINDOWS).alias("chart_id"), pos.alias("pos"), (pos * 1.5).alias("start_s"), (pos * 1.5 + 2).alias("end_s"), F.col("embedding").alias("vector"))


#: CTE named: speakers of windows, by merging the closest pair of clusters again and again.
VOICES = """
w AS MATERIALIZED (SELECT vec_id // 25 AS chart_id, (vec_id % 25)::INT AS pos, embedding::DOUBLE[] AS v FROM embeddings),
apart AS MATERIALIZED (SELECT a.chart_id, a.pos AS i, b.pos AS j, 1 - list_cosine_similarity(a.v, b.v) AS d FROM w a JOIN w b USING (chart_id) WHERE a.pos <> b.pos),
groups AS (SELECT chart_id, 0 AS step, pos, pos AS own FROM w
           UNION ALL
           SELECT g.chart_id, g.step + 1, g.pos, CASE WHEN g.own = m.pair.b THEN m.pair.a ELSE g.own END
           FROM groups g JOIN (SELECT chart_id, arg_min({'a': a, 'b': b}, d) AS pair, min(d) AS d
                               FROM (SELECT x.chart_id, x.own AS a, y.own AS b, avg(d) AS d FROM groups x JOIN apart p ON p.chart_id = x.chart_id AND p.i = x.pos JOIN groups y ON y.chart_id = x.chart_id AND y.pos = p.j
                                     WHERE x.own < y.own GROUP BY ALL) GROUP BY chart_id) m ON m.chart_id = g.chart_id AND {stop}),
last AS (SELECT chart_id, pos, own FROM groups QUALIFY step = max(step) OVER (PARTITION BY chart_id)),
named AS (SELECT chart_id, pos, chr((64 + dense_rank() OVER (PARTITION BY chart_id ORDER BY own))::INT) AS speaker FROM last)
"""


@Q.add("WITH RECURSIVE " + VOICES.replace("{stop}", f"m.d <= {VOICE_LIMIT}") + "SELECT * FROM named")
def voice_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.speakers(voice_windows(spark, sf_dir), limit=VOICE_LIMIT)


@Q.add(
    "WITH RECURSIVE " + VOICES.replace("{stop}", "g.step < (SELECT count(*) FROM w WHERE w.chart_id = g.chart_id) - 2") + """,
c AS (SELECT *, coalesce(speaker <> lag(speaker) OVER (PARTITION BY chart_id ORDER BY pos), FALSE) AS new FROM named),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY chart_id ORDER BY pos) AS seg FROM c)
SELECT chart_id, seg::INT AS seg, min(pos) * 1.5::DOUBLE AS s, max(pos) * 1.5::DOUBLE + 2 AS e, min(speaker) AS speaker FROM s GROUP BY chart_id, seg"""
)
def voice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of two speakers."""
    windows = voice_windows(spark, sf_dir)
    named = speakers.speakers(windows, number=2)
    return speakers.segments(windows.select("chart_id", "pos", "start_s", "end_s").join(named, ["chart_id", "pos"]))


#: Frames of an event in the grid, and between the onsets of two.
GRID_FRAMES, GRID_STEP = 14, 4


def loudness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, frame, midi, amplitude, onset): events of a chart sound one after the other
    in twelve semitones, overlapping, with a loudness that a hash gives to each frame."""
    rows = T.notes(spark, sf_dir).select("chart_id", "pos", "event_id", (48 + F.col("event_id") % 12).cast("int").alias("midi"), F.explode(F.sequence(F.lit(0), F.lit(GRID_FRAMES - 1))).alias("k"))
    loud = ((F.col("event_id") * 31 + F.col("k") * F.col("k") * 7) % 64 + F.when(F.col("event_id") % 3 == 0, 36).otherwise(0)) / 100.0
    onset = F.when(F.col("k") == 0, (F.col("event_id") % 10) / 10.0).otherwise(0.0)
    return rows.select("chart_id", (F.col("pos") * GRID_STEP + F.col("k")).alias("frame"), "midi", loud.alias("amplitude"), onset.alias("onset"))


GRID = T.NOTES + f""",
raw AS (SELECT chart_id, pos * {GRID_STEP} + k AS frame, (48 + event_id % 12)::INT AS midi, ((event_id * 31 + k * k * 7) % 64 + CASE WHEN event_id % 3 = 0 THEN 36 ELSE 0 END) / 100.0::DOUBLE AS amplitude,
               CASE WHEN k = 0 THEN event_id % 10 / 10.0::DOUBLE ELSE 0.0 END AS onset FROM notes, (SELECT unnest(range({GRID_FRAMES})) AS k)),
loud AS (SELECT chart_id, midi, frame, max(amplitude) AS amplitude, max(onset) AS onset FROM raw WHERE amplitude >= 0.3 GROUP BY ALL),
o AS (SELECT *, coalesce(frame - lag(frame) OVER w > 1 OR (onset >= 0.5 AND lag(onset) OVER w < 0.5), TRUE)::INT AS new FROM loud WINDOW w AS (PARTITION BY chart_id, midi ORDER BY frame)),
st AS (SELECT *, sum(new) OVER (PARTITION BY chart_id, midi ORDER BY frame) AS stretch FROM o),
sung AS (SELECT chart_id, midi, min(frame) AS a, max(frame) + 1 AS b, avg(amplitude) AS amplitude, max(amplitude) AS peak FROM st GROUP BY chart_id, midi, stretch HAVING max(amplitude) >= 0.5 AND max(frame) - min(frame) >= 5)
"""


@Q.add("WITH " + GRID + "SELECT chart_id, (row_number() OVER (PARTITION BY chart_id ORDER BY a, midi) - 1)::INT AS pos, round(a * 0.016::DOUBLE, 6) AS start_s, round(b * 0.016::DOUBLE, 6) AS end_s, midi, round(amplitude, 6) AS amplitude, peak FROM sung")
def grid_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = note_events.note_events(loudness_grid(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s", "amplitude")})


@Q.add("WITH " + GRID + ", f AS (SELECT chart_id, midi, unnest(range(a, b)) AS frame FROM sung) SELECT chart_id, midi::VARCHAR AS speaker, frame::INT AS frame FROM f")
def grid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the grid turned back into frames, each semitone a voice of its own: the
    frames that the notes were found in."""
    found = note_events.note_events(loudness_grid(spark, sf_dir)).withColumn("speaker", F.col("midi").cast("string"))
    return recurrences.rasterized(found, silence=False).where("f0 > 0").select("chart_id", "speaker", "frame")


@Q.add("SELECT user_id AS chart_id, count(*) * 0.512::DOUBLE AS seconds, count(*) * 1536 AS samples, TRUE AS within FROM events GROUP BY user_id")
def sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clicks of every chart as a file; its length by its head, its samples at another
    rate, and whether the tempo of those is still the clicks'."""
    path, rate = storage.new_place(spark, "sounds"), BEAT_RATE * 3 // 2
    sounds.write_sounds(event_clicks(spark, sf_dir), path, BEAT_RATE, read=clicks)
    chart = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("chart_id")
    files = sounds.found(spark, path).repartition("path")  # a task lists many
    true = 70.0 + F.col("chart_id") * 37 % 100
    heard = tempo.tempo_in_place(files.select(chart, "path", "length"), sounds.reader(rate, block=8192), tempo.Settings(rate=rate, hop=48, window=192))
    beats = heard.select("chart_id", F.col("n_samples").alias("samples"), F.coalesce(timing.tempo_deviation(F.col("bpm"), true, None) < 0.02, F.lit(False)).alias("within"))
    return sounds.lengths(files).select(chart, "seconds").join(beats, "chart_id")


@Q.add("WITH RECURSIVE " + VOICES.replace("{stop}", f"m.d <= {VOICE_LIMIT}") + "SELECT * FROM named")
def sql_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers again, by a table function."""
    sql.register(spark)
    windows = voice_windows(spark, sf_dir).select("chart_id", "pos", "vector")
    return spark.sql("SELECT * FROM voice_speakers({limit}, TABLE({windows}) PARTITION BY chart_id ORDER BY pos)", limit=VOICE_LIMIT, windows=windows)


@Q.add(
    "WITH " + T.NOTES + """, b AS (SELECT *, 60 + chart_id % 180 AS bpm, value, pos % 5 AS words FROM notes JOIN (SELECT event_id, value FROM events) USING (event_id))
SELECT chart_id, pos, round(1.2 + pos * 15.0 / bpm, 6) AS t, greatest(0, round_even((start_s - 0.5) * bpm / 15.0, 0)::INT) AS beat, round(greatest(0, start_s * 1000 - 200), 6) AS gap, round(CASE WHEN f0 > 0 THEN 69 + 12 * log2(f0 / 440) END, 6) AS midi,
       round(440 * 2 ** ((pos - 69) / 12.0), 6) AS hz, conf > 0.5 AND f0 > 0 AS voiced, round(least(end_s, 30) - greatest(start_s, 10), 6) AS overlap, round(CASE WHEN words > 0 THEN value / words ELSE 0 END, 6) AS ratio,
       CASE WHEN value > 0 THEN 2.0 ** round_even(log2(bpm / value), 0) END AS multiple, coalesce(start_s > 60 AND words / (start_s / 60) < 15, FALSE) AS few FROM b"""
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of time and pitch, called from SQL."""
    sql.register(spark)
    values = T.read(spark, sf_dir, "events").select("event_id", "value")
    rows = T.notes(spark, sf_dir).join(values, "event_id").withColumns({"bpm": 60 + F.col("chart_id") % 180, "words": F.col("pos") % 5})
    return spark.sql(
        """SELECT chart_id, pos, round(beat_to_time(pos, bpm, 1200), 6) AS t, time_to_beat(start_s, 0.5, bpm) AS beat, round(gap_of(start_s), 6) AS gap, round(CASE WHEN f0 > 0 THEN midi_of(f0) END, 6) AS midi, round(hz_of(pos), 6) AS hz,
        voiced(f0, conf) AS voiced, round(overlap_of(start_s, end_s, 10, 30), 6) AS overlap, round(ratio_of(value, words), 6) AS ratio, tempo_multiple(value, bpm) AS multiple, few_words(words, start_s) AS few FROM {rows}""",
        rows=rows,
    )


#: Where an event says that a song stands, and how long no news are good news.
SAYS = {"view": "queued", "signup": "queued", "click": "running", "purchase": "done", "error": "failed"}
NEWS_S = 6 * 3600


@Q.add(
    f"""WITH e AS (SELECT DISTINCT user_id AS song, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000 AS ms, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 0 END AS k FROM events),
n AS (SELECT *, ['queued', 'running', 'done', 'failed'][k + 1] AS status, lead(ms) OVER (PARTITION BY song ORDER BY ms, k) AS next FROM e)
SELECT song, ms, status FROM n UNION ALL SELECT song, ms + {NEWS_S * 1000}, 'timed out' FROM n WHERE k < 2 AND (next IS NULL OR next > ms + {NEWS_S * 1000})"""
)
def song_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each song and when, timeouts included, in milliseconds from the start of the year."""
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    says = F.element_at(F.create_map(*(F.lit(x) for pair in SAYS.items() for x in pair)), F.col("event_type"))
    events = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("song"), F.timestamp_micros(ms).alias("at"), says.alias("status"))
    return status.statuses_of(events, dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc), NEWS_S).select("song", F.unix_millis("at").alias("ms"), "status")
