"""Queries on whole charts: text, words, rules, assembly, scores; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.functions.arrow import decoded
from songframe.operators import assembly, evaluation, manifest, profiling, recurrences, storage, validation
from songframe.operators import sequences as S
from songframe.operators.storage import kept, new_place
from songframe.plans import tables as T
from songframe.plans.book import Book
from songframe.plans.joins import PAIRINGS
from songframe.plans.measures import MATCHED
from songframe.plans.sequences import LINED, in_beats, lined
from songframe.sources import chart_text, library, packed

Q = Book()

#: Charts of events: lines by silences, the second track from signups, beats unplaced.
CHART = LINED + """,
c AS (SELECT chart_id, pos, line_no, (event_type = 'signup')::INT AS track, greatest(0, round_even(start_s / 0.0625, 0)::INT) AS start_beat,
             (greatest(0, round_even(end_s / 0.0625, 0)::INT) - greatest(0, round_even(start_s / 0.0625, 0)::INT)) AS duration, pitch, 'x' || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END AS text,
             CASE event_type WHEN 'purchase' THEN 'golden' WHEN 'error' THEN 'freestyle' ELSE 'normal' END AS kind FROM lined),
l AS (SELECT *, dense_rank() OVER (PARTITION BY chart_id, track ORDER BY line_no) - 1 AS n FROM c),
chart_notes AS (SELECT chart_id, track, n AS line_no, row_number() OVER (PARTITION BY chart_id, track, n ORDER BY pos) - 1 AS note_index, CASE WHEN n > 0 THEN min(start_beat) OVER (PARTITION BY chart_id, track, n) END AS break_beat, start_beat, duration, pitch, text, kind FROM l)
"""


def charts_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = in_beats(lined(spark, sf_dir)).withColumn("track", (F.col("event_type") == "signup").cast("int"))
    rows = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("chart_id", "track").orderBy("line_no")) - 1)
    line = Window.partitionBy("chart_id", "track", "n")
    kind = F.when(F.col("event_type") == "purchase", "golden").when(F.col("event_type") == "error", "freestyle").otherwise("normal")
    notes = rows.select(
        "chart_id", "track", F.col("n").alias("line_no"), (F.row_number().over(line.orderBy("pos")) - 1).alias("note_index"), F.when(F.col("n") > 0, F.min("beat").over(line)).alias("break_beat"),
        F.col("beat").alias("start_beat"), (F.col("endbeat") - F.col("beat")).alias("duration"), "pitch", F.concat(F.lit("x"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("")).alias("text"), kind.alias("kind"),
    )
    charts = notes.select("chart_id").distinct().select(
        "chart_id", F.concat(F.lit("Song "), "chart_id").alias("title"), F.when(F.col("chart_id") % 4 == 0, " ").otherwise("Ana y Beto").alias("artist"), F.lit("test").alias("creator"),
        F.when(F.col("chart_id") % 6 != 0, "a.mp3").alias("audio"), F.when(F.col("chart_id") % 5 == 0, 0.5).otherwise(240.04).alias("bpm"), F.lit(1200.0).alias("gap_ms"),
    )
    return charts, notes


@Q.add("WITH " + CHART + "SELECT chart_id::BIGINT AS chart_id, track, line_no::INT AS line_no, note_index::INT AS note_index, break_beat, start_beat, duration, pitch, text, kind FROM chart_notes WHERE duration >= 0")
def chart_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts written as text and read again, duets with their tracks."""
    files = chart_text.rendered(*charts_of(spark, sf_dir))
    return chart_text.notes(files, keep_tracks=True).where("duration >= 0")


@Q.add(
    "WITH " + CHART + """,
t AS (SELECT chart_id, track, line_no, concat_ws(chr(10), '- ' || max(break_beat), string_agg(CASE kind WHEN 'golden' THEN '*' WHEN 'freestyle' THEN 'F' ELSE ':' END || ' ' || start_beat || ' ' || duration || ' ' || pitch || ' ' || text, chr(10) ORDER BY note_index)) AS s FROM chart_notes GROUP BY ALL),
k AS (SELECT chart_id, track, string_agg(s, chr(10) ORDER BY line_no) AS s FROM t GROUP BY ALL),
b AS (SELECT chart_id, max(track) > 0 AS duet, string_agg(CASE WHEN any_duet THEN 'P' || (track + 1) || chr(10) || s ELSE s END, chr(10) ORDER BY track) AS body FROM (SELECT *, max(track) OVER (PARTITION BY chart_id) > 0 AS any_duet FROM k) GROUP BY chart_id)
SELECT chart_id, concat_ws(chr(10), '#TITLE:Song ' || chart_id, '#ARTIST:' || CASE WHEN chart_id % 4 = 0 THEN ' ' ELSE 'Ana y Beto' END, '#CREATOR:test', '#MP3:' || CASE WHEN chart_id % 6 <> 0 THEN 'a.mp3' ELSE '' END, '#AUDIO:' || CASE WHEN chart_id % 6 <> 0 THEN 'a.mp3' ELSE '' END,
       CASE WHEN duet THEN '#P1:P1' END, CASE WHEN duet THEN '#P2:P2' END, '#BPM:' || CASE WHEN chart_id % 5 = 0 THEN '0.5' ELSE '240.04' END, '#GAP:1200', body, 'E') || chr(10) AS text FROM b"""
)
def chart_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_text.rendered(*charts_of(spark, sf_dir))


@Q.add("WITH " + CHART + "SELECT chart_id, 'Song ' || chart_id AS title, CASE WHEN chart_id % 4 = 0 THEN '' ELSE 'Ana y Beto' END AS artist, CASE WHEN chart_id % 5 = 0 THEN 0.5 ELSE 240.04 END::DOUBLE AS bpm, 1200::DOUBLE AS gap_ms, CASE WHEN chart_id % 6 <> 0 THEN 'a.mp3' ELSE '' END AS audio FROM (SELECT DISTINCT chart_id FROM chart_notes)")
def chart_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = chart_text.rendered(*charts_of(spark, sf_dir))
    return chart_text.headers(files).select("chart_id", "title", "artist", "bpm", "gap_ms", "audio")


@Q.add(
    "WITH RECURSIVE " + CHART.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
h AS (SELECT DISTINCT chart_id FROM chart_notes),
n AS MATERIALIZED (SELECT chart_id, track, line_no, note_index, duration, kind, start_beat - CASE WHEN start_beat % 4 = 1 THEN 60 ELSE 0 END AS beat, row_number() OVER (PARTITION BY chart_id, track ORDER BY line_no, note_index) AS k FROM chart_notes WHERE chart_id % 11 <> 0),
r AS (SELECT chart_id, track, k, CASE WHEN beat < -1 THEN -1 ELSE beat END AS last, CASE WHEN beat < -1 OR duration < 1 THEN line_no END AS bad, line_no, CASE WHEN beat < -1 THEN 'beat order' WHEN duration < 1 THEN 'duration' END AS rule FROM n WHERE k = 1
      UNION ALL
      SELECT chart_id, track, k, CASE WHEN skip OR beat < last THEN last ELSE beat END, CASE WHEN NOT skip AND (beat < last OR duration < 1) THEN line_no ELSE bad END, line_no, CASE WHEN skip THEN NULL WHEN beat < last THEN 'beat order' WHEN duration < 1 THEN 'duration' END
      FROM (SELECT n.*, r.last, r.bad, n.line_no IS NOT DISTINCT FROM r.bad AS skip FROM n JOIN r ON n.chart_id = r.chart_id AND n.track = r.track AND n.k = r.k + 1))
SELECT chart_id, NULL::INT AS track, NULL::INT AS line_no, 'artist' AS rule FROM h WHERE chart_id % 4 = 0
UNION ALL SELECT chart_id, NULL, NULL, 'title' FROM h WHERE chart_id % 7 = 0
UNION ALL SELECT chart_id, NULL, NULL, 'audio' FROM h WHERE chart_id % 6 = 0
UNION ALL SELECT chart_id, NULL, NULL, 'bpm' FROM h WHERE chart_id % 5 = 0
UNION ALL SELECT chart_id, NULL, NULL, 'no notes' FROM h WHERE chart_id % 11 = 0
UNION ALL SELECT chart_id, NULL, NULL, 'all freestyle' FROM n GROUP BY chart_id HAVING bool_and(kind = 'freestyle')
UNION ALL SELECT chart_id, track, line_no::INT, rule FROM r WHERE rule IS NOT NULL"""
)
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh chart has a blank title, every eleventh no notes, and notes on certain
    beats come early."""
    charts, notes = charts_of(spark, sf_dir)
    charts = charts.withColumn("title", F.when(F.col("chart_id") % 7 == 0, "\t ").otherwise(F.col("title")))
    early = F.when(F.col("start_beat") % 4 == 1, 60).otherwise(0)
    return validation.problems(charts, notes.where("chart_id % 11 <> 0").withColumn("start_beat", F.col("start_beat") - early))


WORDS = CHART + """,
w AS (SELECT *, coalesce(lag(text LIKE '% ') OVER (PARTITION BY chart_id, track, line_no ORDER BY note_index), TRUE) AS head FROM chart_notes),
v AS (SELECT *, sum(head::INT) OVER (PARTITION BY chart_id, track, line_no ORDER BY note_index) AS word_no FROM w)
"""


@Q.add("WITH " + WORDS + "SELECT chart_id, line_no::INT AS line_no, word_no::BIGINT AS word_no, repeat('x', count(*)) AS text, count(*)::INT AS n_syllables, min(start_beat)::DOUBLE AS start_s, max(start_beat + duration)::DOUBLE AS end_s FROM v WHERE track = 0 GROUP BY chart_id, line_no, word_no")
def song_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the first track; a note is a syllable and beats stand for seconds."""
    _, notes = charts_of(spark, sf_dir)
    rows = notes.where("track = 0").select("chart_id", "line_no", "note_index", "text", F.col("start_beat").cast("double").alias("start_s"), (F.col("start_beat") + F.col("duration")).cast("double").alias("end_s"))
    out = S.word_table(S.song_words(rows))
    return out.select("chart_id", "line_no", "word_no", "text", F.size("syllables").alias("n_syllables"), "start_s", "end_s")


@Q.add(
    """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS keys, replace(p_name, ' ', '') AS norm FROM part),
b AS (SELECT p_partkey, generate_subscripts(keys, 1)::INT - 1 AS part_index, unnest(keys) AS k FROM p),
c AS (SELECT *, sum(length(k)) OVER (PARTITION BY p_partkey ORDER BY part_index) AS upto FROM b)
SELECT p_partkey, part_index, round(greatest(0.15::DOUBLE, (upto - length(k)) * 0.1::DOUBLE), 6) AS s, round((upto - 1) * 0.1::DOUBLE + 0.1::DOUBLE, 6) AS e FROM c"""
)
def letter_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a part's name as syllables, a tenth of a second a letter, from 0.15 s on."""
    rows = T.read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("keys"), F.replace("p_name", F.lit(" "), F.lit("")).alias("norm"))
    spans = F.transform(F.sequence(F.lit(0), F.char_length("norm") - 1), lambda i: F.struct((i * 0.1).alias("s"), (i * 0.1 + 0.1).alias("e")))
    rows = recurrences.cut_at_letters(rows.withColumns({"char_spans": spans, "start_s": F.lit(0.15), "end_s": F.lit(99.0)}))
    return rows.select("p_partkey", F.posexplode("cuts").alias("part_index", "c")).select("p_partkey", "part_index", F.round("c.s", 6).alias("s"), F.round("c.e", 6).alias("e"))


def _assembled(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    rows = kept(T.notes(spark, sf_dir), "notes")
    words = T.spoken(rows).select("chart_id", "pos", F.element_at(F.array(*map(F.lit, ("corazón", "noche", "luna", "me", "quiero"))), (F.col("event_id") % 5 + 1).cast("int")).alias("text"), "start_s", "end_s")
    frames = rows.select("chart_id", F.col("start_s").alias("t"), "f0", "conf")
    songs = rows.groupBy("chart_id").agg(F.max("end_s").alias("duration")).withColumns({"title": F.concat(F.lit("Song "), "chart_id"), "artist": F.when(F.col("chart_id") % 2 == 0, "Ana y Beto").otherwise("Ana"), "audio": F.lit("a.mp3")})
    return assembly.assembled(words, frames, songs, T.segments(rows), **options)


@Q.add()
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of charts assembled from events."""
    return _assembled(spark, sf_dir)[1]


@Q.add()
def assemble_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)[0].select("chart_id", "title", "artist", "audio", "bpm", "gap_ms", "preview_start", "duet", "p1", "p2")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("chart_id", F.col("pos").cast("int").alias("pos"), "start_s", "end_s", F.rint(F.coalesce("midi", F.lit(60.0))).cast("int").alias("pitch"), F.concat("event_type", F.lit(" ")).alias("text"), F.col("event_type").isin("signup", "purchase").cast("int").alias("track"))


@Q.add()
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of generated against reference notes."""
    gen, ref = T.sides(T.notes(spark, sf_dir))
    return evaluation.scores(_flat(gen), _flat(ref))


@Q.add(
    "WITH RECURSIVE " + MATCHED + """,
p AS (SELECT pairs.chart_id, error, round_even(coalesce(g.midi, 60), 0) AS g, round_even(coalesce(r.midi, 60), 0) AS r FROM pairs JOIN gen g ON g.chart_id = pairs.chart_id AND g.pos = gen_pos JOIN ref r ON r.chart_id = pairs.chart_id AND r.pos = ref_pos),
q AS (SELECT *, g - median(g) OVER (PARTITION BY chart_id) AS gm, r - median(r) OVER (PARTITION BY chart_id) AS rm FROM p),
m AS (SELECT chart_id, count(*) AS matched, round(median(abs(error)) * 1000, 1) AS med, round(avg(abs(error)) * 1000, 1) AS mean, round(coalesce(covar_pop(gm, rm) / nullif(stddev_pop(gm) * stddev_pop(rm), 0), 0), 3) AS corr, round(avg((abs(gm - rm) <= 2)::INT), 3) AS within FROM q GROUP BY chart_id),
a AS (SELECT chart_id, count(*) AS n, round(arg_max(end_s, pos) - arg_min(start_s, pos), 1) AS span FROM gen GROUP BY chart_id),
b AS (SELECT chart_id, count(*) AS n, round(arg_max(end_s, pos) - arg_min(start_s, pos), 1) AS span FROM ref GROUP BY chart_id)
SELECT coalesce(a.chart_id, b.chart_id) AS chart_id, coalesce(a.n, 0) AS gen_notes, coalesce(b.n, 0) AS ref_notes, CASE WHEN coalesce(b.n, 0) = 0 THEN 0 ELSE round(coalesce(a.n, 0) / b.n, 3) END AS note_count_ratio, coalesce(matched, 0) AS matched,
       CASE WHEN coalesce(b.n, 0) = 0 THEN 0 ELSE round(coalesce(matched, 0) / b.n, 3) END AS match_rate_vs_ref, med AS onset_err_ms_median, mean AS onset_err_ms_mean, coalesce(corr, 0) + 0 AS pitch_contour_corr, coalesce(within, 0) AS pitch_within_2st_rate, coalesce(a.span, 0) AS gen_span_s, coalesce(b.span, 0) AS ref_span_s
FROM a FULL JOIN b ON a.chart_id = b.chart_id LEFT JOIN m ON m.chart_id = coalesce(a.chart_id, b.chart_id)"""
)
def evaluate_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluate without the similarity of lyrics."""
    return evaluate(spark, sf_dir).drop("lyric_similarity")


@Q.add(
    "WITH RECURSIVE " + PAIRINGS + """,
d AS (SELECT chart_id, count(*) FILTER (event_type IN ('view', 'click')) > 0 AS lead FROM notes GROUP BY chart_id HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') > 0),
o AS (SELECT d.chart_id, x.pairing, coalesce(p.matched, 0) AS p1_matched, coalesce(q.matched, 0) AS p2_matched FROM d, (VALUES ('direct'), ('swap')) AS x(pairing)
      LEFT JOIN hits p ON p.chart_id = d.chart_id AND p.pairing = x.pairing AND p.r = 'click' LEFT JOIN hits q ON q.chart_id = d.chart_id AND q.pairing = x.pairing AND q.r = 'purchase' WHERE x.pairing = 'swap' OR lead)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY p1_matched + p2_matched DESC, pairing) = 1"""
)
def duet_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluate_duet without what rests on lyrics."""
    return evaluate_duet(spark, sf_dir).select("chart_id", "pairing", "p1_matched", "p2_matched")


@Q.add()
def evaluate_duet(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen, ref = T.sides(T.notes(spark, sf_dir))
    out = evaluation.duet_scores(_flat(gen), _flat(ref))
    return out.select("chart_id", "pairing", "attributed", "accuracy", F.col("p1.matched").alias("p1_matched"), F.col("p2.matched").alias("p2_matched"), F.col("p1.lyric_similarity").alias("p1_lyric"), F.col("p2.lyric_similarity").alias("p2_lyric"))


@Q.add("WITH " + CHART + "SELECT chart_id, row_number() OVER (PARTITION BY chart_id ORDER BY start_beat, track, line_no, note_index)::INT - 1 AS pos, track, round(1.2 + start_beat * 15 / CASE WHEN chart_id % 5 = 0 THEN 0.5 ELSE 240.04 END, 6) AS start_s, kind IN ('normal', 'golden') AS gold FROM chart_notes")
def flatten_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all tracks in time, and whether they carry a pitch."""
    rows = evaluation.flattened(*charts_of(spark, sf_dir))
    return rows.select("chart_id", "pos", "track", F.round("start_s", 6).alias("start_s"), F.col("kind").isin("normal", "golden").alias("gold"))


#: Measures of a replay record and what stands for them: n for n_chars, q and t for labels.
FLAT = {
    "w_recall": "q", "w_onset_med_ms": "n", "w_onset_mae_ms": "n + 1", "w_onset_p90_ms": "n + 2", "w_bias_ms": "n + 3", "fa_score": "t", "fa_aligned_frac": "n + 4", "fa_recall": "n + 5",
    "fa_onset_med_ms": "n + 6", "fa_onset_mae_ms": "n + 7", "fa_onset_p90_ms": "n + 8", "fa_bias_ms": "n + 9", "syll_prop_med_ms": "n + 10", "syll_fa_med_ms": "n + 11", "pitch_coverage": "n + 12", "pitch_within_2st": "n + 13",
    "pitch_corr": "n + 14", "bpm_est": "n + 15", "bpm_mult": "n + 16", "bpm_dev": "n + 17",
}


@Q.add(
    "WITH d AS (SELECT d.doc_id AS stem, d.n_chars AS n, l.quality::DOUBLE AS q, l.toxic::DOUBLE AS t, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT stem, n AS n_gold_words, CASE WHEN known THEN q = 1 END AS fa_ok, CASE WHEN known THEN n * 2 END AS syll_n_words, "
    + ", ".join(f"CASE WHEN known THEN ({x})::DOUBLE END AS {c}" for c, x in FLAT.items()) + " FROM d"
)
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested replay records; those of documents without labels lack all measures."""
    rows = T.read(spark, sf_dir, "documents").join(T.read(spark, sf_dir, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("stem"), F.col("n_chars").alias("n"), F.col("quality").alias("q"), F.col("toxic").alias("t"), "known")
    of = lambda column, name: F.expr(f"cast({FLAT[column]} as double)").alias(name)
    onset = lambda p: F.struct(of(f"{p}_onset_med_ms", "median_ms"), of(f"{p}_onset_mae_ms", "mae_ms"), of(f"{p}_onset_p90_ms", "p90_ms"), of(f"{p}_bias_ms", "bias_ms")).alias("onset")
    parts = {
        "whisper": F.struct(of("w_recall", "recall"), onset("w")),
        "fa": F.struct((F.col("q") == 1).alias("ok"), of("fa_score", "score"), of("fa_aligned_frac", "aligned_frac"), of("fa_recall", "recall"), onset("fa")),
        "syll": F.struct((F.col("n") * 2).alias("n_words"), of("syll_prop_med_ms", "prop_median_ms"), of("syll_fa_med_ms", "fa_median_ms")),
        "pitch": F.struct(of("pitch_coverage", "coverage"), of("pitch_within_2st", "within_2st"), of("pitch_corr", "contour_corr")),
        "bpm": F.struct(of("bpm_est", "est"), of("bpm_mult", "mult"), of("bpm_dev", "dev")),
    }
    return library.flat_metrics(rows.select("stem", F.col("n").alias("n_gold_words"), *(F.when(F.col("known"), x).alias(c) for c, x in parts.items())))


@Q.add(
    "WITH " + T.SEGMENTS + """,
f AS (SELECT s.chart_id, s.seg, count(n.pos) AS k, 69 + 12 * log2(median(n.f0) / 440) AS r FROM segments s LEFT JOIN notes n ON n.chart_id = s.chart_id AND n.start_s >= s.s AND n.start_s < s.e + 2 AND n.voiced GROUP BY ALL),
q AS (SELECT chart_id, (60 + seg % 12)::DOUBLE AS g, r FROM f WHERE k >= 2),
m AS (SELECT chart_id, g - median(g) OVER (PARTITION BY chart_id) AS g, r - median(r) OVER (PARTITION BY chart_id) AS r FROM q),
a AS (SELECT chart_id, round(avg((abs(g - r) <= 2)::INT), 3) AS w, round(coalesce(covar_pop(g, r) / nullif(stddev_pop(g) * stddev_pop(r), 0), 0), 3) AS c FROM m GROUP BY chart_id),
n AS (SELECT chart_id, count(*) AS n_notes, count(*) FILTER (k >= 2) AS n_scored FROM f GROUP BY chart_id)
SELECT chart_id, n_notes, n_scored, round(n_scored / n_notes, 3) AS coverage, CASE WHEN n_scored >= 10 THEN w END AS within_2st, CASE WHEN n_scored >= 10 THEN c END AS contour_corr FROM n LEFT JOIN a USING (chart_id)"""
)
def pitch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, two seconds longer, as notes of a rising scale."""
    rows = T.notes(spark, sf_dir)
    spans = T.segments(rows).select("chart_id", F.col("seg").alias("pos"), F.col("s").alias("start_s"), (F.col("e") + 2).alias("end_s"), (60 + F.col("seg") % 12).alias("pitch"))
    return evaluation.pitch_scores(spans, rows.select("chart_id", F.col("start_s").alias("t"), "f0", "conf"))


@Q.add(
    "WITH " + WORDS + """,
x AS (SELECT chart_id, line_no, word_no, min(start_beat) AS a, max(start_beat + duration) AS b FROM v WHERE track = 0 GROUP BY ALL),
y AS (SELECT chart_id, count(*) AS n_words, (arg_max(b, line_no * 1000000 + word_no) - arg_min(a, line_no * 1000000 + word_no)) * 0.0625::DOUBLE AS span FROM x GROUP BY chart_id)
SELECT chart_id, CASE WHEN chart_id % 3 = 0 THEN 'es' WHEN chart_id % 3 = 1 THEN 'en' ELSE 'other' END AS lang_group, n_words, round(span, 6) AS span_s, round(n_words / (span / 60), 6) AS wpm FROM y WHERE n_words >= 20 AND span >= 40 AND chart_id % 9 <> 0 AND chart_id % 13 <> 0"""
)
def replay_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts with 20 words and 40 seconds or more, as events have few; every ninth is marked
    relative, every thirteenth has no tempo."""
    charts, notes = charts_of(spark, sf_dir)
    language = F.when(F.col("chart_id") % 3 == 0, "Spanish").when(F.col("chart_id") % 3 == 1, "English").otherwise("German")
    charts = charts.withColumns({"language": language, "bpm": F.when(F.col("chart_id") % 13 == 0, 0.0).otherwise(240.0)})
    files = chart_text.rendered(charts, notes)
    files = files.withColumn("text", F.concat(F.when(F.col("chart_id") % 9 == 0, F.lit("#relative : Yes\n")).otherwise(""), "text"))
    beats = notes.where("track = 0").select("chart_id", "line_no", "note_index", "text", (F.col("start_beat") * 0.0625).alias("start_s"), ((F.col("start_beat") + F.col("duration")) * 0.0625).alias("end_s"))
    out = manifest.manifest(files, S.word_table(S.song_words(beats)), fewest=20, least=40.0)
    return out.withColumns({"span_s": F.round("span_s", 6), "wpm": F.round("wpm", 6)})


@Q.add("WITH " + CHART + "SELECT chart_id::BIGINT AS chart_id, track, line_no::INT AS line_no, note_index::INT AS note_index, break_beat, start_beat, duration, pitch, text, kind FROM chart_notes WHERE duration >= 0")
def chart_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts written to files of their own, found in their folders and read again."""
    path = new_place(spark, "chart-files")
    chart_text.write_charts(chart_text.rendered(*charts_of(spark, sf_dir)), path)
    files = chart_text.read_files(spark, path).select(F.regexp_extract("path", r"chart_id=(\d+)", 1).cast("long").alias("chart_id"), "text")
    return chart_text.notes(files, keep_tracks=True).where("duration >= 0")


@Q.add("SELECT doc_id, quality, toxic, CASE WHEN quality IS NOT NULL THEN quality + toxic END AS both, l.doc_id IS NULL AS pending FROM documents d LEFT JOIN labels l USING (doc_id)")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and as CSV, read again from both, and joined with the sample."""
    labels, path = T.read(spark, sf_dir, "labels"), new_place(spark, "metric-files")
    library.write_json(labels.select("doc_id", "quality", F.struct("toxic").alias("more")), f"{path}/json")
    library.write_csv(labels, f"{path}/csv", "doc_id", "quality", "toxic")
    back = library.read_json(spark, f"{path}/json", "doc_id long, quality int, more struct<toxic:int>, absent double")
    lines = spark.read.option("header", "true").schema("doc_id long, quality int, toxic int").csv(f"{path}/csv").select("doc_id", (F.col("quality") + F.col("toxic")).alias("both"))
    rows = back.select("doc_id", "quality", "more.toxic").join(lines, "doc_id").withColumn("done", F.lit(True))
    return T.read(spark, sf_dir, "documents").select("doc_id").join(rows, "doc_id", "left").select("doc_id", "quality", "toxic", "both", F.col("done").isNull().alias("pending"))


@Q.add("WITH " + T.NOTES + "SELECT chart_id, 'no words left' AS error FROM notes GROUP BY chart_id HAVING count(*) FILTER (chart_id % 3 = 0 OR event_type NOT IN ('view', 'click', 'error')) = 0 OR chart_id % 10 = 0")
def assemble_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two of three charts views and clicks are asides and errors blank; every tenth is blank."""
    rows = T.notes(spark, sf_dir)
    third, type_ = F.col("chart_id") % 3 == 0, F.col("event_type")
    blank = (F.col("chart_id") % 10 == 0) | ~third & (type_ == "error")
    words = rows.select("chart_id", "pos", F.when(blank, " \t").otherwise("la").alias("text"), (~third & type_.isin("view", "click")).alias("adlib"))
    return assembly.left_empty(words, drop_adlibs=True)


@Q.add("SELECT doc_id AS chart_id, CASE WHEN contains(upper(string_split(upper(text), 'E' || chr(10))[1]), '#RELATIVE') THEN 'relative beats' ELSE 'no lines or tempo' END AS reason FROM documents ORDER BY doc_id LIMIT 20")
def skipped_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents: none is a chart. That limit is the feature of the list."""
    docs = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chart_id"), "text")
    return profiling.first_skipped(docs)


@Q.add("WITH " + T.NOTES + """, v AS (SELECT *, value + CASE WHEN chart_id % 7 = 0 THEN 1 ELSE 0 END AS v FROM notes JOIN (SELECT event_id, value FROM events) USING (event_id))
SELECT chart_id, event_type, count(*) AS n, round(sum(v), 4) AS total, CASE WHEN chart_id % 7 = 0 THEN 'second' ELSE 'first' END AS run FROM v WHERE chart_id % 11 <> 0 GROUP BY ALL""")
def stage_by_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every chart by a stage that is run twice: between the runs the values of every
    seventh chart change, and only those are computed again. Every eleventh has no result."""
    path = new_place(spark, "stage")
    events = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("chart_id"), "event_id", "event_type", "value")

    def songs(shift: float) -> DataFrame:
        moved = F.col("value") + F.when(F.col("chart_id") % 7 == 0, shift).otherwise(0.0)
        entry = F.struct("event_id", "event_type", moved.alias("v"))
        return events.groupBy("chart_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))

    def totals(run: str):
        def stage(rows: DataFrame) -> DataFrame:
            own = rows.where("chart_id % 11 <> 0").select("chart_id", F.explode("x").alias("x"))
            return own.groupBy("chart_id", F.col("x.event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.v"), 4).alias("total")).withColumn("run", F.lit(run))

        return stage

    storage.by_song(songs(0.0), "chart_id", totals("first"), path)
    return storage.by_song(songs(1.0), "chart_id", totals("second"), path)


@Q.add(
    "WITH " + CHART + """, n AS (SELECT chart_id, count(*) AS n FROM chart_notes WHERE duration >= 0 GROUP BY chart_id)
SELECT DISTINCT c.user_id AS chart_id, 'Canción “' || c.user_id || '”' AS title, coalesce(n, 0) AS notes, md5(repeat('c' || c.user_id, 50)) AS cover FROM events c LEFT JOIN n ON n.chart_id = c.user_id"""
)
def packed_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts with a cover each, packed in an archive a song and read back; every third text
    is in the code page that old files are in."""
    charts, notes = charts_of(spark, sf_dir)
    charts = charts.withColumn("title", F.concat(F.lit("Canción “"), F.col("chart_id").cast("string"), F.lit("”")))
    # the quotes of that code page are control characters of ISO 8859-1
    old = F.encode(F.translate("text", "“”", "\u0093\u0094"), "ISO-8859-1")
    song = F.col("chart_id").cast("string").alias("song")
    texts = chart_text.rendered(charts, notes).select(song, F.lit("song.txt").alias("name"), F.when(F.col("chart_id") % 3 == 0, old).otherwise(F.encode("text", "UTF-8")).alias("content"))
    covers = charts.select(song, F.lit("cover.jpg").alias("name"), F.encode(F.repeat(F.concat(F.lit("c"), song), F.lit(50)), "UTF-8").alias("content"))
    path = new_place(spark, "packed")
    packed.register(spark)
    packed.by_song(texts.unionByName(covers)).write.format("songs").mode("append").save(path)
    back = spark.read.format("songs").load(path).withColumn("chart_id", F.col("song").cast("long"))
    files = back.where("name = 'song.txt'").select("chart_id", decoded("content").alias("text"))
    counts = chart_text.notes(files, keep_tracks=True).where("duration >= 0").groupBy("chart_id").agg(F.count(F.lit(1)).alias("notes"))
    rows = chart_text.headers(files).select("chart_id", "title").join(counts, "chart_id", "left").join(back.where("name = 'cover.jpg'").select("chart_id", F.md5("content").alias("cover")), "chart_id")
    return rows.withColumn("notes", F.coalesce("notes", F.lit(0)))


#: CTEs words (that stay, snapped), syl (syllables with their spans) and laid (settled pitch and
#: place of every note). Words of under half a second hold no several pitches.
ASSEMBLED = T.SEGMENTS.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
said AS (SELECT chart_id, row_number() OVER (PARTITION BY chart_id ORDER BY pos) - 1 AS pos, ['corazón', 'noche', 'luna', 'me', 'quiero'][event_id % 5 + 1] AS text, start_s AS s, greatest(end_s, start_s + 0.08) AS e FROM spoken),
inside AS (SELECT w.chart_id, w.pos, count(*) AS n, min(v.start_s) AS lo, max(v.start_s) AS hi FROM said w JOIN notes v ON v.chart_id = w.chart_id AND v.voiced AND v.start_s >= w.s AND v.start_s < w.e GROUP BY ALL HAVING count(*) >= 3),
words AS MATERIALIZED (SELECT w.chart_id, w.pos, text, coalesce(lo, s) AS s, coalesce(greatest(hi, lo + 0.08), e) AS e FROM said w LEFT JOIN inside i ON i.chart_id = w.chart_id AND i.pos = w.pos),
t AS (SELECT *, coalesce(s - lag(e) OVER o > 0.6, FALSE) AS head, greatest(0, first_value(s) OVER o * 1000 - 200) / 1000 AS t0,
             CASE text WHEN 'corazón' THEN ['co', 'ra', 'zón'] WHEN 'noche' THEN ['no', 'che'] WHEN 'luna' THEN ['lu', 'na'] WHEN 'me' THEN ['me'] ELSE ['quie', 'ro'] END AS parts FROM words WINDOW o AS (PARTITION BY chart_id ORDER BY pos)),
cut AS (SELECT chart_id, pos, s, e, head, t0, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, length(array_to_string(parts, '')) AS total, parts FROM t),
syl AS MATERIALIZED (SELECT *, s + (e - s) * (length(array_to_string(parts[:k - 1], '')) / total) AS a, s + (e - s) * (length(array_to_string(parts[:k], '')) / total) AS b, (row_number() OVER (PARTITION BY chart_id ORDER BY pos, k) - 1)::INT AS sid FROM cut),
heard AS (SELECT y.chart_id, y.sid, count(*) AS n, 69 + 12 * log2(median(v.f0) / 440) AS midi FROM syl y JOIN notes v ON v.chart_id = y.chart_id AND v.voiced AND v.start_s >= y.a AND v.start_s < y.b GROUP BY ALL),
sung AS (SELECT y.chart_id, y.sid, coalesce(n, 0) AS n, head AND k = 1 AS new, CASE WHEN k = 1 AND pos > 0 AND NOT head THEN ' ' ELSE '' END || part AS text, greatest(0, round_even((a - t0) / 0.0625, 0)::INT) AS beat, greatest(0, round_even((b - t0) / 0.0625, 0)::INT) AS endbeat,
                coalesce(last_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(midi IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 60) AS midi
         FROM syl y LEFT JOIN heard h ON h.chart_id = y.chart_id AND h.sid = y.sid WINDOW o AS (PARTITION BY y.chart_id ORDER BY y.sid)),
seen AS MATERIALIZED (SELECT *, round_even(median(midi) OVER (PARTITION BY chart_id), 0)::INT - 12 AS down, lead(midi) OVER o AS after, lead(new) OVER o AS after_new, lead(beat) OVER o AS onset, greatest(2, endbeat - beat) AS wanted FROM sung WINDOW o AS (PARTITION BY chart_id ORDER BY sid)),
laid AS (SELECT chart_id, sid, midi, beat AS start_beat, greatest(1, coalesce(least(wanted, onset - beat), wanted)) AS duration FROM seen WHERE sid = 0
         UNION ALL
         SELECT g.chart_id, g.sid, CASE WHEN after IS NOT NULL AND NOT new AND NOT after_new AND n < 5 AND abs(g.midi - l.midi) >= 5 AND abs(g.midi - after) >= 5 THEN (l.midi + after) / 2 ELSE g.midi END,
                greatest(beat, l.start_beat + l.duration + 1), greatest(1, coalesce(least(wanted, onset - greatest(beat, l.start_beat + l.duration + 1)), wanted))
         FROM seen g JOIN laid l ON l.chart_id = g.chart_id AND g.sid = l.sid + 1)
"""


@Q.add("WITH RECURSIVE " + ASSEMBLED + "SELECT chart_id, l.start_beat, l.duration, round_even(l.midi, 0)::INT - down AS pitch, ltrim(text) AS text FROM laid l JOIN seen USING (chart_id, sid)")
def assemble_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length, pitch and text of assembled notes, whatever their line and track."""
    return _assembled(spark, sf_dir)[1].select("chart_id", "start_beat", "duration", "pitch", F.ltrim("text").alias("text")).distinct()


@Q.add(
    "WITH RECURSIVE " + ASSEMBLED + """, h AS (SELECT chart_id, min(t0) AS t0 FROM t GROUP BY chart_id), d AS (SELECT chart_id, max(end_s) AS d FROM notes GROUP BY chart_id)
SELECT chart_id, 'Song ' || chart_id AS title, CASE WHEN chart_id % 2 = 0 THEN 'Ana y Beto' ELSE 'Ana' END AS artist, 'a.mp3' AS audio, 240.0::DOUBLE AS bpm, round(t0 * 1000, 0) AS gap_ms, CASE WHEN d > 0 THEN round_even(least(d * 0.25, greatest(0, t0 + 30 * 0.0625)), 2) END AS preview_start
FROM h JOIN d USING (chart_id)"""
)
def assemble_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of assembled songs, but for those of duets."""
    return _assembled(spark, sf_dir)[0].select("chart_id", "title", "artist", "audio", "bpm", "gap_ms", "preview_start")
