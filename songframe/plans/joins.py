"""Queries that join points, intervals and tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.functions import timing
from songframe.operators import intervals as I
from songframe.operators import evaluation, lyrics, metrics, recurrences
from songframe.plans import tables as T
from songframe.plans.book import Book

Q = Book()


@Q.add("WITH " + T.SIDES + "SELECT r.chart_id, r.pos, round(min(abs(g.start_s - r.start_s)), 6) AS distance FROM ref r LEFT JOIN gen g ON g.chart_id = r.chart_id AND abs(g.start_s - r.start_s) <= 0.3 GROUP BY ALL")
def nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen, ref = T.sides(T.notes(spark, sf_dir))
    return I.nearest(ref, gen).select("chart_id", "pos", F.round("distance", 6).alias("distance"))


OVERLAPS = T.SEGMENTS + """,
o AS (SELECT w.chart_id, w.pos, w.start_s, w.end_s, s.seg, s.speaker, least(s.e, w.end_s) - greatest(s.s, w.start_s) AS overlap FROM spoken w JOIN segments s ON s.chart_id = w.chart_id AND s.s < w.end_s AND s.e > w.start_s),
best AS (SELECT chart_id, pos, speaker FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY chart_id, pos ORDER BY overlap DESC, seg) = 1)
"""


@Q.add("WITH " + OVERLAPS + "SELECT w.chart_id, w.pos, b.speaker FROM spoken w LEFT JOIN best b USING (chart_id, pos)")
def dominant_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir)
    return I.dominant_speaker(T.spoken(rows), T.segments(rows)).select("chart_id", "pos", "speaker")


@Q.add(
    "WITH " + OVERLAPS + """,
gaps AS (SELECT w.chart_id, w.pos, s.seg, s.speaker, CASE WHEN s.e < w.start_s THEN w.start_s - s.e WHEN s.s > w.end_s THEN s.s - w.end_s ELSE 0 END AS gap FROM spoken w JOIN segments s USING (chart_id)),
near AS (SELECT chart_id, pos, speaker FROM gaps QUALIFY row_number() OVER (PARTITION BY chart_id, pos ORDER BY gap, seg) = 1)
SELECT w.chart_id, w.pos, coalesce(b.speaker, n.speaker) AS speaker FROM spoken w LEFT JOIN best b USING (chart_id, pos) LEFT JOIN near n USING (chart_id, pos)"""
)
def word_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir)
    return I.word_speaker(T.spoken(rows), T.segments(rows)).select("chart_id", "pos", "speaker")


@Q.add("WITH " + OVERLAPS + "SELECT chart_id, pos, speaker, round(sum(overlap) / (end_s - start_s), 6) AS fraction FROM o WHERE overlap > 0 GROUP BY chart_id, pos, speaker, start_s, end_s")
def active_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir)
    return I.active_fraction(T.spoken(rows), T.segments(rows)).withColumn("fraction", F.round("fraction", 6))


@Q.add(
    "WITH " + T.SEGMENTS + """,
f AS (SELECT s.chart_id, s.seg AS pos, count(*) AS n_frames, 69 + 12 * log2(median(n.f0) / 440) AS midi FROM segments s JOIN notes n ON n.chart_id = s.chart_id AND n.start_s >= s.s AND n.start_s < s.e AND n.voiced GROUP BY ALL)
SELECT s.chart_id, s.seg AS pos, coalesce(n_frames, 0) AS n_frames, round(midi, 6) AS midi FROM segments s LEFT JOIN f ON f.chart_id = s.chart_id AND f.pos = s.seg"""
)
def median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced events within speaker segments."""
    rows = T.notes(spark, sf_dir)
    spans = T.segments(rows).select("chart_id", F.col("seg").alias("pos"), F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    out = I.median_pitch(spans, rows.select("chart_id", F.col("start_s").alias("t"), "f0", "conf"))
    return out.select("chart_id", "pos", "n_frames", F.round("midi", 6).alias("midi"))


@Q.add(
    "WITH " + T.SEGMENTS + """,
f AS (SELECT s.chart_id, s.seg AS pos, min(n.start_s) AS lo, max(n.start_s) AS hi FROM segments s JOIN notes n ON n.chart_id = s.chart_id AND n.start_s >= s.s AND n.start_s < s.e + 2 AND n.voiced GROUP BY ALL HAVING count(*) >= 3)
SELECT s.chart_id, s.seg AS pos, round(coalesce(lo, s.s), 6) AS start_s, round(coalesce(greatest(hi, lo + 0.08), s.e + 2), 6) AS end_s FROM segments s LEFT JOIN f ON f.chart_id = s.chart_id AND f.pos = s.seg"""
)
def voiced_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, two seconds longer, cut to their voiced events."""
    rows = T.notes(spark, sf_dir)
    spans = T.segments(rows).select("chart_id", F.col("seg").alias("pos"), F.col("s").alias("start_s"), (F.col("e") + 2).alias("end_s"))
    out = I.snapped(spans, rows.select("chart_id", F.col("start_s").alias("t"), "f0", "conf"))
    return out.select("chart_id", "pos", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


TRACKS = T.SIDES + """,
d AS (SELECT r.chart_id, r.pos, r.event_type = 'purchase' AS second, min(abs(g.start_s - r.start_s)) FILTER (g.event_type = 'view' AND abs(g.start_s - r.start_s) <= 0.3) AS v, min(abs(g.start_s - r.start_s)) FILTER (g.event_type = 'signup' AND abs(g.start_s - r.start_s) <= 0.3) AS s
      FROM ref r LEFT JOIN gen g ON g.chart_id = r.chart_id GROUP BY ALL),
a AS (SELECT chart_id, CASE WHEN second THEN s ELSE v END AS own, CASE WHEN second THEN v ELSE s END AS other FROM d WHERE v IS NOT NULL OR s IS NOT NULL)
"""


@Q.add("WITH " + TRACKS + "SELECT chart_id, count(*) AS attributed, round(count(*) FILTER (own IS NOT NULL AND (other IS NULL OR own <= other)) / count(*), 3) AS accuracy FROM a GROUP BY chart_id")
def singer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are the first reference track and belong to views, purchases to signups."""
    gen, ref = T.sides(T.notes(spark, sf_dir))
    of = lambda rows, kind: rows.where(F.col("event_type") == kind)
    clicks, buys, views, signups = of(ref, "click"), of(ref, "purchase"), of(gen, "view"), of(gen, "signup")
    same = I.nearest(clicks, views).unionByName(I.nearest(buys, signups))
    other = I.nearest(clicks, signups).unionByName(I.nearest(buys, views))
    return I.singer_accuracy(same, other)


#: Greedy matching of each pairing's tracks, by a recursive walk over reference notes.
PAIRINGS = T.NOTES.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
c AS (SELECT * FROM (VALUES ('direct', 'view', 'click'), ('direct', 'signup', 'purchase'), ('swap', 'signup', 'click'), ('swap', 'view', 'purchase')) AS x(pairing, g, r)),
ro AS MATERIALIZED (SELECT c.pairing, c.g, c.r, chart_id, pos, start_s, row_number() OVER (PARTITION BY c.pairing, c.r, chart_id ORDER BY start_s, pos) AS k FROM notes JOIN c ON event_type = c.r),
near AS MATERIALIZED (SELECT ro.pairing, ro.r, ro.chart_id, ro.k, list({'d': abs(g.start_s - ro.start_s), 's': g.start_s, 'p': g.pos} ORDER BY abs(g.start_s - ro.start_s), g.start_s, g.pos) FILTER (g.pos IS NOT NULL) AS c
         FROM ro LEFT JOIN notes g ON g.chart_id = ro.chart_id AND g.event_type = ro.g AND abs(g.start_s - ro.start_s) < 0.3 GROUP BY ALL),
walk AS (SELECT pairing, r, chart_id, k, CASE WHEN c[1] IS NULL THEN []::BIGINT[] ELSE [c[1].p] END AS used FROM near WHERE k = 1
         UNION ALL
         SELECT pairing, r, chart_id, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.p) END
         FROM (SELECT n.pairing, n.r, n.chart_id, n.k, w.used, list_filter(coalesce(n.c, []), lambda x: NOT list_contains(w.used, x.p))[1] AS hit FROM near n JOIN walk w ON n.pairing = w.pairing AND n.r = w.r AND n.chart_id = w.chart_id AND n.k = w.k + 1)),
hits AS (SELECT pairing, r, chart_id, max(len(used)) AS matched FROM walk GROUP BY ALL)
"""


@Q.add("WITH RECURSIVE " + PAIRINGS + "SELECT chart_id, pairing, sum(matched)::BIGINT AS matched FROM hits GROUP BY chart_id, pairing HAVING sum(matched) > 0 QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY sum(matched) DESC, pairing) = 1")
def duet_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which generated track goes with which reference track: more matches, direct on ties."""
    gen, ref = T.sides(T.notes(spark, sf_dir))
    of = lambda rows, kind: rows.where(F.col("event_type") == kind)
    found = None
    for name, pairs in {"direct": (("view", "click"), ("signup", "purchase")), "swap": (("signup", "click"), ("view", "purchase"))}.items():
        for g, r in pairs:
            hits = recurrences.greedy_match(of(gen, g), of(ref, r)).select("chart_id", F.lit(name).alias("pairing"))
            found = hits if found is None else found.unionByName(hits)
    counts = found.groupBy("chart_id", "pairing").agg(F.count(F.lit(1)).alias("matched"))
    best = F.row_number().over(Window.partitionBy("chart_id").orderBy(F.desc("matched"), "pairing"))
    return counts.withColumn("best", best).where("best = 1").drop("best")


@Q.add("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IS NOT NULL) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without accepted (result) and without returned (error) lines."""
    lines = T.read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = T.read(spark, sf_dir, "orders").select("o_orderkey")
    return metrics.pending(orders, lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), "o_orderkey")


@Q.add("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NOT NULL THEN NULL WHEN d.doc_id % 7 = 0 THEN 'failed' ELSE 'not run' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are results; of the rest every seventh document failed."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id")
    failed = docs.where("doc_id % 7 = 0").withColumn("error", F.lit("failed"))
    return metrics.with_results(docs, T.read(spark, sf_dir, "labels").select("doc_id", "quality"), failed, "doc_id").select("doc_id", "quality", "error")


@Q.add("WITH " + T.NOTES + ", t AS (SELECT chart_id, pos, event_type = 'signup' AS shared, (event_type = 'purchase')::INT AS lab FROM notes) SELECT chart_id, pos, unnest(CASE WHEN shared THEN [0, 1] ELSE [lab] END) AS track FROM t")
def unison_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are sung by both, purchases by the second."""
    label = (F.col("event_type") == "purchase").cast("int")
    track = F.when(F.col("event_type") == "signup", F.array(F.lit(0), F.lit(1))).otherwise(F.array(label))
    return T.notes(spark, sf_dir).select("chart_id", "pos", F.explode(track).alias("track"))


@Q.add("WITH " + T.NOTES + """,
v AS (SELECT chart_id, start_s, end_s FROM notes WHERE voiced), s AS (SELECT chart_id, pos, start_s, end_s FROM notes WHERE event_id % 5 <> 0),
h AS (SELECT s.chart_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM v WHERE v.chart_id = s.chart_id AND v.start_s >= s.start_s - 0.05 AND v.start_s < s.end_s + 0.05)) AS hit FROM s GROUP BY ALL)
SELECT chart_id, n, hit, hit >= 0.85 * n AS passes FROM h""")
def alignment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do words with a score (event_id not divisible by 5) meet voiced frames?"""
    rows = T.notes(spark, sf_dir)
    words = rows.where("event_id % 5 <> 0").select("chart_id", "pos", (F.col("start_s") - 0.05).alias("start_s"), (F.col("end_s") + 0.05).alias("end_s"))
    hits = I.frames_in(words, rows.select("chart_id", F.col("start_s").alias("t"), "f0", "conf")).select("chart_id", "pos").distinct().withColumn("hit", F.lit(1))
    out = words.join(hits, ["chart_id", "pos"], "left").groupBy("chart_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit"))
    return out.withColumn("passes", F.col("hit") >= 0.85 * F.col("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir).where("voiced")
    speaker = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return rows.select("chart_id", "pos", "start_s", "end_s", F.rint("midi").cast("int").alias("midi"), F.col("conf").alias("amplitude"), speaker.alias("speaker"))


@Q.add(
    "WITH RECURSIVE " + T.NOTES.replace("e AS (", "e AS MATERIALIZED (", 1) + """,
v AS MATERIALIZED (SELECT chart_id, pos, round_even(midi, 0)::INT AS midi, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS speaker, row_number() OVER (PARTITION BY chart_id ORDER BY start_s, round_even(midi, 0), pos) AS k FROM notes WHERE voiced),
r AS (SELECT chart_id, pos, k, speaker, CASE WHEN speaker = 'purchase' THEN [midi] ELSE []::INT[] END AS p, CASE WHEN speaker = 'signup' THEN [midi] ELSE []::INT[] END AS s, speaker AS first FROM v WHERE k = 1
      UNION ALL
      SELECT chart_id, pos, k, a, CASE WHEN a = 'purchase' THEN list_append(p, midi) ELSE p END, CASE WHEN a = 'signup' THEN list_append(s, midi) ELSE s END, coalesce(first, a)
      FROM (SELECT v.chart_id, v.pos, v.k, v.midi, r.p, r.s, r.first,
                   coalesce(v.speaker, CASE WHEN len(p) + len(s) = 0 THEN NULL WHEN len(s) = 0 THEN 'purchase' WHEN len(p) = 0 THEN 'signup'
                            WHEN abs(list_aggregate(p, 'median') - v.midi) < abs(list_aggregate(s, 'median') - v.midi) THEN 'purchase' WHEN abs(list_aggregate(p, 'median') - v.midi) > abs(list_aggregate(s, 'median') - v.midi) THEN 'signup' ELSE first END) AS a
            FROM v JOIN r ON v.chart_id = r.chart_id AND v.k = r.k + 1))
SELECT chart_id, pos::INT AS pos, speaker FROM r"""
)
def register_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced events without speaker go to the closest voice so far."""
    return recurrences.by_register(_events(spark, sf_dir))


@Q.add(
    "WITH " + T.NOTES + """,
v AS (SELECT chart_id, pos, start_s, end_s, round_even(midi, 0)::INT AS midi, conf AS amplitude, event_type AS speaker FROM notes WHERE voiced AND event_type IN ('purchase', 'signup')),
z AS (SELECT chart_id, (ceil(max(end_s) * 2) + 1)::INT AS n FROM v GROUP BY chart_id),
i AS (SELECT v.*, greatest(0, round_even(start_s * 2, 0)::INT) AS a, least(n, round_even(end_s * 2, 0)::INT) AS b0, n FROM v JOIN z USING (chart_id)),
x AS (SELECT *, unnest(generate_series(a, CASE WHEN b0 <= a THEN least(n, a + 1) ELSE b0 END - 1)) AS frame FROM i),
h AS (SELECT chart_id, speaker, frame, 440 * pow(2, (midi - 69) / 12) AS f0, least(1, greatest(0.6, amplitude)) AS conf FROM x QUALIFY row_number() OVER (PARTITION BY chart_id, speaker, frame ORDER BY start_s DESC, midi DESC, pos DESC) = 1),
g AS (SELECT chart_id, speaker, unnest(generate_series(0, n - 1)) AS frame FROM (SELECT DISTINCT chart_id, speaker FROM v) JOIN z USING (chart_id))
SELECT g.chart_id, g.speaker, g.frame::INT AS frame, g.frame / 2 AS t, round(coalesce(f0, 0), 6) AS f0, round(coalesce(conf, 0), 6) AS conf FROM g LEFT JOIN h USING (chart_id, speaker, frame)"""
)
def voice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames a chart second for every voice."""
    out = recurrences.rasterized(_events(spark, sf_dir), rate=2, hop=1)
    return out.withColumns({"f0": F.round("f0", 6), "conf": F.round("conf", 6)})


@Q.add("WITH " + T.NOTES + "SELECT chart_id, pos, round(440 * pow(2, (midi - 69) / 12), 4) AS hz FROM notes WHERE voiced")
def pitch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.notes(spark, sf_dir).where("voiced").select("chart_id", "pos", F.round(timing.hz_of(F.col("midi")), 4).alias("hz"))


@Q.add("WITH " + T.NOTES + ", h AS (SELECT chart_id, pos, row_number() OVER (PARTITION BY chart_id ORDER BY pos) - 1 AS right_pos FROM notes WHERE event_id % 5 <> 0) SELECT chart_id, pos::INT AS left_pos, right_pos::INT AS right_pos FROM h")
def word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words that are all different; every fifth was not heard. What was
    heard lines up with itself."""
    gold, heard = _words(spark, sf_dir)
    return lyrics.matched_words(gold, heard)


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = T.notes(spark, sf_dir).withColumn("key", F.concat(F.lit("w"), "pos"))
    rows = rows.withColumns({c: F.rint(F.col(c) * 64) / 64 for c in ("start_s", "end_s")})  # no error in sums
    gold, late = rows.select("chart_id", F.col("pos").cast("int").alias("pos"), "key", "start_s", "end_s"), (F.col("event_id") % 7) / 64
    heard = rows.where("event_id % 5 <> 0").withColumn("new", F.row_number().over(Window.partitionBy("chart_id").orderBy("pos")).cast("int") - 1)
    return gold, heard.select("chart_id", F.col("new").alias("pos"), "key", (F.col("start_s") + late).alias("start_s"), (F.col("end_s") - late).alias("end_s"))


@Q.add(
    "WITH " + T.NOTES + """,
h AS (SELECT chart_id, (event_id % 7) / 64 AS late, event_id % 5 <> 0 AS heard FROM notes),
s AS (SELECT chart_id, count(*) AS words, count(*) FILTER (heard) AS n, list_sort(list(late) FILTER (heard)) AS a, avg(late) FILTER (heard) AS mae, median(late) FILTER (heard) AS bias FROM h GROUP BY chart_id)
SELECT chart_id, round(n / words, 3) AS recall, CASE WHEN n > 0 THEN n END AS n, round(a[n // 2 + 1] * 1000, 1)::DOUBLE AS median_ms, round(mae * 1000, 1)::DOUBLE AS mae_ms, round(a[floor(0.9 * (n - 1))::INT + 1] * 1000, 1)::DOUBLE AS p90_ms, round(bias * 1000, 1)::DOUBLE AS onset_bias_ms, round(-bias * 1000, 1)::DOUBLE AS end_bias_ms FROM s"""
)
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of words that were heard, and how far their times are off."""
    gold, heard = _words(spark, sf_dir)
    out = evaluation.timing_scores(gold, heard, lyrics.matched_words(gold, heard))
    return out.select("chart_id", "recall", "onset.n", "onset.median_ms", "onset.mae_ms", "onset.p90_ms", F.col("onset.bias_ms").alias("onset_bias_ms"), F.col("end.bias_ms").alias("end_bias_ms"))


@Q.add(
    """WITH w AS (SELECT p_size AS chart_id, p_partkey AS pos, 1 + (p_partkey % 7) / 10 AS stop, 0.3 + (p_partkey % 5) / 20 AS onset, p_partkey % 2 = 0 AS fits FROM part),
e AS (SELECT chart_id, abs(stop / 2 - onset) AS even, CASE WHEN fits THEN abs(0.4 - onset) END AS cut FROM w)
SELECT chart_id, count(*) AS n_words, count(even) AS n_prop, count(cut) AS n_fa, round(median(even) * 1000, 1) AS prop_median_ms, round(median(cut) * 1000, 1) AS fa_median_ms FROM e GROUP BY chart_id"""
)
def syllable_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as words of two syllables, every other with the times of its letters."""
    key, stop, onset = F.col("p_partkey"), 1 + (F.col("p_partkey") % 7) / 10, 0.3 + (F.col("p_partkey") % 5) / 20
    part = lambda t, a, b: F.struct(F.lit(t).alias("text"), a.alias("start_s"), b.alias("end_s"))
    words = T.read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("chart_id"), key.alias("pos"), F.lit("mano").alias("text"), F.lit(0.0).alias("start_s"), stop.alias("end_s"), F.array(part("ma", F.lit(0.0), onset), part("no", onset, stop)).alias("syllables"))
    letters = words.where("pos % 2 = 0").select("chart_id", "pos", F.lit("mano").alias("norm"), F.array(*(F.struct(F.lit(i / 5).alias("s"), F.lit((i + 1) / 5).alias("e")) for i in range(4))).alias("char_spans"))
    return evaluation.syllable_scores(words, letters)
