"""Queries of aggregates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.functions import text, timing
from songframe.operators import metrics as M
from songframe.operators import recurrences, sampling
from songframe.plans import tables as T
from songframe.plans.book import Book
from songframe.plans.sequences import LINED, lined

Q = Book()


@Q.add(
    "WITH " + T.NOTES + """SELECT chart_id, round(avg((kind = 'golden')::INT), 6) AS golden_fraction, round(avg((event_type LIKE 'v%')::INT), 6) AS hold_fraction,
       (max(round_even(coalesce(midi, 60), 0)) - min(round_even(coalesce(midi, 60), 0)))::INT AS pitch_range FROM notes WHERE kind <> 'freestyle' GROUP BY chart_id"""
)
def chart_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for notes that hold."""
    rows = T.notes(spark, sf_dir).where("kind <> 'freestyle'").withColumn("pitch", F.rint(F.coalesce("midi", F.lit(60.0))).cast("int"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    held = text.starts_hold(F.when(F.startswith("event_type", F.lit("v")), F.lit(" ~")).otherwise(F.col("event_type")))
    return rows.groupBy("chart_id").agg(share(F.col("kind") == "golden").alias("golden_fraction"), share(held).alias("hold_fraction"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"))


#: Greedy matching by a recursive walk over the reference notes of a chart, with the taken notes as a list.
MATCHED = T.SIDES + """,
ro AS MATERIALIZED (SELECT chart_id, pos, start_s, midi, row_number() OVER (PARTITION BY chart_id ORDER BY start_s, pos) AS k FROM ref),
near AS MATERIALIZED (SELECT r.chart_id, r.k, r.pos AS ref_pos, list({'d': abs(g.start_s - r.start_s), 's': g.start_s, 'p': g.pos, 'e': g.start_s - r.start_s} ORDER BY abs(g.start_s - r.start_s), g.start_s, g.pos) FILTER (g.pos IS NOT NULL) AS c
         FROM ro r LEFT JOIN gen g ON g.chart_id = r.chart_id AND abs(g.start_s - r.start_s) < 0.3 GROUP BY ALL),
walk AS (SELECT chart_id, k, ref_pos, c[1] AS hit, CASE WHEN c[1] IS NULL THEN []::BIGINT[] ELSE [c[1].p] END AS used FROM near WHERE k = 1
         UNION ALL
         SELECT n.chart_id, n.k, n.ref_pos, list_filter(coalesce(n.c, []), lambda x: NOT list_contains(w.used, x.p))[1],
                CASE WHEN list_filter(coalesce(n.c, []), lambda x: NOT list_contains(w.used, x.p))[1] IS NULL THEN w.used ELSE list_append(w.used, list_filter(n.c, lambda x: NOT list_contains(w.used, x.p))[1].p) END
         FROM near n JOIN walk w ON n.chart_id = w.chart_id AND n.k = w.k + 1),
pairs AS (SELECT chart_id, hit.p AS gen_pos, ref_pos, hit.e AS error FROM walk WHERE hit IS NOT NULL)
"""


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gen, ref = T.sides(T.notes(spark, sf_dir))
    return recurrences.greedy_match(gen, ref), gen, ref


@Q.add("WITH RECURSIVE " + MATCHED + "SELECT chart_id, gen_pos::INT AS gen_pos, ref_pos::INT AS ref_pos, round(error, 6) AS error FROM pairs")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)[0].withColumn("error", F.round("error", 6))


@Q.add("WITH RECURSIVE " + MATCHED + "SELECT chart_id, count(*) AS matched, round(median(abs(error)) * 1000, 1) AS median_ms, round(avg(abs(error)) * 1000, 1) AS mean_ms FROM pairs GROUP BY chart_id")
def onset_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs("error")
    return matched(spark, sf_dir)[0].groupBy("chart_id").agg(F.count(F.lit(1)).alias("matched"), F.round(M.median(size) * 1000, 1).alias("median_ms"), F.round(F.avg(size) * 1000, 1).alias("mean_ms"))


@Q.add(
    "WITH RECURSIVE " + MATCHED + """,
s AS (SELECT chart_id, count(*) AS n, list_sort(list(abs(error))) AS a, avg(abs(error)) AS mae, median(error) AS bias FROM pairs GROUP BY chart_id)
SELECT chart_id, n, round(a[n // 2 + 1] * 1000, 1) AS median_ms, round(mae * 1000, 1) AS mae_ms, round(a[floor(0.9 * (n - 1))::INT + 1] * 1000, 1) AS p90_ms, round(bias * 1000, 1) AS bias_ms FROM s"""
)
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.error_stats(matched(spark, sf_dir)[0], "chart_id")


PITCHES = """,
p AS (SELECT pairs.chart_id, coalesce(g.midi, 60) AS g, coalesce(r.midi, 60) AS r FROM pairs JOIN gen g ON g.chart_id = pairs.chart_id AND g.pos = gen_pos JOIN ref r ON r.chart_id = pairs.chart_id AND r.pos = ref_pos),
q AS (SELECT chart_id, g - median(g) OVER (PARTITION BY chart_id) AS g, r - median(r) OVER (PARTITION BY chart_id) AS r FROM p)
"""


def _pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, gen, ref = matched(spark, sf_dir)
    midi = F.coalesce("midi", F.lit(60.0))
    pairs = pairs.join(gen.select("chart_id", F.col("pos").alias("gen_pos"), midi.alias("g")), ["chart_id", "gen_pos"])
    return M.pitch_agreement(pairs.join(ref.select("chart_id", F.col("pos").alias("ref_pos"), midi.alias("r")), ["chart_id", "ref_pos"]))


@Q.add("WITH RECURSIVE " + MATCHED + PITCHES + "SELECT chart_id, round(coalesce(covar_pop(g, r) / nullif(stddev_pop(g) * stddev_pop(r), 0), 0), 3) AS contour_corr FROM q GROUP BY chart_id")
def contour_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pitches(spark, sf_dir).select("chart_id", "contour_corr")


@Q.add("WITH RECURSIVE " + MATCHED + PITCHES + "SELECT chart_id, round(avg((abs(g - r) <= 2)::INT), 3) AS within_2st FROM q GROUP BY chart_id")
def within_2st(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pitches(spark, sf_dir).select("chart_id", "within_2st")


@Q.add(
    "WITH RECURSIVE " + MATCHED + """,
c AS (SELECT chart_id, count(*) FILTER (event_type IN ('view', 'signup')) AS gen_notes, count(*) FILTER (event_type IN ('click', 'purchase')) AS ref_notes FROM notes GROUP BY chart_id),
m AS (SELECT chart_id, count(*) AS matched FROM pairs GROUP BY chart_id)
SELECT chart_id, gen_notes, ref_notes, coalesce(matched, 0) AS matched, CASE WHEN ref_notes = 0 THEN 0 ELSE round(gen_notes / ref_notes, 3) END AS note_count_ratio,
       CASE WHEN ref_notes = 0 THEN 0 ELSE round(coalesce(matched, 0) / ref_notes, 3) END AS match_rate_vs_ref FROM c LEFT JOIN m USING (chart_id)"""
)
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.notes(spark, sf_dir).groupBy("chart_id").agg(F.count_if(F.col("event_type").isin("view", "signup")).alias("gen_notes"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("ref_notes"))
    hits = matched(spark, sf_dir)[0].groupBy("chart_id").agg(F.count(F.lit(1)).alias("matched"))
    return M.match_rates(rows.join(hits, "chart_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0))))


@Q.add("WITH " + T.NOTES + "SELECT chart_id, count(*) AS n_words, round(arg_max(end_s, pos) - min(start_s), 6) AS span_s, round(count(*) / ((arg_max(end_s, pos) - min(start_s)) / 60), 3) AS wpm FROM notes GROUP BY chart_id HAVING count(*) >= 30 AND arg_max(end_s, pos) - min(start_s) >= 40")
def wpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a minute of charts with 30 words and 40 seconds or more."""
    rows = T.notes(spark, sf_dir).groupBy("chart_id").agg(F.count(F.lit(1)).alias("n_words"), (F.max_by("end_s", "pos") - F.min("start_s")).alias("span"))
    return rows.where("n_words >= 30 AND span >= 40").select("chart_id", "n_words", F.round("span", 6).alias("span_s"), F.round(F.col("n_words") / (F.col("span") / 60), 3).alias("wpm"))


@Q.add("SELECT conv_id, role FROM (SELECT conv_id, role, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority(T.read(spark, sf_dir, "conversations"), "conv_id", "role")


@Q.add("SELECT chart_id, role, row_number() OVER (PARTITION BY chart_id ORDER BY first, role) - 1 AS rank FROM (SELECT conv_id AS chart_id, role, min(turn) AS first FROM conversations GROUP BY ALL)")
def speaker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "chart_id")
    return M.speaker_order(rows, "turn", "role").select("chart_id", "role", "rank")


@Q.add("WITH " + LINED + ", t AS (SELECT chart_id, line_no, (arg_min(event_type, pos) IN ('purchase', 'signup'))::INT AS track FROM lined GROUP BY ALL) SELECT chart_id, round(avg(track), 6) AS share, coalesce(sum(track) >= 2 AND sum(1 - track) >= 2 AND avg(track) BETWEEN 0.1 AND 0.9, FALSE) AS split FROM t GROUP BY chart_id")
def track_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lined(spark, sf_dir).groupBy("chart_id", "line_no").agg(F.min_by("event_type", "pos").isin("purchase", "signup").cast("int").alias("track"))
    return M.track_shares(lines).select("chart_id", F.round("share", 6).alias("share"), "split")


#: A stand-in for a results table: documents with their labels.
RESULTS = """
r AS (SELECT d.doc_id, d.lang, d.n_chars::DOUBLE AS n_chars, l.quality::DOUBLE AS quality, ntile.band FROM documents d LEFT JOIN labels l USING (doc_id)
      JOIN (SELECT doc_id, CASE WHEN n_chars < t.a[len(t.a) // 3 + 1] THEN 0 WHEN n_chars < t.a[2 * len(t.a) // 3 + 1] THEN 1 ELSE 2 END AS band FROM documents, (SELECT list_sort(list(n_chars)) AS a FROM documents) t) ntile USING (doc_id))
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    labels = T.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return sampling.with_band(docs, "n_chars").join(labels, "doc_id", "left")


@Q.add("WITH " + RESULTS + """SELECT CASE WHEN grouping(lang) = 1 AND grouping(band) = 1 THEN 'ALL' WHEN grouping(lang) = 0 THEN 'lang=' || lang ELSE 'band=' || band END AS stratum,
       count(*) AS n, round(median(n_chars), 3) AS n_chars, round(median(quality), 3) AS quality FROM r GROUP BY GROUPING SETS ((), (lang), (band))""")
def strata_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.strata_medians(_results(spark, sf_dir), "n_chars", "quality")


@Q.add("SELECT lang, count(*) AS n, median(n_chars) AS n_chars FROM documents GROUP BY lang")
def language_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.language_medians(T.read(spark, sf_dir, "documents").select("lang", "n_chars"), "n_chars")


@Q.add("SELECT metric, count(value) AS n, round(median(value), 3) AS median, round(avg(value), 3) AS mean FROM (SELECT unnest(['quantity', 'price', 'discount']) AS metric, unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem) GROUP BY metric")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return M.summary(rows, "quantity", "price", "discount")


@Q.add("SELECT l_orderkey AS chart_id, round(sum(l_discount * l_quantity) / CASE WHEN sum(l_quantity) = 0 THEN 1 ELSE sum(l_quantity) END, 10) AS score, round(avg(l_discount) FILTER (l_discount > 0), 6) AS mean_score, round(avg((l_discount > 0)::INT), 6) AS aligned FROM lineitem GROUP BY l_orderkey")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores weighted by frames, and over those above zero; discounts stand for scores."""
    score = F.col("l_discount")
    return T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chart_id")).agg(
        F.round(M.weighted_mean(score, F.col("l_quantity")), 10).alias("score"), F.round(F.avg(F.when(score > 0, score)), 6).alias("mean_score"), F.round(F.avg((score > 0).cast("int")), 6).alias("aligned")
    )


@Q.add("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_discount < 0.02) AS close, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").groupBy("l_linestatus")
    return rows.agg(F.count_if(F.col("l_returnflag") == "A").alias("ok"), F.count_if(F.col("l_discount") < 0.02).alias("close"), F.count(F.lit(1)).alias("n"))


@Q.add("WITH " + LINED + "SELECT chart_id, count(*) AS notes, count(DISTINCT line_no) AS lines, count(DISTINCT event_type) > 4 AS duet FROM lined GROUP BY chart_id")
def chart_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lined(spark, sf_dir).groupBy("chart_id")
    return rows.agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("line_no").alias("lines"), (F.count_distinct("event_type") > 4).alias("duet"))


@Q.add("SELECT l_orderkey, l_linenumber, pow(2.0, round_even(log2(l_extendedprice / (l_quantity * 100)), 0)) AS mult, abs(l_extendedprice / (l_quantity * 100) / pow(2.0, round_even(log2(l_extendedprice / (l_quantity * 100)), 0)) - 1) AS dev FROM lineitem")
def tempo_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against a hundred a piece, as a tempo against another."""
    est, bpm = F.col("l_quantity") * 100, F.col("l_extendedprice")
    return T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timing.tempo_multiple(est, bpm).alias("mult"), timing.tempo_deviation(est, bpm, digits=None).alias("dev"))


@Q.add("SELECT conv_id, count(*) AS n_words, count(*) * 20 AS duration, count(*) * 20 > 60 AND count(*) / (count(*) * 20 / 60) < 15 AS few FROM conversations GROUP BY conv_id")
def low_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_words")).withColumn("duration", F.col("n_words") * 20)
    return rows.withColumn("few", timing.few_words(F.col("n_words"), F.col("duration")))


@Q.add("SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round_even(least(o_totalprice * 0.25, greatest(0, 1.5 + 30 * 15 / 240.0)), 2) END AS preview FROM orders")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "orders").select("o_orderkey", timing.preview_start(F.col("o_totalprice"), F.lit(1.5), F.lit(T.BPM)).alias("preview"))


@Q.add("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':0'), doc_id LIMIT 30")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: thirty documents by a seeded hash."""
    return sampling.uniform(T.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 30)


@Q.add(
    """WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IN ('es', 'en') THEN lang ELSE 'other' END AS lang_group, n_chars::DOUBLE AS n_chars FROM documents),
z AS (SELECT list_sort(list(n_chars)) AS v, count(*) AS n FROM d),
b AS MATERIALIZED (SELECT d.*, CASE WHEN n_chars < v[n // 3 + 1] THEN 0 WHEN n_chars < v[2 * n // 3 + 1] THEN 1 ELSE 2 END AS band FROM d, z),
k AS (SELECT list({'g': lang_group, 'b': band} ORDER BY lang_group, band) AS keys, list(c ORDER BY lang_group, band) AS sizes FROM (SELECT lang_group, band, count(*) AS c FROM b GROUP BY ALL)),
a AS (SELECT keys, sizes, list_transform(sizes, lambda c: greatest(1, round_even(100 * c / list_sum(sizes), 0)::BIGINT)) AS n FROM k
      UNION ALL
      SELECT keys, sizes, CASE WHEN list_sum(n) > 100 THEN list_transform(n, lambda x, i: x - (i = list_position(n, list_max(n)))::INT)
                               ELSE list_transform(n, lambda x, i: x + (i = list_position(room, list_max(room)))::INT) END
      FROM (SELECT *, list_transform(sizes, lambda c, i: c - n[i]) AS room FROM a) WHERE list_sum(n) <> 100),
p AS (SELECT unnest(keys, recursive := true), unnest(n) AS share FROM a WHERE list_sum(n) = 100)
SELECT doc_id, lang_group, n_chars, band FROM b JOIN p ON lang_group = g AND band = p.b QUALIFY row_number() OVER (PARTITION BY lang_group, band ORDER BY md5(doc_id || ':0'), doc_id) <= share"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a hundred documents over language group and length."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", text.language_group(F.col("lang")).alias("lang_group"), F.col("n_chars").cast("double").alias("n_chars"))
    return sampling.stratified(docs, "doc_id", "lang_group", "n_chars", 100)


@Q.add("WITH r AS (SELECT l_linestatus AS row, count(*) AS lines, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_linestatus) SELECT row, rpad('lines', 28, ' ') || ' ' || lines AS line FROM r UNION ALL SELECT row, rpad('discount', 28, ' ') || ' ' || discount FROM r")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("row")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return M.report(rows, "row", "lines", "discount")
